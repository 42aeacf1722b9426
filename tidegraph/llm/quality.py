"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  A passage is a vector of hashed words, hashed pairs of
neighbouring words' shapes, and surface statistics; a tanh layer encodes it, gated attention weighs the
passages, and the weighted sum gives the document's probability of label 1.  Only document labels are used for training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import prepare, remainder, sampled_labels
from .textkit import Words, as_bytes, blocks

PASSAGE = 64
#: Bounds of the training sample: rows, and passages a text, which are taken evenly over the whole text.
TRAIN_ROWS, TRAIN_PASSAGES = 3000, 256
#: Buckets of hashed words and of hashed shape pairs.
WORDS, SHAPES = 256, 64
HIDDEN, GATE, EPOCHS, GROUP, RATE, DECAY = 24, 12, 24, 128, 0.01, 1e-3


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER, _DIGIT = _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789")
_HIGH, _STOP, _MARK, _BAR, _SIGN = _class(bytes(range(128, 256))), _class(b".,;:"), _class(b"!?"), _class(b"|<>{}[]/\\=_~"), _class(b"#$%&*@^+")
_CLASSES = (_UPPER, _LOWER, _DIGIT, _HIGH, _STOP, _MARK, _BAR, _SIGN)
_KIND = sum(((i + 1) * c.astype(np.uint64) for i, c in enumerate(_CLASSES)), np.zeros(256, np.uint64))
SURFACE = len(_CLASSES) + 8
FEATURES = SURFACE + WORDS + SHAPES


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and offsets by text; a text without words has one passage of zeros."""
    w = Words(texts)
    n = w.counts()
    many = np.maximum(1, -(-n // PASSAGE))
    off = np.concatenate(([0], np.cumsum(many)))
    x = np.zeros((off[-1], FEATURES), np.float32)
    if len(w.h):
        index = np.arange(len(w.h)) - np.repeat(w.off[:-1], n)
        own = np.repeat(off[:-1], n) + index // PASSAGE
        heads = np.flatnonzero(index % PASSAGE == 0)
        p = own[heads]
        size = np.add.reduceat(w.end - w.start, heads).astype(np.float64)
        count = np.diff(np.append(heads, len(w.h))).astype(np.float64)
        edges = w.start[heads]
        for i, c in enumerate(_CLASSES):
            x[p, i] = np.add.reduceat(c[w.buf], edges, dtype=np.int64) / size
        length = (w.end - w.start).astype(np.float64)
        mean = np.add.reduceat(length, heads) / count
        same = np.concatenate(([False], (w.h[1:] == w.h[:-1]) & (own[1:] == own[:-1])))
        order = np.lexsort((w.h, own))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (w.h[order][1:] != w.h[order][:-1]) | (own[order][1:] != own[order][:-1])
        letter = np.add.reduceat((_UPPER | _LOWER | _HIGH | _DIGIT)[w.buf], w.start, dtype=np.int64) > 0
        first_upper = _UPPER[w.buf[w.start]] > 0
        ends = _STOP[w.buf[w.end - 1]] > 0
        k = len(_CLASSES)
        x[p, k] = mean / 10
        x[p, k + 1] = np.sqrt(np.maximum(np.add.reduceat(length**2, heads) / count - mean**2, 0)) / 10
        x[p, k + 2] = np.add.reduceat(same, heads, dtype=np.int64) / count
        x[p, k + 3] = np.bincount(own[order], fresh, off[-1])[p] / count
        x[p, k + 4] = np.add.reduceat(~letter, heads, dtype=np.int64) / count
        x[p, k + 5] = np.add.reduceat(first_upper, heads, dtype=np.int64) / count
        x[p, k + 6] = np.add.reduceat(ends, heads, dtype=np.int64) / count
        x[p, k + 7] = np.minimum(count / PASSAGE, 1)
        for at, size, code, where in (
            (SURFACE, WORDS, w.h >> np.uint64(40), own),
            (SURFACE + WORDS, SHAPES, *_shape_pairs(w, length, own)),
        ):
            counted = np.bincount(where * size + (code % np.uint64(size)).astype(np.int64), minlength=off[-1] * size).reshape(-1, size)
            counted = np.log1p(counted).astype(np.float32)
            x[:, at:at + size] = counted / np.maximum(np.sqrt((counted**2).sum(1, keepdims=True)), 1)
    return x, off


def _shape_pairs(w: Words, length: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the shapes of neighbouring words (kinds of the first and last byte, and length), and their passages."""
    first, last = _KIND[w.buf[w.start]], _KIND[w.buf[w.end - 1]]
    shape = (first * 9 + last) * 4 + np.minimum(np.log2(length), 3).astype(np.uint64)
    pairs = shape[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = own[1:] == own[:-1]
    return (pairs[inside] >> np.uint64(33)), own[1:][inside]


class AttentionModel:
    """Gated attention over encoded passages, trained by Adam on groups of documents from a fixed seed."""

    def __init__(self, hidden: int = HIDDEN, gate: int = GATE, epochs: int = EPOCHS):
        self.hidden, self.gate, self.epochs = hidden, gate, epochs

    def fit(self, bags: list[np.ndarray], labels: np.ndarray) -> AttentionModel:
        rng = np.random.default_rng(5)
        if not bags:
            bags, labels = [np.zeros((1, FEATURES), np.float32)], np.array([0.5])
        off = np.concatenate(([0], np.cumsum([len(b) for b in bags])))
        total = sum(b.sum(0, dtype=np.float64) for b in bags)
        self.mean = (total / off[-1]).astype(np.float32)
        self.scale = (np.sqrt(sum(((b - self.mean) ** 2).sum(0, dtype=np.float64) for b in bags) / off[-1]) + 1e-3).astype(np.float32)
        f, h, g = bags[0].shape[1], self.hidden, self.gate
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        prior = np.clip(labels.mean(), 0.01, 0.99)
        self.w = [draw(f, h), np.zeros(h), draw(h, g), draw(h, g), draw(g, 1)[:, 0], draw(h, 1)[:, 0], np.array(np.log(prior / (1 - prior)))]
        m, v = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w]
        t = 0
        for epoch in range(self.epochs):
            order = rng.permutation(len(bags))
            for lo in range(0, len(order), GROUP):
                t += 1
                own = order[lo:lo + GROUP]
                x, at = np.vstack([bags[i] for i in own]), np.concatenate(([0], np.cumsum([len(bags[i]) for i in own])))
                step = RATE * (1 - epoch / self.epochs)
                for i, d in enumerate(self._gradients(x, at, labels[own])):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * d, 0.999 * v[i] + 0.001 * d * d
                    self.w[i] = self.w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return self

    def _forward(self, x: np.ndarray, off: np.ndarray) -> tuple:
        w1, b1, gv, gu, ga, c, b = self.w
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        e = np.tanh(z @ w1 + b1)
        tv, su = np.tanh(e @ gv), 1 / (1 + np.exp(-(e @ gu)))
        s = (tv * su) @ ga
        own = np.repeat(np.arange(len(off) - 1), np.diff(off))
        s = np.exp(s - np.maximum.reduceat(s, off[:-1])[own])
        a = s / np.add.reduceat(s, off[:-1])[own]
        bag = np.add.reduceat(a[:, None] * e, off[:-1])
        return z, e, tv, su, a, own, bag, 1 / (1 + np.exp(-np.clip(bag @ c + b, -30, 30)))

    def _gradients(self, x: np.ndarray, off: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        w1, b1, gv, gu, ga, c, b = self.w
        z, e, tv, su, a, own, bag, p = self._forward(x, off)
        d = (p - y) / len(y)
        de = a[:, None] * (d[own, None] * c)
        value = (e @ c) * d[own]
        ds = a * (value - np.add.reduceat(a * value, off[:-1])[own])
        dtv, dsu = ds[:, None] * ga * su * (1 - tv**2), ds[:, None] * ga * tv * su * (1 - su)
        de = (de + dtv @ gv.T + dsu @ gu.T) * (1 - e**2)
        grads = [z.T @ de, de.sum(0), e.T @ dtv, e.T @ dsu, (tv * su).T @ ds, bag.T @ d, d.sum()]
        return [g + DECAY * w if i != 6 else g for i, (g, w) in enumerate(zip(grads, self.w))]

    def scores(self, x: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self._forward(x, off)[-1]


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> AttentionModel:
    """Learns from at most about ``most`` labelled documents whose crc32 remainder modulo 5 is not 0.

    Of rows that repeat a doc_id, the least text counts; of a text with more passages than TRAIN_PASSAGES, that many, evenly spaced.
    """
    prepare(docs.sparkSession)
    sample = sampled_labels(labels, "quality", 5, 0, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in as_bytes(batch.column(1)):
                x = passages([text])[0]
                x = x[np.arange(TRAIN_PASSAGES) * len(x) // TRAIN_PASSAGES] if len(x) > TRAIN_PASSAGES else x
                bags.append(x.astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    got = rows.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label double, bag binary").collect()
    got.sort(key=lambda r: r.doc_id)
    return AttentionModel().fit([np.frombuffer(r.bag, np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got], np.array([r.label for r in got]))


def quality_scores(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """(doc_id, held_out, score) for each row; null and empty texts are one passage without words.

    Repeated rows get equal values; other columns of ``docs`` are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            parts = [model.scores(*passages(texts[lo:hi])) for lo, hi in blocks(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.empty(0), *parts]))], ["doc_id", "held_out", "score"])

    return docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
