"""Language identification with string kernels.

Each text is the set of its byte n-grams (A-Z lower-cased), n = 1..3.  The blended-spectrum
presence kernel of two texts is the mean over n of |A_n & B_n| / sqrt(|A_n| |B_n|), over the
n-grams that the landmarks hold.  Landmark texts give the Nyström map; kernel ridge
regression, one language against the rest, is solved on it.  Documents are scored in blocks:
presence matrix times landmark matrix, times coefficients.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import prepare, remainder
from .textkit import FOLD_BYTES, as_bytes, blocks

#: Bounds of the training sample: rows a language, and bytes a text where a language has such texts.
ROWS_PER_LANGUAGE, TEXT_BYTES = 400, 20_000
LANDMARKS, ORDERS, RIDGE, SHARPNESS = 128, (1, 2, 3), 1e-2, 6.0
#: Texts of one matrix product.
ROWS = 128
_ASCII_LETTER, _LETTER = re.compile(rb"[A-Za-z]"), re.compile(r"[^\W\d_]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace")))


def grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of all n-grams inside the texts."""
    joined = b"".join(texts).translate(FOLD_BYTES)
    buf = np.frombuffer(joined, np.uint8).astype(np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = buf[: max(0, len(buf) - n + 1)].copy()
    for i in range(1, n):
        code = (code << 8) | buf[i: len(buf) - n + 1 + i]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[: len(code)]
    left = np.repeat(np.cumsum(sizes), sizes)[: len(code)] - np.arange(len(code))
    return row[left >= n], code[left >= n]


class LanguageModel:
    """``fit`` on texts and languages, ``scores`` for more texts; equal input, equal model.  Without a text, it knows no language."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.orders, self.landmarks, self.ridge = orders, landmarks, ridge
        self._tables: dict[int, np.ndarray] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def fit(self, texts: list[bytes], langs: list[str]) -> LanguageModel:
        self.classes = sorted(set(langs))
        if not texts:
            return self
        own = {c: [t for t, x in zip(texts, langs) if x == c] for c in self.classes}
        each = max(1, self.landmarks // max(1, len(self.classes)))
        marks = [t for c in self.classes for t in own[c][:each]]
        self.vocabulary = {n: np.unique(grams(marks, n)[1]) for n in self.orders}
        self.marks = {n: x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) for n, x in self._presence(marks).items()}  # a row a landmark
        w = self._kernel(marks)
        values, vectors = np.linalg.eigh((w + w.T).astype(np.float64) / 2)
        keep = values > 1e-6 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.hstack([self._kernel(texts) @ root, np.ones((len(texts), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.classes)[None], 1.0, 0.0)
        weight = 1 / (y.sum(0) @ y.T)[:, None]
        a = phi.T @ (phi * weight) + self.ridge * np.eye(phi.shape[1]) / len(texts)
        b = np.linalg.solve(a, phi.T @ (y * weight))
        self.coefficients, self.offset = (root @ b[:-1]).astype(np.float32), b[-1].astype(np.float32)
        return self

    def _presence(self, texts: list[bytes]) -> dict[int, np.ndarray]:
        if self._tables is None:
            self._tables = {}
            for n, codes in self.vocabulary.items():
                self._tables[n] = np.full(256**n, -1, np.int32)
                self._tables[n][codes] = np.arange(len(codes))
        out = {}
        for n in self.orders:
            row, code = grams(texts, n)
            at = self._tables[n][code]
            out[n] = np.zeros((len(texts), len(self.vocabulary[n])), np.float32)
            out[n][row[at >= 0], at[at >= 0]] = 1
        return out

    def _kernel(self, texts: list[bytes]) -> np.ndarray:
        """Kernel values of the texts with the landmarks, ROWS texts at a time: presence rows are dense."""
        out = np.zeros((len(texts), len(self.marks[self.orders[0]])), np.float32)
        for lo in range(0, len(texts), ROWS):
            for n, x in self._presence(texts[lo:lo + ROWS]).items():
                out[lo:lo + ROWS] += (x @ self.marks[n].T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return out / len(self.orders)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Softmax of the one-versus-rest outputs, a row for each text."""
        if not self.classes:
            return np.zeros((len(texts), 1))
        z = SHARPNESS * (self._kernel(texts) @ self.coefficients + self.offset).astype(np.float64)
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)


def training_rows(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> tuple[list[bytes], list[str]]:
    """A sample of every language, rows with the least hash of doc_id; texts over TEXT_BYTES only where a language has no others."""
    rows = docs.select("doc_id", "text", "lang", (F.octet_length("text") <= TEXT_BYTES).alias("short")).where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id"), 5) != 0)
    )
    counts = rows.groupBy("lang").agg(F.count(F.when(F.col("short"), 1)).alias("shorts"), F.count("*").alias("all"))
    share = F.least(F.lit(1.0), F.lit(float(per_language)) / F.when(F.col("shorts") > 0, F.col("shorts")).otherwise(F.col("all")))
    sizes = counts.select(F.col("lang").alias("own"), (F.col("shorts") == 0).alias("long"), share.alias("share"))
    taken = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    got = rows.join(F.broadcast(sizes), F.col("lang") == F.col("own")).where((F.col("short") | F.col("long")) & taken).select("doc_id", "text", "lang").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.lang, r.text))
    return [r.text.encode() for r in got], [r.lang for r in got]


def fit_language(docs: DataFrame) -> LanguageModel:
    return LanguageModel().fit(*training_rows(docs))


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """All columns of ``docs``, with the prediction and its score under ``names`` (clashing columns of those names are replaced).

    A null text, or one without a letter, is ``und`` with score 0; so is every text where the model
    has learned no language.  Repeated rows get equal values; a tie goes to the first language by name.
    """
    prepare(docs.sparkSession)
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(at))
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for lo, hi in blocks(texts) if model.classes else ():
                some = [i for i in range(lo, hi) if has_letter(texts[i])]
                if some:
                    p = model.scores([texts[i] for i in some])
                    for i, c, s in zip(some, p.argmax(1), p.max(1)):
                        lang[i], score[i] = model.classes[c], s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)
