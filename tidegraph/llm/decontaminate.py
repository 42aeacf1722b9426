"""Benchmark decontamination: size-partitioned MinHash containment search.

Items and documents are sets of word shingles.  Items are partitioned by size, a class for each power of
two of their shingles, and each partition has parameters of its own: how many sketch members a
document must hold (``needed``, more for larger items), and so how long a sketch is.  An item's sketch is
the bottom of its MinHash order.  A document that holds at least the share ``threshold`` of an item misses at
most ``floor((1 - threshold) * n)`` of its shingles; with that and ``needed`` more in the sketch, it must hold
``needed`` of them, and no such document is lost.  Documents too small for a partition are not probed for it.  Candidates
are verified by exact shingle containment.  The search is narrow: documents are never shuffled.

Items are read in blocks of a bounded number of words; each block is shipped to
the executors and all documents are searched for it, one block after another.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, prepare, stored
from .textkit import Spans, Words, as_bytes, blocks, shingle_lists

#: Words of benchmark items shipped to the executors at once (about 16 bytes each).
BLOCK_WORDS = 1_000_000
_FILTER = 1 << 20


@dataclass
class Partition:
    """Items of one shingle length and size class: sketch members in order, the items they belong to, and a bitmap of them."""

    needed: int
    least: int
    members: np.ndarray
    items: np.ndarray
    seen: np.ndarray


def needed_hits(size_class: int) -> int:
    """Sketch members that a document must hold: one for items of up to 3 shingles, then one more for each doubling up to 4."""
    return min(4, max(1, size_class))


class ItemBlock:
    """Sketches and whole shingle sets of some items, partitioned by shingle length and size class."""

    def __init__(self, ids: list[int], texts: list[bytes], k: int, threshold: float):
        words = Words(texts, fold=True)
        many = words.counts()
        sh, off = shingle_lists(words, k)
        self.ids, self.sets, self.least, self.parts = ids, [], [], {}
        sketches: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i in range(len(ids)):
            s = np.unique(sh[off[i]:off[i + 1]])
            self.sets.append(s)
            self.least.append(math.ceil(threshold * len(s) - 1e-9))
            if len(s):
                size_class = len(s).bit_length() - 1
                hits = min(needed_hits(size_class), max(1, self.least[i]))
                missed = math.floor((1 - threshold) * len(s) + 1e-9)
                sketches.setdefault((min(k, int(many[i])), size_class), []).extend((int(x), i) for x in s[:missed + hits])
        for (length, size_class), rows in sorted(sketches.items()):
            rows.sort()
            h, own = np.array([x for x, _ in rows], np.uint64), np.array([i for _, i in rows])
            seen = np.zeros(_FILTER, bool)
            seen[h & np.uint64(_FILTER - 1)] = True
            least = min(self.least[i] for i in own)
            self.parts[length, size_class] = Partition(min(needed_hits(size_class), max(1, least)), least, h, own, seen)

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of all pairs that reach the threshold."""
        words, found = Words(texts, fold=True), []
        at = np.arange(len(words.h))
        ends = words.ends_of()
        spans = Spans(words.h)
        length = grams = off = None
        for (size, _), part in self.parts.items():
            if size != length:
                length, s = size, at[at + size <= ends]
                grams, off = spans(s, s + size), np.searchsorted(s, words.off)
            large = np.diff(off) >= max(1, part.least)  # a smaller document can't hold enough of any item of the class
            if not large.any():
                continue
            hit = np.flatnonzero(part.seen[grams & np.uint64(_FILTER - 1)])
            rows = np.searchsorted(off, hit, "right") - 1
            hit, rows = hit[large[rows]], rows[large[rows]]
            lo, hi = np.searchsorted(part.members, grams[hit]), np.searchsorted(part.members, grams[hit], "right")
            ok = hi > lo
            members = {(r, g, i) for r, g, a, b in zip(rows[ok].tolist(), grams[hit[ok]].tolist(), lo[ok], hi[ok]) for i in part.items[a:b].tolist()}
            held = Counter((r, i) for r, _, i in members)
            for r, i in sorted(x for x, n in held.items() if n >= part.needed):
                own = grams[off[r]:off[r + 1]]
                if len(own) >= self.least[i]:
                    shared = int(np.isin(self.sets[i], own).sum())
                    if shared and shared >= self.least[i]:
                        found.append((r, i, shared))
        return found


def item_blocks(items: DataFrame, k: int, threshold: float, block_words: int) -> Iterator[ItemBlock]:
    rows = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / (4 * block_words)))
    for b in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield ItemBlock([r[0] for r in own], [r[1].encode() for r in own], k, threshold)


def containment_search(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each document row and each item held by it.

    Words are lower-cased in A-Z.  Null and empty texts or items, and items with a null id, match
    nothing.  An item of fewer than k words is one shingle, its whole sequence, looked for at that
    length.  Repeated rows and ids give a row each; a null doc_id is carried along.  Other columns of
    ``docs`` are ignored.
    """
    prepare(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {ids}, item_id {items.schema['item_id'].dataType.simpleString()}, n_item bigint, n_shared bigint, containment double"

    def searcher(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, got = as_bytes(batch.column(1)), []
                for lo, hi in blocks(texts):
                    got += [(lo + r, i, c) for r, i, c in block.search(texts[lo:hi])]
                if got:
                    n = [len(block.sets[i]) for _, i, _ in got]
                    c = [x for _, _, x in got]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([r for r, _, _ in got])), pa.array([block.ids[i] for _, i, _ in got]), pa.array(n), pa.array(c), pa.array([x / y for x, y in zip(c, n)])],
                        ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )
        return run

    out = last = None
    for block in item_blocks(items, k, threshold, block_words):  # the driver holds one block; its result is written before the next is read
        if last is not None:
            out = stored(last, "containment") if out is None else out.unionByName(stored(last, "containment"))
        last = docs.select("doc_id", "text").mapInArrow(searcher(block), schema)
    return last if out is None else out.unionByName(last)


def drop_contaminated(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; nulls and repeats as in ``containment_search``."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def keeper(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = as_bytes(batch.column(at)), np.ones(batch.num_rows, bool)
                for lo, hi in blocks(texts):
                    keep[[lo + r for r, _, _ in block.search(texts[lo:hi])]] = False
                yield batch.filter(pa.array(keep))
        return run

    before = None
    for i, block in enumerate(item_blocks(items, k, threshold, block_words)):
        if i:
            docs = stored(docs, "decontaminated")
            discard(before)
            before = docs
        docs = docs.mapInArrow(keeper(block), docs.schema)
    return docs
