"""MinHash near-duplicates with tensored banding.

A document is the set of its word shingles.  Two small collections of ``m`` half keys, each of
``half`` MinHash values, are computed for each distinct set; a table key is a pair of one half key of either
collection, so ``2 * m * half`` MinHash values stand for ``m * m`` keys of ``2 * half`` values.  Two
sets of similarity t meet in some key with probability ``(1 - (1 - t**half)**m)**2``; ``m`` is
chosen from the miss probability at the threshold.

Half keys that only one set has are dropped before pairs are formed.  Within a key, sets are compared with
one hub, not with each other, and every pair is verified on the full sets.  Sets that share a key
but are still in different components after that are compared by an exact prefix filter (see ``_missing_links``).
Components are found by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from .runtime import discard, fresh, prepare, row_hash, stored
from .textkit import Words, as_bytes, blocks, mix, shingle_lists, signed

HALF, MISS = 3, 1e-4
#: Posting lists of the prefix filter longer than this are worked through in rounds of about HUBS sets a list.
POSTINGS, HUBS, SALTS = 64, 1024, 16
#: Bits of a set's parity bitmap.
BITS = 1024


def tables(threshold: float, half: int = HALF, miss: float = MISS) -> int:
    """Half keys a collection needs, to miss a pair at the threshold with at most this probability."""
    return math.ceil(math.log(miss / 2) / math.log(1 - threshold**half))


class Sketcher:
    """Size, two fingerprints, half keys and parity bitmap of the shingle set of each text.

    A bit of the bitmap is the parity of the shingles that fall on it, so bitmaps of two sets differ in at most
    as many bits as the sets differ in shingles.
    """

    def __init__(self, k: int, m: int, half: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = 2 * m * half
        self.k, self.m, self.half, self.seed = k, m, half, seed
        self.a = rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, n, dtype=np.uint32)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        sh, off = shingle_lists(Words(texts, fold=True), self.k)
        own = np.repeat(np.arange(len(texts)), np.diff(off))
        order = np.lexsort((sh, own))
        sh, own = sh[order], own[order]
        if len(sh):
            fresh = np.concatenate(([True], (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])))
            sh, own = sh[fresh], own[fresh]
        n = np.bincount(own, minlength=len(texts))
        print_, other = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
        keys = np.zeros((len(texts), 2 * self.m), np.uint64)
        have = np.flatnonzero(n)
        if len(have):
            heads = np.concatenate(([0], np.cumsum(n[have])))[:-1]
            seeded = mix(sh + np.uint64(self.seed))
            print_[have] = mix(np.add.reduceat(seeded, heads) + n[have].astype(np.uint64))
            other[have] = np.add.reduceat(mix(seeded ^ np.uint64(0x94D049BB133111EB)), heads)
            low = (sh >> np.uint64(32)).astype(np.uint32)
            for i in range(2 * self.m):
                key = np.full(len(have), i + 1, np.uint64)
                for j in range(i * self.half, (i + 1) * self.half):
                    key = mix(key * np.uint64(0x100000001B3) + np.minimum.reduceat(low * self.a[j] + self.b[j], heads))
                keys[have, i] = key
        odd = np.bincount(own * BITS + (sh & np.uint64(BITS - 1)).astype(np.int64), minlength=len(texts) * BITS) & 1
        return n, print_, other, keys, np.packbits(odd.astype(np.uint8)).view(np.int64)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    return np.unique(shingle_lists(Words([text], fold=True), k)[0])


def _verify(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, from (set, text) rows of one text for each set."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, np.ndarray] = {}
        for batch in batches:
            ok = []
            for x, y in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3))):
                if y not in memo:  # rows come sorted by b, so hubs repeat
                    memo = {y: shingle_set(y, k)}
                s, t = shingle_set(x, k), memo[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    own = pairs.join(sets.select(F.col("set").alias("a"), F.col("text").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("text").alias("y")), "b")
    return own.select("a", "b", "x", "y").mapInArrow(check, "a bigint, b bigint")


def _alike(percent: int) -> Column:
    """Whether sizes na, nb and bitmaps xa, xb allow the similarity: differing bits bound the symmetric difference from below."""
    apart = sum((F.bit_count(F.col("xa")[i].bitwiseXOR(F.col("xb")[i])) for i in range(BITS // 64)), F.lit(0))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (100 * (F.col("na") + F.col("nb") - apart) >= percent * (F.col("na") + F.col("nb") + apart))


def _alike_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    ends = [nodes.select(F.col("set").alias(e), F.col("n").alias(f"n{e}"), F.col("bits").alias(f"x{e}")) for e in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").where(_alike(percent)).select("a", "b")


def _first_shared(percent: int) -> Column:
    """Whether a pair can reach the similarity if the shingle at places ia and ib (from 0) is the first it shares."""
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    return 100 * most >= percent * (F.col("na") + F.col("nb") - most)


def _ends(rows: DataFrame, end: str, *more: str | Column) -> DataFrame:
    """Posting rows (set, n, component, place, shingle) as one end, ``a`` or ``b``, of pairs."""
    return rows.select(F.col("set").alias(end), F.col("n").alias(f"n{end}"), F.col("component").alias(f"c{end}"), F.col("place").alias(f"i{end}"), "shingle", *more)


def _long_list_pairs(long: DataFrame, percent: int) -> Iterator[DataFrame]:
    """The candidate pairs of long posting lists, by rounds.

    Every pair of a list across components has an end outside the list's largest component.  These ends are
    taken about HUBS a list and round, until each has been compared with the whole list, so no pair is left out and a
    round compares HUBS times the lists' rows at most.  Pairs that sizes, places or bitmaps rule out do not leave the join.  Lists are salted.
    """
    sizes = long.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("shingle").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), (F.sum("c") - F.max("c")).alias("others"))
    largest = largest.where("others > 0")
    rounds = math.ceil((largest.agg(F.max("others")).first()[0] or 0) / HUBS)
    outside = long.join(largest, "shingle").where("component != largest")
    left = _ends(long, "a", F.col("bits").alias("xa"), F.pmod(F.xxhash64("set"), F.lit(SALTS)).alias("salt"))
    for r in range(rounds):
        hubs = outside.where(F.pmod(F.xxhash64("set", F.lit(3)), F.lit(rounds)) == r)
        right = _ends(hubs, "b", F.col("bits").alias("xb"), "largest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        # two outside ends meet twice: the larger one is the hub
        yield left.join(right, ["shingle", "salt"]).where("ca != cb and (ca = largest or a < b)").where(_first_shared(percent) & _alike(percent)).select("a", "b").distinct()


def _missing_links(keys: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between sets that share a key but are in different components.

    Where two sets reach the threshold, both have one of their shared shingles among their first
    n - ceil(t * n) + 1, shingles being ordered by how many of these sets have them, and the place of the first
    shared one bounds the similarity.  Sets are first compared with the set of each shared key that has the
    fewest shingles of its own, so that a near group becomes one component by a comparison a set and key.  What is
    in different components after that is compared over posting lists: those of up to POSTINGS sets are joined with
    themselves, longer ones are worked through in rounds.
    """
    marked = keys.join(labels, "set")
    mixed = marked.groupBy("key").agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c != d").select("key")
    marked = stored(marked.join(mixed, "key"), "neardup-mixed")
    own = sets.join(marked.select("set").distinct(), "set", "left_semi").select("set", "text")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                sh = signed(shingle_set(text, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sh), s)), pa.array(sh)], ["set", "shingle"])

    shingles = own.mapInArrow(explode, "set bigint, shingle bigint")
    frequent = shingles.groupBy("shingle").agg(F.count("*").alias("f"))
    ranked = shingles.join(frequent, "shingle").groupBy("set").agg(
        F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("list")  # one set's shingles
    )
    n = F.size("list")
    prefix = n - F.ceil(n * percent / 100.0 - 1e-9).cast("int") + 1
    first = ranked.select("set", n.alias("n"), F.posexplode(F.slice("list", F.lit(1), prefix)).alias("place", "x")).where("x.f > 1")
    first = stored(first.select("set", "n", "place", "x.shingle"), "neardup-prefix")
    # a set without a row here shares none of its first shingles, and so has no link
    central = marked.join(first.groupBy("set").agg(F.min("place").alias("alone")), "set")
    hubs = central.groupBy("key").agg(F.min(F.struct("alone", "set", "component")).alias("h"))
    near = central.join(hubs, "key").where("component != h.component").select(F.col("set").alias("a"), F.col("h.set").alias("b")).distinct()
    links = stored(_verify(_alike_pairs(near, nodes, percent), sets, k, percent), "neardup-central")
    ends = [labels.select(F.col("set").alias(e), F.col("component").alias(f"c{e}")) for e in "ab"]
    merged = connected_components(labels.select(F.col("component").alias("v")).distinct(), links.join(ends[0], "a").join(ends[1], "b").select("ca", "cb"), "ca", "cb")
    labels = labels.withColumnRenamed("component", "v").join(merged, "v").select("set", "component")
    first = stored(first.join(labels, "set"), "neardup-first")
    lengths = first.groupBy("shingle").agg(F.count("*").alias("length"), F.min("component").alias("c"), F.max("component").alias("d")).where("c != d").select("shingle", "length")
    first = first.join(lengths, "shingle")
    short = first.where(F.col("length") <= POSTINGS)
    long = stored(first.where(F.col("length") > POSTINGS).join(nodes.select("set", "bits"), "set"), "neardup-long")
    pairs = _ends(short, "a").join(_ends(short, "b"), "shingle").where("a < b and ca != cb").where(_first_shared(percent)).select("a", "b")
    for more in _long_list_pairs(long, percent):
        pairs = pairs.unionByName(stored(more, "neardup-long-pairs"))
    return links.unionByName(_verify(pairs.distinct(), sets, k, percent))


def _sketched(docs: DataFrame, k: int, percent: int, half: int, miss: float) -> tuple[DataFrame, int, int]:
    """Stored (row_key, doc_id, n, set, halves, bits) rows, half keys a collection, and the seed of the row keys.

    Row keys and set fingerprints have 64 bits; where a second 64-bit hash shows that two different rows or sets have one, another seed is taken.
    """
    for seed in range(1, 16):
        sketch = Sketcher(k, tables(percent / 100, half, miss), half, seed)
        m = sketch.m

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = as_bytes(batch.column(2))
                for lo, hi in blocks(texts):
                    n, prints, others, keys, bits = sketch(texts[lo:hi])
                    bits = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits))
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * (2 * m)), pa.array(signed(keys.ravel())))
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(signed(prints)), flat, bits, part.column(3), pa.array(signed(others))], ["row_key", "doc_id", "n", "set", "halves", "bits", "row_other", "set_other"])

        keyed = docs.select(row_hash(["doc_id", "text"], seed).alias("row_key"), "doc_id", "text", row_hash(["doc_id", "text"], 1000 + seed).alias("row_other"))
        out = T.StructType([T.StructField("row_key", T.LongType()), docs.schema["doc_id"], *[T.StructField(c, kind) for c, kind in (("n", T.LongType()), ("set", T.LongType()), ("halves", T.ArrayType(T.LongType())), ("bits", T.ArrayType(T.LongType())), ("row_other", T.LongType()), ("set_other", T.LongType()))]])
        rows = stored(keyed.mapInArrow(run, out), "neardup-sketches")
        both = [rows.select(F.lit(i).alias("kind"), F.col(x).alias("a"), F.col(y).alias("b")) for i, (x, y) in enumerate((("row_key", "row_other"), ("set", "set_other")))]
        clash = both[0].unionByName(both[1].where("a != 0 or b != 0")).groupBy("kind", "a").agg(F.min("b").alias("x"), F.max("b").alias("y")).where("x != y")
        if clash.isEmpty():
            return rows.drop("row_other", "set_other"), m, seed
        discard(rows)
    raise RuntimeError("no seed tells the rows apart")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, half: int = HALF, miss: float = MISS) -> DataFrame:
    """(row_key, doc_id, n_shingles, component_id, kept) for each document row; row_key is a hash of doc_id and text, different where these are.

    Words are lower-cased in A-Z.  A text of fewer than k words is one shingle; null, empty and
    blank texts have none and are linked with nothing.  Documents with 100 * intersection >= percent * union
    are linked; component_id is the smallest doc_id reachable, itself included; kept says whether that is its own.
    Rows that repeat an id share one component.  A null doc_id is in no component: its component_id is null and
    it is kept.  Equal sets are one node of the graph; other columns of ``docs`` are ignored.
    """
    return _near_duplicates(docs, k, percent, half, miss)[0]


def _near_duplicates(docs: DataFrame, k: int, percent: int, half: int = HALF, miss: float = MISS) -> tuple[DataFrame, int]:
    """``near_duplicates``, and the seed of its row keys."""
    prepare(docs.sparkSession)
    rows, m, seed = _sketched(docs, k, percent, half, miss)
    keyed = docs.select(row_hash(["doc_id", "text"], seed).alias("row_key"), "text")
    linked = rows.where("n > 0 and doc_id is not null")
    # one node for each distinct set; the copies' ids meet again at the end
    nodes = stored(linked.groupBy("set").agg(F.min_by(F.struct("row_key", "n", "halves", "bits"), F.struct("doc_id", "row_key")).alias("r")).select("set", "r.*"), "neardup-nodes")
    halves = nodes.select("set", F.posexplode("halves").alias("i", "h"))
    met = halves.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    both = halves.join(met, "h", "left_semi").groupBy("set").agg(F.collect_list(F.when(F.col("i") < m, F.col("h"))).alias("x"), F.collect_list(F.when(F.col("i") >= m, F.col("h"))).alias("y"))
    keys = both.select("set", F.explode("x").alias("u"), "y").select("set", "u", F.explode("y").alias("v")).select(F.xxhash64("u", "v").alias("key"), "set")
    shared = keys.groupBy("key").agg(F.min("set").alias("hub"), F.count("*").alias("c")).where("c > 1")
    keys = stored(keys.join(shared.select("key", "hub"), "key"), "neardup-keys")
    stars = keys.where("set != hub").select(F.col("set").alias("a"), F.col("hub").alias("b")).distinct()
    stars = stored(_alike_pairs(stars, nodes, percent), "neardup-stars")
    involved = keys.select("set").distinct()
    texts = stored(
        keyed.join(nodes.join(involved, "set", "left_semi").select("set", "row_key", "n"), "row_key").dropDuplicates(["set"]).select("set", "n", "text"), "neardup-texts"
    )
    links = stored(_verify(stars, texts, k, percent), "neardup-links")
    label = connected_components(involved.select(F.col("set").alias("v")), links, "a", "b").select(F.col("v").alias("set"), "component")
    more = stored(_missing_links(keys.select("key", "set"), label, nodes, texts, k, percent), "neardup-more")
    links = links.unionByName(more)
    # rows that repeat a doc_id join their sets
    repeated = linked.groupBy("doc_id").agg(F.min("set").alias("a"), F.max("set").alias("z")).where("a != z")
    twice = linked.join(repeated.select("doc_id", F.col("a").alias("b")), "doc_id").where("set != b").select(F.col("set").alias("a"), "b")
    links = stored(links.unionByName(twice), "neardup-all")
    touched = links.select(F.col("a").alias("v")).union(links.select(F.col("b"))).distinct()
    label = connected_components(touched, links, "a", "b").select(F.col("v").alias("set"), "component")
    ids = linked.groupBy("set").agg(F.min("doc_id").alias("first")).join(label, "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = ids.groupBy("component").agg(F.min("first").alias("component_id"))
    names = ids.select("set", "component").join(least, "component").select("set", "component_id")
    named = rows.withColumn("_s", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set"))).join(names.withColumnRenamed("set", "_s"), "_s", "left")
    out = named.select("row_key", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), seed


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, all columns: the smallest doc_id's, and of its rows the one of least hash.

    Documents without words, and rows without a doc_id, are kept; of equal rows one stays.
    """
    private = fresh(docs.columns, "row_key")[0]
    every, seed = _near_duplicates(docs, k, percent)
    found = every.where("kept")
    own = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("row_key").alias(private)).select(private)
    none = found.where("doc_id is null").select(F.col("row_key").alias(private)).distinct()
    marked = docs.withColumn(private, row_hash(["doc_id", "text"], seed))
    return marked.join(own.union(none), private).dropDuplicates([private]).select(*[F.col(f"`{c}`") for c in docs.columns])
