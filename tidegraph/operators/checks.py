"""Checks of results against the graph they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .programs import LABEL_WITNESS, MinProgram, label_of, vertex_range
from .regions import least_colours


def bellman_check(edges: DataFrame, state: DataFrame, program: MinProgram) -> DataFrame:
    """One row (relaxable, unwitnessed): edges that would improve their destination, and reached vertices but roots without a tight edge."""
    s = state.select(F.col("v").alias("src"), F.col("value").alias("a"))
    d = state.select(F.col("v").alias("dst"), F.col("value").alias("b"))
    ends = edges.select("src", "dst").join(s, "src").join(d, "dst", "left")
    w = F.col("a") + program.weight(F.col("src"), F.col("dst"))
    seen = ends.groupBy("dst").agg(F.sum((F.col("b").isNull() | (w < F.col("b"))).cast("long")).alias("relaxable"), F.max((w == F.col("b")).cast("int")).alias("tight"))
    root = program.is_root(F.col("v"), F.col("value"))
    return state.join(seen.withColumnRenamed("dst", "v"), "v", "full").agg(
        F.coalesce(F.sum("relaxable"), F.lit(0)).cast("long").alias("relaxable"),
        F.coalesce(F.sum((F.col("value").isNotNull() & ~root & (F.coalesce("tight", F.lit(0)) == 0)).cast("long")), F.lit(0)).cast("long").alias("unwitnessed"),
    )


def parent_check(edges: DataFrame, state: DataFrame, program: MinProgram) -> DataFrame:
    """One row (missing_parent, no_edge, not_tight) over the reached vertices but roots."""
    root = program.is_root(F.col("v"), F.col("value"))
    rows = state.where(~root)
    up = state.select(F.col("v").alias("parent"), F.col("value").alias("above"))
    pairs = edges.select(F.col("src").alias("parent"), F.col("dst").alias("v"), F.lit(1).alias("edge")).distinct()
    got = rows.join(up, "parent", "left").join(pairs, ["parent", "v"], "left")
    none = F.col("parent").isNull()
    tight = F.col("above") + program.weight(F.col("parent"), F.col("v")) == F.col("value")
    total = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long").alias(name)
    return got.agg(total(none, "missing_parent"), total(~none & F.col("edge").isNull(), "no_edge"), total(~none & ~F.coalesce(tight, F.lit(False)), "not_tight"))


def label_check(edges: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(v, label, expected): vertices whose label differs from the least vertex that reaches them, spread by a search of its own."""
    pairs = edges.where((F.col("src") != F.col("dst")) & F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)).select("src", "dst")
    want = least_colours(vertex_range(edges.sparkSession, n).withColumn("colour", F.col("v")), pairs).withColumnRenamed("colour", "expected")
    got = labels.select("v", F.col("value").alias("label"))
    return vertex_range(edges.sparkSession, n).join(want, "v").join(got, "v", "left").where(~F.col("label").eqNullSafe(F.col("expected"))).select("v", "label", "expected")


def certified_labels(state: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, label, certified) of label witnesses (v, value, parent): whether each is its own root, or its parent has the same label, is nearer to the root, and has an edge in ``pairs`` to it."""
    mine = state.select("v", F.col("value").alias("mine"), "parent")
    there = pairs.select(F.col("dst").alias("v"), F.col("src").alias("parent"), F.lit(True).alias("edge")).distinct()
    up = state.select(F.col("v").alias("parent"), F.col("value").alias("above"))
    rows = mine.join(there, ["v", "parent"], "left").join(up, "parent", "left")
    proved = F.col("edge") & (label_of(F.col("above")) == label_of(F.col("mine"))) & (F.col("above") < F.col("mine"))
    return rows.select("v", label_of(F.col("mine")).alias("label"), (LABEL_WITNESS.is_root(F.col("v"), F.col("mine")) | F.coalesce(proved, F.lit(False))).alias("certified"))


def reachable_count(state: DataFrame) -> DataFrame:
    return state.where("value is not null").agg(F.count("*").alias("reachable"))


def fingerprint(state: DataFrame) -> DataFrame:
    """One row (rows, total, mark): an order-free fingerprint of (v, value), of values that do not overflow."""
    p = F.lit(1_000_003).cast("long")
    mark = F.pmod((F.col("v") % p) * 7919 + (F.col("value") % p) * 104729 + (F.col("v") % p) * (F.col("value") % p), p)
    return state.where("value is not null").agg(F.count("*").alias("rows"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.sum(mark), F.lit(0)).cast("long").alias("mark"))


def ordered_checksum(state: DataFrame) -> int:
    """FNV-1a over (v, value) in the order of v, folded on the driver a row at a time; for small graphs."""
    h = 0xCBF29CE484222325
    for v, value in state.where("value is not null").select("v", "value").orderBy("v").toLocalIterator():
        for x in (v, value):
            h = (h ^ x) * 0x100000001B3 & 2**64 - 1
    return h
