"""Mixing sources to target weights by capped water-filling.

Each source has a weight; its target is its share of the wanted total, but at most ``epochs``
times its size.  What is above a cap is shared again among the other sources by weight, until
none is above.  A document is then taken whole floor(target / size of its source) times, and
once more if its seeded hash is not after its source's cut, the hash up to which the fraction that is left
reaches.  Cuts are found by histograms of hash prefixes, so what each document does follows from a table with one row
a source, and documents are not moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.prefix import running_sum
from .runtime import discard, fresh, row_hash, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED = 1.5, 2.0, "mix-1"
#: Hex digits of the hash by which a level of the histogram splits its bucket.
DIGITS, LEVELS = 3, 2
#: Sources whose plan, of some hundred bytes each, is sent to all executors; the count is checked.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """The weights in turn, to sources by code point, null last; the table has a row a source."""
    placed = running_sum(sources, [F.col("source").isNull(), F.col("source")], F.lit(1), "_turn")
    return placed.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("_turn", F.lit(len(weights))) + 1).cast("int"))).drop("_turn")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    In the order of cap / weight, the first sources are clamped; the level is the first at which what the caps before leave,
    divided by the weights that are open, is within the next source's cap.  A source of weight 0 or size 0 gets 0.  Where
    even all caps do not reach the wanted total, every source with weight stays at its cap.  An empty table stays empty.
    """
    cap, order = F.lit(float(epochs)) * F.col("source_size"), [F.col("_ratio"), F.col("source")]
    open_ = sources.where((F.col("weight") > 0) & (F.col("source_size") > 0)).withColumn("_ratio", cap / F.col("weight"))
    total = stored(sources.agg((F.lit(float(share)) * F.sum("source_size").cast("double")).alias("total"), F.sum(F.when(F.col("source_size") > 0, F.col("weight"))).alias("weights")), "mix-total")  # one row
    placed = running_sum(running_sum(open_, order, cap, "_clamped", kind="double"), order, F.col("weight"), "_before", kind="double").join(F.broadcast(total))
    level = (F.col("total") - F.col("_clamped")) / (F.col("weights") - F.col("_before"))
    least = placed.agg(F.coalesce(F.min(F.when(level <= F.col("_ratio"), F.struct("_ratio", level.alias("level"))))["level"], F.lit(float("inf"))).alias("_level"))
    full = F.when((F.col("weight") > 0) & (F.col("source_size") > 0), F.least(cap, F.col("_level") * F.col("weight"))).otherwise(0.0)
    return sources.join(F.broadcast(least)).withColumn("target", full).drop("_level")


def _order(seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix_plan(docs: DataFrame, weights: DataFrame | tuple[float, ...], share: float, epochs: float, seed: str) -> DataFrame:
    """(source, source_size, target, whole, more, prefix, cut): how often each source's documents are taken.

    Each ``whole`` times, and once more those whose (order, key) is before ``prefix``, or in it and not after ``cut``; all where ``prefix`` is null and ``more`` is over 0.
    """
    rows = stored(docs.select(row_hash(["doc_id", "text"]).alias("key"), "source", word_count(F.col("text")).alias("size"), _order(seed).alias("order")), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    else:
        sources = cyclic_weights(stored(sources, "mix-source-sizes"), weights)
    sources = stored(sources, "mix-weights")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = stored(
        water_fill(sources, share, epochs)
        .withColumn("whole", F.floor(rate))
        .withColumn("more", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))),
        "mix-sources",
    )
    # the hash prefix at which each source's running sum passes `more`, found by histograms of prefixes
    at = sources.select("source", "more", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        width = DIGITS * level
        own = F.col("source").eqNullSafe(F.col("_s")) & (F.substring("order", 1, width - DIGITS) == F.col("prefix"))
        last = at.withColumnRenamed("source", "_s").withColumnRenamed("before", "_before")
        sums = (
            rows.join(last, own).groupBy("_s", "more", "_before", F.substring("order", 1, width).alias("prefix")).agg(F.sum("size").alias("words"))
        )
        running = F.sum("words").over(Window.partitionBy("_s").orderBy("prefix"))  # at most 16**DIGITS rows a source
        at = stored(
            sums.withColumn("upto", F.col("_before") + running).where(F.col("upto") > F.col("more"))
            .groupBy(F.col("_s").alias("source"), "more")
            .agg(F.min_by(F.struct("prefix", (F.col("upto") - F.col("words")).alias("b")), "prefix").alias("x"))
            .select("source", "more", "x.prefix", F.col("x.b").alias("before")),
            "mix-level",
        )
    # inside that prefix: equal rows in one step, the rest by (order, key)
    width = DIGITS * LEVELS
    last = at.withColumnRenamed("source", "_s").withColumnRenamed("more", "_more")
    edge = rows.join(last, F.col("source").eqNullSafe(F.col("_s")) & (F.substring("order", 1, width) == F.col("prefix"))).groupBy("_s", "_more", "before", "order", "key").agg(F.sum("size").alias("size"))
    start = F.col("before") + F.coalesce(F.sum("size").over(Window.partitionBy("_s").orderBy("order", "key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = edge.withColumn("start", start).where(F.col("start") + F.col("size") / 2.0 <= F.col("_more")).groupBy("_s").agg(F.max(F.struct("order", "key")).alias("cut"))
    found = at.select(F.col("source").alias("_s"), "prefix").join(taken.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left").drop("_t")
    plan = stored(sources.join(found, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "whole", "more", "prefix", "cut"), "mix-plan")
    discard(rows)
    return plan


def _planned(docs: DataFrame, plan: DataFrame, seed: str, *more: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with the plan's columns ``more`` and the times a row is taken, under names that ``docs`` does not have."""
    names = fresh(docs.columns, "_source", *[f"_{c}" for c in more], "_repeats")
    head = F.substring(_order(seed), 1, DIGITS * LEVELS)
    small = plan.count() <= BROADCAST_SOURCES
    # the plan as one struct column, so that its names cannot meet those of the documents
    one = plan.select(F.col("source").alias(names[0]), F.struct(*[c for c in plan.columns if c != "source"]).alias(names[-1]))
    joined = docs.join(F.broadcast(one) if small else one, F.col("source").eqNullSafe(F.col(names[0])))
    p = lambda c: F.col(names[-1])[c]
    inside = F.coalesce(F.struct(_order(seed).alias("order"), row_hash(["doc_id", "text"]).alias("key")) <= p("cut"), F.lit(False))
    extra = F.when(p("more") <= 0, 0).when(p("prefix").isNull() | (head < p("prefix")), 1).when(head == p("prefix"), inside.cast("int")).otherwise(0)
    out = joined.select(*[F.col(f"`{c}`") for c in docs.columns], *[p(c).alias(n) for c, n in zip(more, names[1:-1])], (p("whole") + extra).cast("long").alias(names[-1]))
    return out, names[1:]


def mix_documents(docs: DataFrame, weights: DataFrame | tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats) for each document row.

    ``weights`` is a table (source, weight), or weights given in turn to sources by code point, null
    last.  ``repeats`` is the whole number of times the mix takes the document; within a source, the
    documents of the least hash of (seed, doc_id), and then of text, are taken once more until their words reach the
    fraction of the target that whole repetitions leave (to the nearest document).  A null text has size 0; null sources
    are a source of their own.  Repeated rows are documents of their own; those equal in doc_id, text and source are taken
    equally often.  Equal input, equal result; other columns of ``docs`` are ignored.
    """
    own = docs.select("doc_id", "source", "text")
    out, names = _planned(own, mix_plan(own, weights, share, epochs, seed), seed, "source_size", "target")
    return out.select("doc_id", "source", word_count(F.col("text")).alias("size"), *[F.col(n).alias(c) for n, c in zip(names, ("source_size", "target", "repeats"))])


def take_mix(docs: DataFrame, weights: DataFrame | tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED) -> DataFrame:
    """The rows that the mix takes, all columns, with ``repeats`` (1 at least; a clashing column is replaced).

    Every row stands for itself, repeated ones too; nulls and ties as in ``mix_documents``.
    """
    out, (repeats,) = _planned(docs, mix_plan(docs, weights, share, epochs, seed), seed)
    return out.where(F.col(repeats) > 0).select(*[F.col(f"`{c}`") for c in docs.columns if c != "repeats"], F.col(repeats).alias("repeats"))
