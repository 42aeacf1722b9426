"""Topology of an evolving directed multigraph as bags of edges (src, dst, cnt).

A batch deletes first and adds then, whatever the order of its records.  A delete takes away
one occurrence; one without a match is counted and has no effect.  The vertices are
0 .. n - 1 for good: requests whose source is outside are not applied, destinations are not checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import fnv1a
from ..plans.prefix import running_sum


@dataclass(frozen=True)
class Applied:
    """The outcome of a batch: the edges after either phase, changes, requests by source, and metrics."""

    after_delete: DataFrame
    after_add: DataFrame
    effective: DataFrame
    metrics: DataFrame
    touched: DataFrame


def in_range(src: Column, n: int) -> Column:
    return (src >= 0) & (src < n)


def requests(batch: DataFrame) -> DataFrame:
    """(src, dst, adds, dels): a batch of (op, src, dst[, cnt]) as one bag row for each pair."""
    cnt = F.col("cnt") if "cnt" in batch.columns else F.lit(1).cast("long")
    return batch.groupBy("src", "dst").agg(
        F.sum(F.when(F.col("op") == "a", cnt).otherwise(0)).cast("long").alias("adds"),
        F.sum(F.when(F.col("op") == "d", cnt).otherwise(0)).cast("long").alias("dels"),
    )


def planned(edges: DataFrame, batch: DataFrame, n: int) -> DataFrame:
    """(src, dst, have, adds, dels, gone, ok) of the requested pairs: bag deletion clipped to what is there."""
    asked = requests(batch)
    touched = edges.join(asked.select("src", "dst"), ["src", "dst"], "left_semi")  # broadcasts the batch where it is small
    have = F.coalesce("cnt", F.lit(0).cast("long"))
    ok = in_range(F.col("src"), n)
    return asked.join(touched, ["src", "dst"], "left").select(
        "src", "dst", have.alias("have"), "adds", "dels", F.when(ok, F.least("dels", have)).otherwise(0).cast("long").alias("gone"), ok.alias("ok")
    )


def batch_metrics(plan: DataFrame) -> DataFrame:
    """One row: additions, deletions, touched_sources, changed_sources, missing_deletes, invalid_additions, max_source_work.

    A touched source is any source of a request; it is changed if an occurrence of its row was deleted or added.
    max_source_work is the most requests of one source.
    """
    changed = F.col("ok") & ((F.col("gone") > 0) | (F.col("adds") > 0))
    by_source = plan.groupBy("src").agg(
        F.sum("adds").alias("a"), F.sum("dels").alias("d"), F.max(changed.cast("int")).alias("changed"), F.max(F.col("ok").cast("int")).alias("ok"),
        F.sum(F.col("dels") - F.col("gone")).alias("missing"), F.sum(F.when(~F.col("ok"), F.col("adds")).otherwise(0)).alias("invalid"),
    )
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return by_source.agg(
        zero(F.sum("a"), "additions"), zero(F.sum("d"), "deletions"), zero(F.sum("ok"), "touched_sources"), zero(F.sum("changed"), "changed_sources"),
        zero(F.sum("missing"), "missing_deletes"), zero(F.sum("invalid"), "invalid_additions"), zero(F.max(F.col("a") + F.col("d")), "max_source_work"),
    )


def effective_changes(plan: DataFrame) -> DataFrame:
    """(src, dst, delta) of what a batch does: deleted occurrences below 0, added ones above; a pair may have both."""
    both = F.array(F.struct((-F.col("gone")).alias("delta")), F.struct(F.when(F.col("ok"), F.col("adds")).otherwise(0).cast("long").alias("delta")))
    return plan.select("src", "dst", F.explode(both).alias("x")).select("src", "dst", "x.delta").where("delta != 0")


def merge_counts(*bags: DataFrame) -> DataFrame:
    """The signed sum of bags, without zeros."""
    total = bags[0].select("src", "dst", "cnt")
    for bag in bags[1:]:
        total = total.unionByName(bag.select("src", "dst", "cnt"))
    return total.groupBy("src", "dst").agg(F.sum("cnt").alias("cnt")).where("cnt != 0")


def apply_batch(edges: DataFrame, batch: DataFrame, n: int) -> Applied:
    """Applies a batch of (op 'a' or 'd', src, dst[, cnt]); a large edge table is read once, and not rewritten here.

    The new bags are unions of the old one and the batch's changes, summed by pair.
    """
    plan = planned(edges, batch, n)
    deleted = merge_counts(edges, plan.where("gone > 0").select("src", "dst", (-F.col("gone")).alias("cnt")))
    added = merge_counts(edges, plan.select("src", "dst", (F.when(F.col("ok"), F.col("adds")).otherwise(0) - F.col("gone")).cast("long").alias("cnt")).where("cnt != 0"))
    touched = plan.where("ok").select("src").distinct()
    return Applied(deleted, added, effective_changes(plan), batch_metrics(plan), touched)


def changed_sources(deletes: DataFrame, adds: DataFrame) -> DataFrame:
    """The union of both phases' sources."""
    return deletes.select("src").union(adds.select("src")).distinct()


def incoming(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """The incoming rows (dst, src, cnt) of a vertex set (v)."""
    return edges.join(vertices.select(F.col("v").alias("dst")).distinct(), "dst", "left_semi").select("dst", "src", "cnt")


def digests(edges: DataFrame) -> DataFrame:
    """(src, degree, pairs, multiset): an order-free fingerprint of each source's row, of partial sums."""
    return edges.groupBy("src").agg(
        F.sum("cnt").alias("degree"), F.count("*").alias("pairs"), F.sum(F.pmod(F.col("dst") * 40503 + F.col("cnt") * 7919, F.lit(1_000_003).cast("long")) * F.col("cnt")).alias("multiset")
    )


def ordered_digests(occurrences: DataFrame) -> DataFrame:
    """(src, degree, fnv) of occurrences (src, seq, dst), in the order of seq; a row of neighbours is one array, as large as a degree."""
    rows = occurrences.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("seq", "dst"))).alias("r"))
    return rows.select("src", F.size("r").cast("long").alias("degree"), fnv1a(F.transform("r", lambda x: x["dst"])).alias("fnv"))


def topology_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst, delta): where two bags differ; empty if they are equal."""
    return merge_counts(left, right.withColumn("cnt", -F.col("cnt"))).withColumnRenamed("cnt", "delta")


def undirected(edges: DataFrame) -> DataFrame:
    """(src <= dst, cnt) where cnt is the larger of both directions' counts; a loop counts once each."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.groupBy(low.alias("lo"), high.alias("hi")).agg(
        F.sum(F.when(F.col("src") <= F.col("dst"), F.col("cnt")).otherwise(0)).alias("f"), F.sum(F.when(F.col("src") > F.col("dst"), F.col("cnt")).otherwise(0)).alias("r")
    ).select(F.col("lo").alias("src"), F.col("hi").alias("dst"), F.greatest("f", "r").alias("cnt"))


def dependency_log(initial: DataFrame, batches: DataFrame) -> DataFrame:
    """(src, dst, born, retired) of every occurrence: retired is 0 while it lives, epochs are batch_id + 1.

    A delete retires the live occurrence that was born last; without one it has no effect.
    Occurrences and deletes of one pair are matched as brackets are, in one bounded row of its events.
    """
    start = initial.select("src", "dst", F.lit(0).cast("long").alias("epoch"), F.lit(1).alias("kind"), F.col("cnt"))
    later = batches.groupBy("src", "dst", (F.col("batch_id") + 1).alias("epoch"), F.when(F.col("op") == "d", 0).otherwise(1).alias("kind")).agg(F.sum("cnt").alias("cnt"))
    events = start.unionByName(later.select("src", "dst", "epoch", "kind", "cnt"))
    rows = events.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("epoch", "kind", "cnt"))).alias("events"))
    empty = "struct<live:array<struct<born:bigint,cnt:bigint>>,done:array<struct<born:bigint,retired:bigint,cnt:bigint>>>"
    zero = F.from_json(F.lit('{"live":[],"done":[]}'), empty)

    def step(acc: Column, e: Column) -> Column:
        live, done = acc["live"], acc["done"]
        born = F.concat(live, F.array(F.struct(e["epoch"].alias("born"), e["cnt"].alias("cnt"))))
        # how many of each live group go: the delete's count less what later groups can give
        total = F.aggregate(live, F.lit(0).cast("long"), lambda a, x: a + x["cnt"])
        after = lambda i: F.aggregate(F.slice(live, i + 2, F.size(live)), F.lit(0).cast("long"), lambda a, x: a + x["cnt"])
        gone = lambda x, i: F.greatest(F.lit(0).cast("long"), F.least(x["cnt"], F.least(e["cnt"], total) - after(i)))
        marked = F.transform(live, lambda x, i: F.struct(x["born"].alias("born"), x["cnt"].alias("cnt"), gone(x, i).alias("gone")))
        left = F.transform(F.filter(marked, lambda x: x["cnt"] > x["gone"]), lambda x: F.struct(x["born"].alias("born"), (x["cnt"] - x["gone"]).alias("cnt")))
        ended = F.transform(F.filter(marked, lambda x: x["gone"] > 0), lambda x: F.struct(x["born"].alias("born"), e["epoch"].alias("retired"), x["gone"].alias("cnt")))
        return F.when(e["kind"] == 1, F.struct(born.alias("live"), done.alias("done"))).otherwise(F.struct(left.alias("live"), F.concat(done, ended).alias("done"))).cast(empty)

    log = rows.select("src", "dst", F.aggregate("events", zero, step).alias("x"))
    live = F.transform("x.live", lambda x: F.struct(x["born"].alias("born"), F.lit(0).cast("long").alias("retired"), x["cnt"].alias("cnt")))
    out = log.select("src", "dst", F.explode(F.concat(F.col("x.done"), live)).alias("o"))
    return out.select("src", "dst", "o.born", "o.retired", "o.cnt")


def as_of(log: DataFrame, epoch: int) -> DataFrame:
    """The bag (src, dst, cnt) at an epoch."""
    alive = (F.col("born") <= epoch) & ((F.col("retired") == 0) | (F.col("retired") > epoch))
    return log.where(alive).groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def latest_versions(offers: DataFrame, degrees: DataFrame) -> DataFrame:
    """(src, version, degree): the newest offered version of each source, with its degree (0 where it has no edge)."""
    newest = offers.groupBy("src").agg(F.max("version").alias("version"))
    return newest.join(degrees, "src", "left").select("src", "version", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def ordered_survivors(base: DataFrame, source: DataFrame) -> DataFrame:
    """How many of each pair's base occurrences are matched in the source: (src, dst, base_cnt, matched).

    The i-th occurrence of a pair in ``base`` is matched with the i-th in ``source``, so the lesser count is.
    """
    right = source.select("src", "dst", F.col("cnt").alias("_have"))
    return base.join(right, ["src", "dst"], "left").select("src", "dst", F.col("cnt").alias("base_cnt"), F.least("cnt", F.coalesce("_have", F.lit(0).cast("long"))).alias("matched"))


def is_subsequence(base: DataFrame, source: DataFrame, key: str = "src") -> DataFrame:
    """(src, base_rows, matched): by source, how far its ordered base row is a subsequence of its ordered source row.

    Both are (src, seq, dst), matched greedily from the left: the row of one vertex is folded in the order of seq, one array a vertex.
    A base row is a subsequence if all of its rows are matched.
    """
    rows = [x.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "dst"))), lambda y: y["dst"]).alias(name)) for x, name in ((base, "b"), (source, "s"))]
    zero = F.lit(0)
    at = F.aggregate(F.coalesce("s", F.array().cast("array<bigint>")), zero, lambda i, y: F.when((i < F.size("b")) & (F.get("b", i) == y), i + 1).otherwise(i))
    return rows[0].join(rows[1], key, "left").select(key, F.size("b").cast("long").alias("base_rows"), at.cast("long").alias("matched"))


def undirected_batches(initial: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph and its batches (batch_id, op, src, dst[, cnt]) as undirected ones: both directions of each pair, at most once, loops dropped.

    A pair is there after a batch if either direction is; an add of a pair that is there, and a delete of one that is not, change
    nothing and are left out.  The batches of one pair are folded in order, deletes before adds.
    """
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    start = initial.where("src != dst").select(low, high).distinct()
    asked = batches.where("src != dst").groupBy(low, high, F.col("batch_id").cast("long").alias("batch_id"), F.when(F.col("op") == "d", 0).otherwise(1).alias("kind")).agg(F.lit(1).alias("one")).drop("one")
    events = start.select("src", "dst", F.lit(-1).cast("long").alias("batch_id"), F.lit(1).alias("kind")).unionByName(asked)
    rows = events.groupBy("src", "dst").agg(F.sort_array(F.collect_list(F.struct("batch_id", "kind"))).alias("events"))  # two events a batch at most
    acc = "struct<there:boolean,done:array<struct<batch_id:bigint,kind:int>>>"

    def step(x: Column, e: Column) -> Column:
        on = e["kind"] == 1
        return F.when(x["there"] == on, x).otherwise(F.struct(on.alias("there"), F.concat(x["done"], F.array(e)).alias("done")).cast(acc))

    zero = F.from_json(F.lit('{"there":false,"done":[]}'), acc)
    kept = rows.select("src", "dst", F.explode(F.aggregate("events", zero, step)["done"]).alias("e")).where("e.batch_id >= 0")
    one = kept.select(F.col("e.batch_id").alias("batch_id"), F.when(F.col("e.kind") == 1, "a").otherwise("d").alias("op"), "src", "dst")
    both = one.unionByName(one.select("batch_id", "op", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return start.union(start.select("dst", "src")).withColumn("cnt", F.lit(1).cast("long")), both.withColumn("cnt", F.lit(1).cast("long"))


def segments(edges: DataFrame, parts: int) -> DataFrame:
    """(v, segment): contiguous ranges of source ids with about equal numbers of edges."""
    degree = edges.groupBy("src").agg(F.sum("cnt").alias("degree"))
    total = degree.agg(F.sum("degree").alias("total"))
    ranges = running_sum(degree, [F.col("src")], F.col("degree"), "before")
    return ranges.join(F.broadcast(total)).select(F.col("src").alias("v"), F.floor(F.col("before") * parts / F.col("total")).cast("int").alias("segment"))
