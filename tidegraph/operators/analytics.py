"""Graph statistics, activity windows, cache admission, region analysis and the placement model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import log2_bucket, splitmix64
from ..plans.prefix import running_sum
from ..plans.state import settled
from ..schema import positive
from .programs import vertex_range


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row (nnodes, nedges, avg_degree)."""
    return edges.agg((F.max(F.greatest("src", "dst")) + 1).alias("nnodes"), F.sum("cnt").alias("nedges")).withColumn("avg_degree", F.col("nedges") / F.col("nnodes"))


def degrees(edges: DataFrame, n: int, side: str = "src") -> DataFrame:
    """(v, degree) of all vertices, by either end, occurrences counted."""
    own = edges.groupBy(F.col(side).alias("v")).agg(F.sum("cnt").alias("degree"))
    return vertex_range(edges.sparkSession, n).join(own, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_histogram(degree: DataFrame) -> DataFrame:
    """(bucket, vertices): floor(log2(degree)), -1 for degree 0."""
    return degree.groupBy(log2_bucket(F.col("degree")).alias("bucket")).agg(F.count("*").alias("vertices"))


def degree_summary(degree: DataFrame) -> DataFrame:
    """One row (least, median, p90, largest, total): nearest-rank values at index int(q * (n - 1)); counts by value, so ranks come from few rows."""
    sizes = degree.groupBy("degree").agg(F.count("*").alias("c"))
    n = sizes.agg(F.sum("c").alias("n"))
    placed = running_sum(sizes, [F.col("degree")], F.col("c"), "before").join(F.broadcast(n))
    at = lambda q, name: F.min(F.when(F.col("before") + F.col("c") > F.floor(F.lit(q) * (F.col("n") - 1)), F.col("degree"))).alias(name)
    return placed.agg(F.min("degree").alias("least"), at(0.5, "median"), at(0.9, "p90"), F.max("degree").alias("largest"), F.sum(F.col("degree") * F.col("c")).cast("long").alias("total"))


def geometric_mean(rows: DataFrame, ratio: str, group: str) -> DataFrame:
    return rows.where(F.col(ratio) > 0).groupBy(group).agg(F.exp(F.avg(F.log(ratio))).alias("geometric_mean"), F.median(ratio).alias("median"), F.avg(ratio).alias("mean"))


def activity(hits: DataFrame, window: int = 4) -> DataFrame:
    """(v, batch_id, score) from (v, batch_id, hits): the sum of the last ``window`` batches' hits, each kept in 8 bits."""
    over = Window.partitionBy("v").orderBy("batch_id").rangeBetween(1 - window, 0)
    return hits.select("v", "batch_id", F.sum(F.col("hits") % 256).over(over).alias("score"))


def masked(scores: DataFrame, state: DataFrame) -> DataFrame:
    """Scores set to 0 for vertices that are not reached; other columns stay."""
    rest = [c for c in scores.columns if c not in ("v", "score")]
    return scores.join(state.where("value is not null").select("v", F.lit(True).alias("on")), "v", "left").select("v", *rest, F.when(F.col("on"), F.col("score")).otherwise(0).cast("long").alias("score"))


def admission(scores: DataFrame, degree: DataFrame, capacity: int) -> DataFrame:
    """(v, score, degree, before) of the longest prefix, by score down and id up, whose degrees sum to less than the capacity."""
    positive("capacity", capacity, zero=True)
    rows = scores.join(degree, "v")
    placed = running_sum(rows, [F.desc("score"), F.asc("v")], F.col("degree"), "before")
    return placed.where(F.col("before") + F.col("degree") < capacity).select("v", "score", "degree", "before")


def needs_refresh(published: DataFrame | None, desired: DataFrame) -> bool:
    """Whether a candidate set was never published, misses a desired vertex, or has another size."""
    if published is None:
        return True
    one = desired.select("v").join(published.select("v", F.lit(1).alias("have")), "v", "full_outer")
    row = one.join(desired.select("v", F.lit(1).alias("want")), "v", "left").agg(F.count("want"), F.count("have"), F.count(F.when(F.col("want").isNotNull() & F.col("have").isNull(), 1))).first()
    return row[0] != row[1] or row[2] > 0


def cache_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """One row (admitted, evicted, degree_changed, kept, patch_edges, patch_bytes) from two candidate lists (v, degree); an edge of the patch has 4 bytes."""
    both = previous.select("v", F.col("degree").alias("old")).join(current.select("v", F.col("degree").alias("new")), "v", "full_outer")
    old, new = F.col("old"), F.col("new")
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    came, went, other = old.isNull(), new.isNull(), old.isNotNull() & new.isNotNull() & (old != new)
    return both.agg(
        total(came.cast("long"), "admitted"), total(went.cast("long"), "evicted"), total(other.cast("long"), "degree_changed"),
        total((old.isNotNull() & new.isNotNull() & (old == new)).cast("long"), "kept"), total(F.when(came | other, new).otherwise(0), "patch_edges"), total(F.when(came | other, new * 4).otherwise(0), "patch_bytes"),
    )


def region_edges(edges: DataFrame, region: DataFrame) -> DataFrame:
    """Edges into a region (v) with ``internal``: whether their source is in it too."""
    into = edges.join(region.select(F.col("v").alias("dst")), "dst", "left_semi")
    return into.join(region.select(F.col("v").alias("src"), F.lit(True).alias("in")), "src", "left").select("src", "dst", "cnt", F.coalesce("in", F.lit(False)).alias("internal"))


def region_report(edges: DataFrame, region: DataFrame, state: DataFrame) -> DataFrame:
    """One row (incoming, internal, boundary, boundary_sources, finite_boundary, seeds) of a region to be rebuilt from its boundary.

    A seed is a vertex of the region with a reached boundary source.
    """
    rows = region_edges(edges, region).join(state.where("value is not null").select(F.col("v").alias("src"), F.lit(True).alias("ok")), "src", "left")
    rows = rows.withColumn("finite", ~F.col("internal") & F.coalesce("ok", F.lit(False)))
    z = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return rows.agg(
        z("cnt", "incoming"), z(F.when(F.col("internal"), F.col("cnt")), "internal"), z(F.when(~F.col("internal"), F.col("cnt")), "boundary"),
        F.count_distinct(F.when(~F.col("internal"), F.col("src"))).alias("boundary_sources"), z(F.when(F.col("finite"), F.col("cnt")), "finite_boundary"), F.count_distinct(F.when(F.col("finite"), F.col("dst"))).alias("seeds"),
    )


def partition_edges(edges: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, src, dst, cnt, internal) of every edge whose destination has a region, from (v, region)."""
    to = regions.select(F.col("v").alias("dst"), "region")
    own = regions.select(F.col("v").alias("src"), F.col("region").alias("from"))
    return edges.join(to, "dst").join(own, "src", "left").select("region", "src", "dst", "cnt", F.coalesce(F.col("from") == F.col("region"), F.lit(False)).alias("internal"))


def partition_report(edges: DataFrame, regions: DataFrame, state: DataFrame) -> DataFrame:
    """``region_report`` of every region of (v, region) with an incoming edge, one row each."""
    rows = partition_edges(edges, regions).join(state.where("value is not null").select(F.col("v").alias("src"), F.lit(True).alias("ok")), "src", "left")
    rows = rows.withColumn("finite", ~F.col("internal") & F.coalesce("ok", F.lit(False)))
    z = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return rows.groupBy("region").agg(
        z("cnt", "incoming"), z(F.when(F.col("internal"), F.col("cnt")), "internal"), z(F.when(~F.col("internal"), F.col("cnt")), "boundary"),
        F.count_distinct(F.when(~F.col("internal"), F.col("src"))).alias("boundary_sources"), z(F.when(F.col("finite"), F.col("cnt")), "finite_boundary"), F.count_distinct(F.when(F.col("finite"), F.col("dst"))).alias("seeds"),
    )


def local_ids(vertices: DataFrame) -> DataFrame:
    """(v, local): dense ids from 0 in the order of v."""
    return running_sum(vertices.select("v").distinct(), [F.col("v")], F.lit(1), "local")


def hashed_ranks(occurrences: DataFrame, seed: int) -> DataFrame:
    """``occurrences`` (with ``occ``, a number of each) with ``rank``: SplitMix64 of the number and a seed."""
    return occurrences.withColumn("rank", splitmix64(F.col("occ").bitwiseXOR(F.lit(seed).cast("long"))))


def smallest_ranks(ranked: DataFrame, k: int) -> DataFrame:
    """The k occurrences of smallest rank, as unsigned numbers."""
    unsigned = F.col("rank").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    return ranked.orderBy(unsigned, "occ").limit(k)


def numbered_occurrences(source: DataFrame, base: DataFrame) -> DataFrame:
    """(src, dst, occ, in_base, base_cnt) of every occurrence of a bag, numbered from 0 in the order of (src, dst); the first of each pair are those of the base.

    A base that is not part of the source is an error.
    """
    both = source.join(base.select("src", "dst", F.col("cnt").alias("base_cnt")), ["src", "dst"], "full")
    over = both.where("cnt is null or base_cnt > cnt").limit(1).count()
    if over:
        raise ValueError("the base is not a part of the source")
    placed = running_sum(both.withColumn("base_cnt", F.coalesce("base_cnt", F.lit(0).cast("long"))), [F.col("src"), F.col("dst")], F.col("cnt"), "before")
    each = placed.select("src", "dst", "before", "base_cnt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1)).alias("i"))
    return each.select("src", "dst", (F.col("before") + F.col("i")).alias("occ"), (F.col("i") < F.col("base_cnt")).alias("in_base"), "base_cnt")


def ratio_pools(source: DataFrame, base: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """(pool, src, dst, occ, multiplicity, degree): ``size`` deletes of a base graph, and ``size`` inserts that it does not have.

    Deletes are the base's occurrences of smallest hashed rank.  Inserts are taken from the 2 * size other occurrences of smallest rank:
    those whose pair is in the base are rejected, and those that repeat a pair.  multiplicity counts the pair
    in the base, degree its source.  A pool that falls short is an error; nothing else is drawn instead.
    """
    ranked = hashed_ranks(numbered_occurrences(source, base), seed)
    unsigned = F.col("rank").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    deletes = smallest_ranks(ranked.where("in_base"), size).withColumn("pool", F.lit("delete"))
    drawn = smallest_ranks(ranked.where(~F.col("in_base")), 2 * size).where("base_cnt = 0")  # 2 * size rows
    first = drawn.groupBy("src", "dst").agg(F.min(F.struct(unsigned.alias("u"), "occ")).alias("x"))
    inserts = first.select("src", "dst", "x.*").orderBy("u", "occ").limit(size).select("src", "dst", "occ", F.lit(0).cast("long").alias("base_cnt"), F.lit("insert").alias("pool"))
    pools = settled(deletes.select("src", "dst", "occ", "base_cnt", "pool").unionByName(inserts))
    sizes = {r.pool: r["count"] for r in pools.groupBy("pool").count().collect()}
    for pool in ("delete", "insert"):
        if sizes.get(pool, 0) != size:
            raise ValueError(f"the {pool} pool has {sizes.get(pool, 0)} of {size}")
    degree = base.join(pools.select("src").distinct(), "src", "left_semi").groupBy("src").agg(F.sum("cnt").alias("degree"))
    return pools.join(degree, "src", "left").select("pool", "src", "dst", "occ", F.col("base_cnt").alias("multiplicity"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def rescored(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Scored vertices (v, score, degree) after changes of the same form, one row a vertex; a change to score 0 takes a vertex out."""
    return rows.join(changes.select("v"), "v", "left_anti").unionByName(changes.select("v", "score", "degree")).where("score > 0")


def prefix_counts(rows: DataFrame, capacities: list[int]) -> DataFrame:
    """(capacity, candidates): how many vertices, by score down and id up, have degrees that sum to less than each capacity."""
    placed = running_sum(rows, [F.desc("score"), F.asc("v")], F.col("degree"), "before")
    counts = placed.select(*[F.count(F.when(F.col("before") + F.col("degree") < c, 1)).alias(f"c{i}") for i, c in enumerate(capacities)])  # one row, one pass
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).cast("long").alias("capacity"), F.col(f"c{i}").alias("candidates")) for i, c in enumerate(capacities)])).alias("x")).select("x.*")


def plan_costs(placements: DataFrame, rates: dict[str, float]) -> DataFrame:
    """Each candidate placement (name, cpu_edges, gpu_edges, events, topology_ns, placement_ns, migration_ns, dependency_ns, eligible) with its modelled ns.

    The cost is the slower side's scan plus events, dependencies, topology, placement and migration.
    """
    for name in ("cpu", "gpu", "events"):
        positive(f"rate {name}", rates[name])
    scan = F.greatest(F.col("cpu_edges") / rates["cpu"], F.col("gpu_edges") / rates["gpu"])
    return placements.withColumn("cost", scan + F.col("events") / rates["events"] + F.col("dependency_ns") + F.col("topology_ns") + F.col("placement_ns") + F.col("migration_ns"))


def choose_plan(costs: DataFrame) -> DataFrame:
    """One row: the eligible candidate of least cost, by name where costs tie."""
    return costs.where("eligible").agg(F.min_by("name", F.struct("cost", "name")).alias("chosen"), F.min("cost").alias("cost"))


def majority_component(labels: DataFrame, samples: int = 256, seed: int = 1) -> DataFrame:
    """One row (component, votes): the commonest component of the ``samples`` vertices of smallest hashed rank, the smallest where votes tie."""
    own = smallest_ranks(hashed_ranks(labels.withColumn("occ", F.col("v")), seed), samples)
    return own.groupBy("component").agg(F.count("*").alias("votes")).orderBy(F.desc("votes"), "component").limit(1)
