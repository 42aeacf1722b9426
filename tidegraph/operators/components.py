"""Weakly connected components by joins: large-star and small-star, alternated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import local
from ..plans.state import discard, settled


def connected_components(vertices: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int | None = None, small: int = -1) -> DataFrame:
    """(v, component) for each vertex; component is the smallest vertex id of its weakly connected component.

    ``vertices`` has one column ``v``; edge ends outside of it are ignored in the result.  Each
    round is aggregations and joins on the edges.  Before the rounds each task replaces its own edges by stars that connect the same
    vertices, as they are read and again by ranges of vertices, so rounds have about an edge a vertex.  Rounds end when the edges are stars: every vertex has one edge, to a
    vertex without one; the driver reads one row a round.  At most ``small`` such edges are joined in one task.
    """
    u, v = F.col(src), F.col(dst)
    own = local.contracted(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).cast("long").alias("a"), F.least(u, v).cast("long").alias("b")))
    own = settled(local.contracted(own.repartitionByRange("a")).distinct())
    size = own.count()
    if size <= small:
        return local.components(vertices, own.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    limit = size + 2 if max_rounds is None else max_rounds  # every round but the last joins an edge's vertices to a smaller one
    for _ in range(limit):
        roots = own.select(F.col("b").alias("a")).distinct().withColumn("root", F.lit(1))
        row = own.groupBy("a").agg(F.count("*").alias("n")).join(roots, "a", "left").agg(F.max("n"), F.max("root")).first()
        if row[1] is None and (row[0] or 0) <= 1:
            break
        both = own.union(own.select("b", "a"))
        # large star: larger neighbours are joined to the least of the neighbourhood
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # small star: smaller neighbours and the vertex itself are joined to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b"))).distinct()
        old, own = own, settled(joined)
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return vertices.select("v").join(own, F.col("v") == F.col("a"), "left").select("v", F.coalesce("b", "v").alias("component"))


#: Where components that lost an edge hold over this share of the vertices, all are joined again.
MOST = 0.5


def repair_components(labels: DataFrame, pairs: DataFrame, lost: DataFrame, gained: DataFrame, small: int = -1, stay: DataFrame | None = None) -> DataFrame:
    """(v, component) after a batch, from the labels before it, the pairs after it, and the pairs (src, dst) that it took and brought.

    Only components that lost an edge are joined again, on their own pairs; where these are most of the graph, all are, and no pair has to look
    up its component.  Then the components that new pairs connect are merged, each standing for all of its vertices.  ``stay`` are the pairs but
    those it brought, where the caller has them: in range, and between vertices with a label.
    """
    suspect = settled(lost.select(F.col("src").alias("v")).join(labels, "v").select("component").distinct())
    members = settled(labels.join(suspect, "component", "left_semi"))
    if stay is not None and members.count() > MOST * labels.count():
        now = settled(connected_components(labels.select("v"), stay, small=small))
    else:
        inner = (pairs.join(gained, ["src", "dst"], "left_anti") if stay is None else stay).join(members.select(F.col("v").alias("src")), "src", "left_semi")
        again = connected_components(members.select("v"), inner, small=small)
        now = settled(labels.join(suspect, "component", "left_anti").select("v", "component").unionByName(again))
    ends = [now.select(F.col("v").alias(end), F.col("component").alias(name)) for end, name in (("src", "a"), ("dst", "b"))]
    links = settled(gained.join(ends[0], "src").join(ends[1], "dst").where("a != b").select("a", "b").distinct())
    merged = connected_components(links.select(F.col("a").alias("v")).union(links.select("b")).distinct(), links, "a", "b", small=small)
    return now.join(merged.withColumnRenamed("component", "least").withColumnRenamed("v", "component"), "component", "left").select("v", F.coalesce("least", "component").alias("component"))
