"""Whole components dealt to tasks: graphs that fall apart are solved side by side, in one exchange instead of rounds.

A part is some weak components together.  A graph has parts if none of its components has more pairs than a task may hold; nothing
crosses between parts, so each is brought to rest by one task (``plans.local``).  A graph with a larger component has none, and goes by rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import local
from ..plans.prefix import running_sum
from ..plans.state import settled
from .components import connected_components

#: Where a caller wants no graph solved in one task, a component may have this share of its pairs.
SHARE = 0.25
#: Pairs and vertices that small components are gathered up to.
GATHER = 250_000


def most_pairs(total: int, small: int | None) -> int:
    """The pairs that one task may hold: LOCAL_PAIRS, or for callers that want rounds (a negative ``small``) a share of the graph."""
    return local.limit(None) if small is None or small >= 0 else min(local.limit(None), int(total * SHARE))


def homes(vertices: DataFrame, pairs: DataFrame, total: int, small: int | None = None) -> DataFrame | None:
    """(v, component, load, part) of all vertices, or None where a component is too large; the pairs' (src, dst) sources load their vertices."""
    most = most_pairs(total, small)
    if most <= 0:
        return None
    component = connected_components(vertices, pairs, small=most)
    load = pairs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("pairs"))
    return _dealt(component.join(load, "v", "left").select("v", "component", (F.coalesce("pairs", F.lit(0)) + 1).alias("load")), most)


def _dealt(loaded: DataFrame, most: int) -> DataFrame | None:
    loaded = settled(loaded)
    sizes = settled(loaded.groupBy("component").agg(F.sum("load").alias("size"), F.count("*").alias("vertices")))
    if (sizes.agg(F.max(F.col("size") - F.col("vertices"))).first()[0] or 0) > most:
        return None
    placed = running_sum(sizes, [F.col("component")], F.col("size"), "before").select("component", F.floor(F.col("before") / min(GATHER, most)).alias("part"))
    return settled(loaded.join(placed, "component").select("v", "component", "load", "part"))


def rehomed(known: DataFrame, gained: DataFrame, total: int, small: int | None = None) -> DataFrame | None:
    """The homes once pairs (src, dst) have come: the same ones, unless a pair leads from one part to another.  Pairs that went leave them as they are."""
    a, b = (known.select(F.col("v").alias(end), F.col("part").alias(f"p{end}")) for end in ("src", "dst"))
    if gained.join(a, "src").join(b, "dst").where("psrc != pdst").isEmpty():
        return known
    most = most_pairs(total, small)
    stars = known.where("v != component").select(F.col("v").alias("src"), F.col("component").alias("dst")).unionByName(gained.select("src", "dst"))
    component = connected_components(known.select("v"), stars, small=most)
    load = gained.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("more"))
    return _dealt(known.select("v", "load").join(component, "v").join(load, "v", "left").select("v", "component", (F.col("load") + F.coalesce("more", F.lit(0))).alias("load")), most)


def homes_of(edges: DataFrame, n: int, total: int, small: int | None = None) -> DataFrame | None:
    """``homes`` of the vertices 0 .. n - 1 of a stored edge table, kept with it: the next solve on the same table finds them."""
    kept = edges.__dict__.setdefault("_homes", {})
    key = n, most_pairs(total, small)
    if key not in kept:
        inside = edges.where((F.col("src") >= 0) & (F.col("src") < n) & (F.col("dst") >= 0) & (F.col("dst") < n))
        kept[key] = homes(edges.sparkSession.range(n).select(F.col("id").alias("v")), inside, total, small)
    return kept[key]


def grown(edges: DataFrame, more: list[DataFrame | None], n: int, total: int, small: int | None = None) -> DataFrame | None:
    """The homes of a stored edge table and of the pairs of some tables besides."""
    home = homes_of(edges, n, total, small)
    for pairs in more:
        if home is not None and pairs is not None:
            home = rehomed(home, pairs.select("src", "dst"), total, small)
    return home
