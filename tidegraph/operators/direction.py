"""Breadth-first levels that choose a direction each round, on a two-sided edge index.

A round either pushes, from the frontier along its out-edges, or pulls, where the vertices not yet reached look for a frontier vertex among their
in-edges.  Pushing reads the frontier's edges; pulling reads those of what is left, which are fewer once a large part is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.state import discard, settled
from .live import EdgeIndex
from .programs import clamp, vertex_range

#: Pull when the frontier's out-edges are more than this share of the in-edges of the vertices not yet reached.
SHARE = 0.5


@dataclass(frozen=True)
class Round:
    direction: str
    frontier: int
    #: Edges that either direction would have read.
    push_edges: int
    pull_edges: int


def _observed(df: DataFrame, **sums: str) -> tuple[DataFrame, dict[str, int]]:
    """The settled frame, its rows, and sums of its columns, by the job that writes it."""
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()]))
    return out, seen.get


def bfs_by_direction(edges: EdgeIndex, n: int, source: int = 0, share: float = SHARE) -> tuple[DataFrame, list[Round]]:
    """((v, value, parent) of every reached vertex, the rounds); the parent is the smallest source one hop nearer."""
    pairs, back = edges.pairs(n, "src").where("src != dst"), edges.pairs(n, "dst").where("src != dst")
    out = pairs.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("out"))
    into = back.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("into"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    degrees = vertex_range(edges.out.base.sparkSession, n).join(out, "v", "left").join(into, "v", "left").select("v", zero("out"), zero("into"))
    left, rest = _observed(degrees, pull="into")
    root = left.where(F.col("v") == clamp(source, n))
    frontier, now = _observed(root.select("v", F.lit(0).cast("long").alias("value"), F.lit(None).cast("long").alias("parent"), "out", "into"), push="out", pull="into")
    levels, rounds, pull = [frontier], [], rest["pull"] - now["pull"]
    while now["rows"]:
        old, left = left, settled(left.join(frontier.select("v"), "v", "left_anti"))
        discard(old)
        direction = "pull" if now["push"] > share * pull else "push"
        rounds.append(Round(direction, now["rows"], now["push"], pull))
        sending = frontier.select(F.col("v").alias("src"))
        if direction == "push":
            met = sending.join(pairs, "src").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
        else:
            met = left.select(F.col("v").alias("dst")).join(back, "dst").join(sending, "src", "left_semi").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
        found = left.join(met, "v").select("v", F.lit(len(rounds)).cast("long").alias("value"), "parent", "out", "into")
        frontier, now = _observed(found, push="out", pull="into")
        pull -= now["pull"]
        levels.append(frontier)
    discard(left)
    state = levels[0]
    for level in levels[1:]:
        state = state.unionByName(level)
    done = settled(state.select("v", "value", "parent"))
    discard(*levels)
    return done, rounds
