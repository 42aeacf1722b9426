"""A weighted score index: how many vertices, by score down and id up, fit a capacity, without sorting them for each question.

Vertices with a score are the leaves of a tree of sums, ordered by score down and id up; a node has the degrees and the number of the leaves
below it.  The nodes are a ``Layered`` table keyed by their parents, so a prefix count reads one node's children a level, and
a new score rewrites the nodes of two paths.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.layers import Layered

#: A level has BITS of the order's bits: LEVELS * BITS are 10 of the score, which is at most LARGEST, and 32 of the id.
BITS, LEVELS, LARGEST = 6, 7, 1023


def _code(level: int, x: int) -> int:
    return level << 48 | x


def _place(score: int, v: int) -> int:
    return (LARGEST - score) << 32 | v


def _nodes(rows: DataFrame, sign: int = 1) -> DataFrame:
    """(parent, node, total, n) of all levels, from (v, score, degree); rows without a score are in no node."""
    rows = rows.where("score > 0")
    place = F.shiftleft((F.lit(LARGEST) - F.col("score")).cast("long"), 32).bitwiseOR(F.col("v"))
    at = lambda level: F.shiftright("place", BITS * (LEVELS - level)).bitwiseOR(F.lit(level << 48).cast("long"))
    both = F.array(*[F.struct(at(level - 1).alias("parent"), at(level).alias("node")) for level in range(1, LEVELS + 1)])
    each = rows.select(place.alias("place"), "degree").select("degree", F.explode(both).alias("x"))
    return each.groupBy("x.parent", "x.node").agg((F.sum("degree") * sign).cast("long").alias("total"), (F.count("*") * sign).alias("n"))


@dataclass(frozen=True)
class ScoreIndex:
    nodes: Layered

    @classmethod
    def of(cls, rows: DataFrame) -> ScoreIndex:
        """The index of (v, score, degree); scores are 0 to LARGEST, degrees at least 0."""
        return cls(Layered.of(_nodes(rows), "parent", ("node",), "total"))

    def count(self, capacity: int) -> int:
        """How many of the first vertices have degrees that sum to less than the capacity; a lookup a level at most."""
        taken, used, parent = 0, 0, _code(0, 0)
        for _ in range(LEVELS):
            after = None
            for _, node, total, n in sorted(self.nodes.get([parent]), key=lambda r: r[1]):
                if used + total >= capacity:
                    after = node
                    break
                taken, used = taken + n, used + total
            if after is None:
                break
            parent = after
        return taken

    def update(self, changes: list[tuple[int, tuple[int, int] | None, tuple[int, int] | None]]) -> ScoreIndex:
        """New (score, degree) of some vertices: (v, old, new), where None or a score of 0 is not in the index.  TooMany if these are too many for lookups."""
        more: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
        for v, old, new in changes:
            for sign, x in ((-1, old), (1, new)):
                if x is not None and x[0] > 0:
                    place = _place(x[0], v)
                    for level in range(1, LEVELS + 1):
                        pair = _code(level - 1, place >> BITS * (LEVELS - level + 1)), _code(level, place >> BITS * (LEVELS - level))
                        more[pair][0] += sign * x[1]
                        more[pair][1] += sign
        more = {k: x for k, x in more.items() if x != [0, 0]}
        have = {(p, node): (total, n) for p, node, total, n in self.nodes.get({p for p, _ in more}, {(node,) for _, node in more})}
        rows = []
        for (p, node), (total, n) in more.items():
            was = have.get((p, node), (0, 0))
            rows.append((p, node, was[0] + total if was[1] + n else None, was[1] + n))
        return ScoreIndex(self.nodes.put(rows))

    def update_all(self, old: DataFrame, new: DataFrame) -> ScoreIndex:
        """``update`` of any number of vertices: (v, score, degree) before and after; equal rows may be left out of both."""
        more = _nodes(new).unionByName(_nodes(old, -1)).groupBy("parent", "node").agg(F.sum("total").alias("dt"), F.sum("n").alias("dn")).where("dt != 0 or dn != 0")
        now = more.join(self.nodes.all().select("node", "total", "n"), "node", "left")
        n = F.coalesce("n", F.lit(0)) + F.col("dn")
        return ScoreIndex(self.nodes.put_all(now.select("parent", "node", F.when(n > 0, F.coalesce("total", F.lit(0)) + F.col("dt")).alias("total"), n.alias("n"))))
