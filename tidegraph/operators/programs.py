"""Monotone vertex programs as Column factories, and their fixed point."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Weight, endpoint_weight, no_weight, unit_weight
from ..plans import local
from ..plans.blocks import FAR, Blocks
from ..plans.state import discard, settled
from . import parts

#: Rounds after which the improvements of a run are merged into its base state.
COMPACT = 8


@dataclass(frozen=True)
class MinProgram:
    """A program whose vertices keep the least of ``source value + weight(src, dst)``.

    ``rooted`` programs start from one vertex with value 0; the others from all, each with its own id times ``spread``.
    ``cost`` is the weight of two plain numbers.  Where weights are ``positive``, parents are trees: a vertex's value is proved by
    the chain of its parents.
    """

    name: str
    weight: Weight
    rooted: bool = True
    cost: Callable[[int, int], int] = lambda src, dst: 1
    spread: int = 1
    positive: bool = True

    def start(self, vertices: DataFrame, source: int | None = None) -> DataFrame:
        """Seed rows (v, value, parent)."""
        none = F.lit(None).cast("long").alias("parent")
        if self.rooted:
            return vertices.where(F.col("v") == source).select("v", F.lit(0).cast("long").alias("value"), none)
        return vertices.select("v", (F.col("v") * self.spread).alias("value"), none)

    def is_root(self, v: Column, value: Column) -> Column:
        return value == 0 if self.rooted else value == v * self.spread


#: Hops of a label witness; a label of 32 bits and they fit into a long.
HOPS = 1 << 31
BFS = MinProgram("bfs", unit_weight)
SSSP = MinProgram("sssp", endpoint_weight, cost=lambda src, dst: (src + dst) % 128 + 1)
MIN_LABEL = MinProgram("min_label", no_weight, rooted=False, cost=lambda src, dst: 0, positive=False)
#: The least label with its distance from the label's root, as label * HOPS + hops: each vertex rests on a parent nearer to the root, so
#: labels that travel on cycles are proved as distances are.
LABEL_WITNESS = MinProgram("label_witness", unit_weight, rooted=False, spread=HOPS)


def label_of(value: Column) -> Column:
    """The label of a witness value."""
    return F.shiftright(value, 31)


def vertex_range(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("v"))


def best(rows: DataFrame) -> DataFrame:
    """(v, value, parent): the least value of each vertex, and of its sources the smallest; a missing parent comes first."""
    key = F.struct("value", F.coalesce("parent", F.lit(-1).cast("long")).alias("p"))
    low = rows.groupBy("v").agg(F.min(key).alias("x"))
    return low.select("v", "x.value", F.when(F.col("x.p") >= 0, F.col("x.p")).alias("parent"))


def candidates(frontier: DataFrame, edges: DataFrame, program: MinProgram) -> DataFrame:
    """Messages along the out-edges of the frontier, reduced at their destinations before and after the shuffle."""
    sent = frontier.withColumnRenamed("v", "src").withColumnRenamed("value", "sent").select("src", "sent").join(edges.select("src", "dst"), "src")
    return best(sent.select(F.col("dst").alias("v"), (F.col("sent") + program.weight(F.col("src"), F.col("dst"))).alias("value"), F.col("src").alias("parent")))


def improvements(found: DataFrame, known: DataFrame) -> DataFrame:
    """The candidates that are better than what is known; known rows are only those of candidates' vertices."""
    current = known.join(found.select("v"), "v", "left_semi").groupBy("v").agg(F.min("value").alias("now"))
    return found.join(current, "v", "left").where("now is null or value < now").select("v", "value", "parent")


def propagate(
    known: DataFrame, frontier: DataFrame, edges: DataFrame, program: MinProgram, max_rounds: int, inside: DataFrame | None = None, bucket: int | None = None, size: int | None = None, small: int | None = None, home: DataFrame | None = None
) -> tuple[DataFrame, int]:
    """Runs the program from a frontier of better rows until no vertex improves; (state, rounds).

    Only improved vertices send.  A round's work follows its frontier: the known rows are filtered by
    the candidates, the improvements are kept as a small table of their own, and the state
    is rewritten every COMPACT rounds.  With ``inside`` (v), only those vertices may improve.  With
    ``bucket``, rounds send from the lowest range of values of that width, which saves repeated improvements on
    long paths and takes more rounds.  A graph of at most ``small`` edges (``size``, or else counted here) is solved in one task,
    one whose components have a ``home`` (see ``parts``) by a task for each part.
    """
    if home is not None or (edges.count() if size is None else size) <= local.limit(small):
        own = edges if inside is None else edges.join(inside.select(F.col("v").alias("dst")), "dst", "left_semi")
        weighted = own.select("src", "dst", program.weight(F.col("src"), F.col("dst")).alias("w"))
        out = settled(local.min_fixed_point(known, frontier, weighted, program.rooted, home, program.spread))
        return out.select("v", "value", "parent"), out.agg(F.max("rounds")).first()[0] or 0
    frontier = settled(frontier)
    base, later, rounds, waiting = known, [], 0, None
    while not frontier.isEmpty():
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"{program.name} did not converge in {max_rounds} rounds")
        later.append(frontier)
        if len(later) >= COMPACT:
            old, done = base, later
            base, later = settled(best(_union([base, *later]))), []
            if old is not known:
                discard(old)
            if not bucket:
                discard(*done[:-1])
        active = frontier
        if bucket:  # only the lowest bucket sends; the other better rows wait
            pending = frontier if waiting is None else settled(best(frontier.unionByName(waiting)))
            lowest = pending.agg(F.min("value")).first()[0] // bucket
            near = F.floor(F.col("value") / bucket) == lowest
            active, waiting = pending.where(near), pending.where(~near)
        found = candidates(active, edges, program)
        if inside is not None:
            found = found.join(inside.select("v"), "v", "left_semi")
        frontier = settled(improvements(found, _union([base, *later])))
        if waiting is not None and frontier.isEmpty() and not waiting.isEmpty():
            frontier, waiting = settled(waiting), None
    return settled(best(_union([base, *later]))), rounds


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def in_range(edges: DataFrame, n: int) -> DataFrame:
    """(src, dst) of the edges with both ends in range."""
    return edges.where((F.col("src") >= 0) & (F.col("src") < n) & (F.col("dst") >= 0) & (F.col("dst") < n)).select("src", "dst")


def in_range_pairs(edges: DataFrame, n: int) -> DataFrame:
    """Edges with both ends in range, as distinct pairs."""
    return in_range(edges, n).distinct()


def weighted(pairs: DataFrame, program: MinProgram) -> DataFrame:
    """(src, dst, w) without loops, which improve nothing and prove nothing."""
    return pairs.where("src != dst").select("src", "dst", program.weight(F.col("src"), F.col("dst")).alias("w"))


def by_source(edges: DataFrame, n: int) -> DataFrame:
    """``in_range_pairs``, ordered by source and kept for the rounds: a round's join by source does not move them."""
    return settled(in_range_pairs(edges, n), key="src")


def clamp(source: int, n: int) -> int:
    if n <= 0:
        raise ValueError("the graph has no vertex")
    return min(max(source, 0), n - 1)


def solve(edges: DataFrame, program: MinProgram, n: int, source: int | None = 0, max_rounds: int | None = None, bucket: int | None = None, small: int | None = None, home: DataFrame | None = None) -> DataFrame:
    """(v, value, parent) of every reached vertex of 0 .. n - 1; unreached vertices have no row.

    A source out of range is clamped.  The parent is the smallest tight source.
    """
    return solved(edges, program, n, source, max_rounds, bucket, small, home)[0]


def solved(edges: DataFrame, program: MinProgram, n: int, source: int | None = 0, max_rounds: int | None = None, bucket: int | None = None, small: int | None = None, home: DataFrame | None = None) -> tuple[DataFrame, int]:
    """``solve``, and its rounds: in one task, by parts, or by blocks where a component is large; there with ``bucket`` by ranges of values."""
    spark = edges.sparkSession
    seeds = program.start(vertex_range(spark, n), clamp(source or 0, n) if program.rooted else None)
    empty, limit = seeds.limit(0), max_rounds or (n + 1) * (2 if bucket else 1)
    pairs, size = in_range_pairs(edges, n), edges.count()
    if size <= local.limit(small):  # parents come with the values
        return propagate(empty, seeds, pairs, program, limit, size=size, small=small)
    home = parts.homes_of(edges, n, size, small) if home is None else home
    if home is not None:
        return propagate(empty, seeds, in_range(edges, n), program, limit, size=size, home=home)
    if not bucket:
        blocks = Blocks.of(spark, n, size)
        links = blocks.links(weighted(pairs, program), "w")
        rows, rounds = blocks.least(blocks.state(seeds, ("value",), FAR, True), links, limit)
        out = blocks.rooted(rows, links, program.rooted, program.spread)
        discard(links, rows)
        return out, rounds
    pairs = by_source(edges, n)
    state, rounds = propagate(empty, seeds, pairs, program, limit, bucket=bucket, size=size, small=small)
    out = settled(with_parents(state, pairs, program))
    discard(pairs, state)
    return out, rounds


def with_parents(state: DataFrame, pairs: DataFrame, program: MinProgram, only: DataFrame | None = None) -> DataFrame:
    """The state, or its vertices ``only`` (v), with each vertex's smallest tight source as its parent; roots have none.

    Labels have no order among equal values, so for programs without a root any same-label source counts.
    """
    every = state
    state = state if only is None else state.join(only, "v", "left_semi")
    target = state.select(F.col("v").alias("dst"), F.col("value").alias("own"))
    tight = (
        pairs.where("src != dst").join(every.select(F.col("v").alias("src"), "value"), "src").join(target, "dst")
        .where(F.col("value") + program.weight(F.col("src"), F.col("dst")) == F.col("own")).groupBy("dst").agg(F.min("src").alias("tight"))
    )
    root = program.is_root(F.col("v"), F.col("value"))
    return state.join(tight, F.col("v") == F.col("dst"), "left").select("v", "value", F.when(~root, F.col("tight")).alias("parent"))


def all_vertices(state: DataFrame, n: int) -> DataFrame:
    """A row for every vertex; value and parent are null where it is not reached."""
    return vertex_range(state.sparkSession, n).join(state, "v", "left").select("v", "value", "parent")


def refreshed(old: DataFrame, values: DataFrame, pairs: DataFrame, touched: DataFrame, program: MinProgram) -> DataFrame:
    """New values (v, value) with parents: only vertices that changed, the ones behind them, and the destinations ``touched`` (v) look theirs up again."""
    now, was = values.select("v", F.col("value").alias("now")), old.select("v", F.col("value").alias("was"))
    changed = settled(now.join(was, "v", "full").where(~F.col("now").eqNullSafe(F.col("was"))).select("v"))
    behind = pairs.join(changed.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("dst").alias("v"))
    dirty = settled(changed.union(behind).union(touched.select("v")).distinct())
    into = pairs.join(dirty.select(F.col("v").alias("dst")), "dst", "left_semi")
    fresh = with_parents(values.select("v", "value"), into, program, dirty)
    kept = values.select("v", "value").join(dirty, "v", "left_anti").join(old.select("v", "parent"), "v", "left").select("v", "value", "parent")
    return kept.unionByName(fresh)
