"""Incremental repair of monotone programs: deletions, then insertions, of one batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import depends_on, label_depends
from ..plans import local
from ..plans.blocks import FAR, Blocks
from ..plans.state import discard, settled
from . import parts
from .programs import MinProgram, best, candidates, improvements, propagate, refreshed, weighted
from .store import EdgeStore, Step
from .topology import batch_metrics


def tree_affected(state: DataFrame, gone: DataFrame, max_rounds: int, small: int | None = None) -> DataFrame:
    """(v): vertices whose chain of tight parents uses a vanished edge; one join a level of the tree.

    Weights are positive, so parent links form a tree, and every vertex outside keeps its value.
    """
    if state.count() <= local.limit(small):
        return settled(local.tree_closure(state, gone))
    new = settled(state.join(gone.select(F.col("dst").alias("v"), "src"), "v").where(depends_on(F.col("src"), F.col("parent"))).select("v").distinct())
    found, rounds = [new], 0
    while not new.isEmpty():
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError("invalidation did not end")
        new = settled(state.join(new.withColumnRenamed("v", "parent"), "parent", "left_semi").select("v"))
        found.append(new)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return settled(out.distinct())


def label_affected(state: DataFrame, gone: DataFrame, pairs: DataFrame, max_rounds: int) -> DataFrame:
    """(v): vertices whose label lost its last path from the label's root, on the edges that are left.

    Labels travel on cycles for nothing, so parents prove nothing.  For each label of a vanished
    edge that can have carried it, its group is searched again from its root, inside the group;
    members that are not met are affected.
    """
    label = state.select("v", F.col("value").alias("label"))
    ends = gone.join(label.withColumnRenamed("v", "src").withColumnRenamed("label", "a"), "src").join(label.withColumnRenamed("v", "dst").withColumnRenamed("label", "b"), "dst")
    suspect = settled(ends.where(label_depends(F.col("src"), F.col("dst"), F.col("a"), F.col("b"))).select(F.col("a").alias("label")).distinct())
    group = settled(label.join(suspect, "label", "left_semi").select("v", "label"))
    met = settled(group.where(F.col("v") == F.col("label")))
    seen, new, rounds = [met], met, 0
    while not new.isEmpty():
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError("the label search did not end")
        reached = seen[0]
        for part in seen[1:]:
            reached = reached.unionByName(part)
        to = new.select(F.col("v").alias("src"), "label").join(pairs, "src").select(F.col("dst").alias("v"), "label").distinct()
        new = settled(to.join(group, ["v", "label"], "left_semi").join(reached, ["v", "label"], "left_anti"))
        seen.append(new)
        if len(seen) > 8:
            seen = [settled(reached.unionByName(new))]
    reached = seen[0]
    for part in seen[1:]:
        reached = reached.unionByName(part)
    return settled(group.join(reached, ["v", "label"], "left_anti").select("v"))


def certified_affected(state: DataFrame, gone: DataFrame, into: DataFrame, program: MinProgram, max_rounds: int, budget: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(affected (v), moved (v), vertices looked at): whose value lost its proof, for a program of positive weights.

    A vertex is suspect when the edge from its parent has vanished, or its parent is affected.  It is certified by another
    tight source that is not affected, which becomes its parent (it has moved); else it is affected, and what rests on it is
    suspect.  A source's value is less than its vertex's, so proofs have no cycle, and one that falls later makes its
    vertices suspect again.  After ``budget`` vertices none is certified any more: all that rests on an affected one is.
    ``into`` are the pairs that are left.
    """
    own = state.select("v", "value", "parent")
    suspects = settled(own.join(gone.select(F.col("dst").alias("v"), F.col("src").alias("parent")), ["v", "parent"], "left_semi").select("v", "value"))
    affected, moved, visited, rounds = [], own.limit(0).select("v", "parent"), 0, 0
    while count := suspects.count():
        rounds, visited = rounds + 1, visited + count
        if rounds > max_rounds:
            raise RuntimeError("certification did not end")
        bad = _union(affected) if affected else own.limit(0).select("v")
        if budget is None or visited <= budget:
            tight = into.where("src != dst").join(suspects.withColumnRenamed("v", "dst"), "dst").join(own.select(F.col("v").alias("src"), F.col("value").alias("at")), "src")
            tight = tight.where(F.col("at") + program.weight(F.col("src"), F.col("dst")) == F.col("value")).join(bad.withColumnRenamed("v", "src"), "src", "left_anti")
            proved = settled(tight.groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent")))
        else:
            proved = own.limit(0).select("v", "parent")
        fallen = settled(suspects.join(proved, "v", "left_anti").select("v"))
        old, moved = moved, settled(moved.join(suspects, "v", "left_anti").unionByName(proved))
        discard(old, suspects, proved)
        affected.append(fallen)
        rest = fallen.withColumnRenamed("v", "parent")
        resting = own.join(rest, "parent", "left_semi").select("v", "parent").join(moved.select("v"), "v", "left_anti").unionByName(moved.join(rest, "parent", "left_semi").select("v", "parent"))
        suspects = settled(own.select("v", "value").join(resting, "v", "left_semi").join(_union(affected), "v", "left_anti"))
    discard(suspects)
    return settled(_union(affected).distinct()) if affected else own.limit(0).select("v"), moved.select("v"), visited


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def pull_repair(state: DataFrame, affected: DataFrame, pairs: DataFrame, program: MinProgram, max_rounds: int, bucket: int | None = None, small: int | None = None) -> tuple[DataFrame, int]:
    """Resets the affected vertices and gives them the least values the remaining edges allow; (state, rounds).

    Their first values come from unaffected in-neighbours, and for rootless programs from their own id; after that
    only affected vertices propagate, and only to each other.
    """
    kept = settled(state.join(affected, "v", "left_anti").select("v", "value", "parent"))
    into = settled(pairs.join(affected.select(F.col("v").alias("dst")), "dst", "left_semi"))
    start = candidates(kept.join(into.select(F.col("src").alias("v")).distinct(), "v", "left_semi"), into, program)
    if not program.rooted:
        start = best(start.unionByName(program.start(affected)))
    return propagate(kept, start, into, program, max_rounds, bucket=bucket, small=small)


def insert(state: DataFrame, added: DataFrame, pairs: DataFrame, program: MinProgram, max_rounds: int, bucket: int | None = None, size: int | None = None, small: int | None = None) -> tuple[DataFrame, int]:
    """Relaxes each added edge once, then propagates what improved; (state, rounds)."""
    first = candidates(state.join(added.select(F.col("src").alias("v")).distinct(), "v", "left_semi"), added, program)
    return propagate(state, improvements(first, state), pairs, program, max_rounds, bucket=bucket, size=size, small=small)


def by_blocks(state: DataFrame, stay: DataFrame, gone: DataFrame, gained: DataFrame, program: MinProgram, n: int, size: int, max_rounds: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(state after the deletes, after the adds, the affected vertices (v), rounds) of a large batch on a graph of any shape, for a program of positive weights.

    What hangs on a vanished pair is found along the parents, then the values of all others are passed on, over the pairs that stay and then over all.
    """
    blocks = Blocks.of(state.sparkSession, n, size)
    links = blocks.links(weighted(stay, program), "w")
    hit = settled(state.join(gone.select(F.col("dst").alias("v"), F.col("src").alias("parent")), ["v", "parent"], "left_semi").select("v", F.lit(0).cast("long").alias("value")))
    kept, mid, lost, rounds = state.select("v", "value"), state, hit.select("v"), 0
    if not hit.isEmpty():
        if n <= local.limit(None):
            lost = settled(local.tree_closure(state, gone))
        else:
            tree = blocks.links(state.where("parent is not null").select(F.col("parent").alias("src"), F.col("v").alias("dst"), F.lit(0).cast("long").alias("w")), "w")
            rows, rounds = blocks.least(blocks.state(hit, ("value",), FAR, True), tree, max_rounds)
            lost = blocks.reached(rows)
            discard(tree, rows)
        kept = kept.join(lost, "v", "left_anti")
        if not program.rooted:
            kept = kept.unionByName(program.start(lost).select("v", "value"))
        rows, more = blocks.least(blocks.state(kept, ("value",), FAR), links, max_rounds, every=True)
        mid, rounds = blocks.rooted(rows, links, program.rooted, program.spread), rounds + more
    else:
        rows = settled(blocks.state(kept, ("value",), FAR), "blocks")
    last = mid
    if not gained.isEmpty():
        links = blocks.links(weighted(gained, program), "w", onto=links)
        rows, more = blocks.least(rows, links, max_rounds, every=True)
        last, rounds = blocks.rooted(rows, links, program.rooted, program.spread), rounds + more
    discard(rows, links)
    return mid, last, lost, rounds


@dataclass(frozen=True)
class Repaired:
    """The outcome of a batch: the new edges, the state after either phase, metrics, the affected vertices, and the rounds of all propagation."""

    store: EdgeStore
    after_delete: DataFrame
    state: DataFrame
    metrics: DataFrame
    affected: DataFrame
    rounds: int
    step: Step

    @property
    def edges(self) -> DataFrame:
        return self.store.view()


def update(
    edges: DataFrame | EdgeStore, state: DataFrame, batch: DataFrame, program: MinProgram, n: int, max_rounds: int | None = None, bucket: int | None = None, small: int | None = None
) -> Repaired:
    """One batch: the state after its deletions, and after its additions, each equal to a full recomputation.

    ``state`` holds the reached vertices (v, value, parent) with tight parents, as ``solve`` gives it; ``edges`` is a bag, or
    the ``store`` of the batch before.  The edge table is not rewritten: pairs of the batch go to the store's overlay, deletions
    look at what hangs on a vanished pair, additions start from the new pairs, and parents are looked up where something changed.
    ``bucket`` orders the rounds of repair and insertion by ranges of values.
    """
    store = EdgeStore.of(edges)
    step = store.apply(batch, n)
    return _repair(store, step, step.vanished(), step.mid.pairs(n), step.gained(n), state, program, n, max_rounds, bucket, small)


def step_homes(store: EdgeStore, step: Step, n: int, small: int | None) -> DataFrame | None:
    """The homes of all pairs before and after a step; those of the store's base are found once, and pass on to a new base."""
    home = parts.grown(store.base, [store.overlay, step.gained(n)], n, store.rows, small)
    if home is not None and step.after.base is not store.base:
        step.after.base.__dict__.setdefault("_homes", {})[n, parts.most_pairs(step.after.rows, small)] = home
    return home


def _repair(store: EdgeStore, step: Step, gone: DataFrame, stay: DataFrame, gained: DataFrame, state: DataFrame, program: MinProgram, n: int, max_rounds: int | None, bucket: int | None, small: int | None) -> Repaired:
    limit = max_rounds or (n + 1) * (2 if bucket else 1)
    metrics = batch_metrics(step.plan)
    size = step.after.size + step.mid.size
    home = None if size <= local.limit(small) else step_homes(store, step, n, small)
    if home is not None or size <= local.limit(small):
        costs = lambda pairs: pairs.select("src", "dst", program.weight(F.col("src"), F.col("dst")).alias("w"))
        out = settled(local.min_repair(state, costs(stay), gone, costs(gained), program.rooted, home, program.spread))
        phase = lambda i: out.where(F.col("phase") == i).select("v", "value", "parent")
        rounds = out.where("phase = 1").agg(F.max("rounds")).first()[0] or 0
        return Repaired(step.after, phase(0), phase(1), metrics, phase(2).select("v"), rounds, step)
    if program.positive and not bucket:
        mid, last, lost, rounds = by_blocks(state, stay, gone, gained, program, n, step.after.size, limit)
        return Repaired(step.after, mid, last, metrics, lost, rounds, step)
    gone = settled(gone)
    affected = tree_affected(state, gone, limit, small) if program.rooted else label_affected(state, gone, stay, limit)
    rounds, mid = 0, state
    if not affected.isEmpty():
        values, rounds = pull_repair(state, affected, stay, program, limit, bucket, small)
        mid = settled(refreshed(state, values, stay, gone.select(F.col("dst").alias("v")), program))
    pairs, added = step.after.pairs(n), settled(gained)
    values, more = insert(mid, added, pairs, program, limit, bucket, step.after.size, small)
    last = settled(refreshed(mid, values, pairs, added.select(F.col("dst").alias("v")), program))
    return Repaired(step.after, mid, last, metrics, affected, rounds + more, step)


def final_state_update(edges: DataFrame | EdgeStore, state: DataFrame, batch: DataFrame, program: MinProgram, n: int, max_rounds: int | None = None, small: int | None = None) -> Repaired:
    """One repair for a whole batch, without the state between its phases: only pairs absent from the final graph invalidate.

    ``after_delete`` is the state on the pairs that stay, an intermediate without a graph of its own.
    """
    store = EdgeStore.of(edges)
    step = store.apply(batch, n)
    lost = step.lost()
    # first on the pairs that stay, so that an added pair is relaxed by all it can improve, in the insertion
    stay = store.pairs(n).join(lost, ["src", "dst"], "left_anti")
    fresh = step.gained(n).join(step.vanished(), ["src", "dst"], "left_anti")
    return _repair(store, step, lost, stay, fresh, state, program, n, max_rounds, None, small)
