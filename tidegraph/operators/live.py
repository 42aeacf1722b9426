"""Results kept current under batches, by a two-sided edge index: what a batch costs follows what it changes.

``EdgeIndex`` keeps every edge twice, by source and by destination, each as a ``Layered`` table; both sides are put together, so a
snapshot has both or neither (of a large batch or a new index, a side is written when it is first read).  ``Live`` keeps a program's state by vertex, and ``LiveRanks`` PageRank's.  A batch whose steps stay
under the bounds of ``plans.layers`` is repaired by lookups: a step names its vertices, and one job reads their
rows from the buckets that can hold them.  As soon as a step is larger, the batch is repaired by joins of the same tables, each
on the column that they are bucketed by.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import layers, local
from ..plans.layers import Layered, TooMany, few_rows, local_frame
from ..plans.state import discard, settled
from . import pagerank as ranks
from . import parts
from .programs import MinProgram, refreshed, solve
from .repair import by_blocks, certified_affected, insert, pull_repair
from .store import Step
from .topology import batch_metrics, planned

#: A batch over one pair in so many of the graph's goes by blocks, which read all of it; a smaller one by joins that look for proofs.
SHARE = 64
PLAN = "src bigint, dst bigint, have bigint, adds bigint, dels bigint, gone bigint, ok boolean"


@dataclass(frozen=True)
class EdgeIndex:
    """The evolving edges (src, dst, cnt) by source (``out``) and by destination (``into``)."""

    out: Layered
    into: Layered

    @classmethod
    def of(cls, edges: DataFrame) -> EdgeIndex:
        """An index of edges (src, dst, cnt), one row a pair."""
        rows = edges.select("src", "dst", "cnt")
        out = Layered.of(rows, "src", ("src", "dst"), "cnt")
        return _Later(lambda: out, lambda: Layered.of(out.base, "dst", ("src", "dst"), "cnt", out.size))

    @property
    def size(self) -> int:
        """No fewer than the pairs."""
        return self.out.size + self.out.over_rows + len(self.out.mem)

    def view(self) -> DataFrame:
        return self.out.all()

    def pairs(self, n: int, by: str = "src") -> DataFrame:
        """The pairs with both ends in range, from the side that is bucketed by that end."""
        side = self.out if by == "src" else self.into
        return side.all().where((F.col("src") >= 0) & (F.col("src") < n) & (F.col("dst") >= 0) & (F.col("dst") < n)).select("src", "dst")

    def incoming(self, vertices: list[int]) -> DataFrame:
        """(dst, src, cnt) of some vertices, by a lookup; the result may have any size."""
        found = self.into.lookup(vertices)
        if self.into.over is not None:
            found = found.groupBy("src", "dst").agg(F.max_by("cnt", "_layer").alias("cnt"))
        if self.into.mem:
            near = set(vertices)
            newest = local_frame(found.sparkSession, [r for r in self.into.mem.values() if r[1] in near], self.into.base.schema)
            found = found.select("src", "dst", "cnt").join(F.broadcast(newest.select("src", "dst")), ["src", "dst"], "left_anti").unionByName(newest)
        return found.where("cnt is not null").select("dst", "src", "cnt")

    def homes(self, n: int, *more: DataFrame, small: int | None = -1) -> DataFrame | None:
        """The homes of the pairs and of some more (src, dst), by default of graphs of which no task gets more than a share."""
        return parts.grown(self.out.base, [self.out.changes(), *more], n, self.out.size, small)

    def put(self, rows: list[tuple]) -> EdgeIndex:
        """Both sides with these pairs' counts; None for pairs that are gone."""
        return EdgeIndex(self.out.put(rows), self.into.put(rows))

    def put_all(self, rows: DataFrame) -> EdgeIndex:
        """``put`` of a settled frame of any size; each side is put when it is first read."""
        return _Later(lambda: self.out.put_all(rows), lambda: self.into.put_all(rows))

    def apply(self, batch: DataFrame, n: int) -> IndexStep:
        """One batch of (op 'a' or 'd', src, dst[, cnt]): deletes, then adds."""
        try:
            return self._apply_few(batch, n)
        except TooMany:
            pass
        plan = settled(planned(self.view(), batch, n))
        left, there = F.col("have") - F.col("gone"), lambda c: F.when(c > 0, c).alias("cnt")
        mine = plan.where("ok and (gone > 0 or adds > 0)")
        mid = self.put_all(mine.where("gone > 0").select("src", "dst", there(left)))
        return IndexStep(self, plan, mid, self.put_all(mine.select("src", "dst", there(left + F.col("adds")))))

    def _apply_few(self, batch: DataFrame, n: int) -> IndexStep:
        asked: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
        for r in few_rows(batch):
            asked[r.src, r.dst][r.op == "d"] += r.cnt if "cnt" in batch.columns else 1
        have = {(s, d): c for s, d, c in self.out.get({s for s, _ in asked}, set(asked))}
        plan = []
        for (s, d), (adds, dels) in asked.items():
            ok, had = 0 <= s < n, have.get((s, d), 0)
            plan.append((s, d, had, adds, dels, min(dels, had) if ok else 0, ok))
        mid = self.put([(s, d, had - gone or None) for s, d, had, _, _, gone, _ in plan if gone])
        after = mid.put([(s, d, had - gone + adds) for s, d, had, adds, _, gone, ok in plan if ok and adds])
        from pyspark.sql.types import StructType

        return IndexStep(self, local_frame(batch.sparkSession, plan, StructType.fromDDL(PLAN)), mid, after, plan)


class _Later(EdgeIndex):
    """An index whose sides are made when they are first read: what never looks at one, as ranks at the side by destination or between phases, does not pay for it."""

    def __init__(self, out: Callable[[], Layered], into: Callable[[], Layered]):
        self.__dict__.update(make_out=out, make_into=into)

    @cached_property
    def out(self) -> Layered:
        return self.make_out()

    @cached_property
    def into(self) -> Layered:
        return self.make_into()


@dataclass(frozen=True)
class IndexStep(Step):
    """A batch on an index; ``rows`` is the plan, where it is few rows."""

    rows: list[tuple] | None = None


@dataclass(frozen=True)
class Outcome:
    """After a batch: the next ``live``, the state between its phases, metrics, vertices whose proof was looked for, those without one, rounds, and whether lookups did it."""

    live: Live
    after_delete: Layered
    metrics: DataFrame
    visited: int
    affected: int
    rounds: int
    by_lookups: bool
    step: IndexStep


@dataclass(frozen=True)
class Live:
    """A min program of positive weights on an evolving graph; state rows are (v, value, parent), with the smallest tight source as parent."""

    edges: EdgeIndex
    state: Layered
    program: MinProgram
    n: int

    @classmethod
    def start(cls, edges: DataFrame | EdgeIndex, program: MinProgram, n: int, source: int = 0, small: int | None = None) -> Live:
        if not program.positive:
            raise ValueError("a program without positive weights has no proofs: take LABEL_WITNESS for labels")
        index = edges if isinstance(edges, EdgeIndex) else EdgeIndex.of(edges)
        return cls(index, Layered.of(solve(index.view(), program, n, source, small=small, home=index.homes(n, small=small) if index.size > local.limit(small) else None), "v", ("v",), "value"), program, n)

    def result(self) -> DataFrame:
        return self.state.all()

    def apply(self, batch: DataFrame) -> Outcome:
        """One batch: the state after its deletions and after its additions, each equal to a full recomputation."""
        step = self.edges.apply(batch, self.n)
        if step.rows is not None:
            try:
                return _Lookups(self, step).outcome()
            except TooMany:
                pass
        return self._by_joins(step)

    def _by_joins(self, step: IndexStep) -> Outcome:
        program, n, limit = self.program, self.n, self.n + 1
        state, mid = self.state.all(), self.state
        inside = (F.col("dst") >= 0) & (F.col("dst") < n)
        gone, gained = settled(step.vanished().where(inside)), settled(step.gained(n))
        home = self.edges.homes(n, gained)
        if home is not None:
            return self._by_parts(step, gone, gained, home)
        if step.plan.count() * SHARE > step.after.size:
            after_delete, after, affected, rounds = by_blocks(state, step.mid.pairs(n), gone, gained, program, n, step.after.size, limit)
            lost = affected.count()
            kept = _keyed(after_delete), _keyed(after)
            discard(gone, gained)
            return Outcome(Live(step.after, kept[1], program, n), kept[0], batch_metrics(step.plan), lost, lost, rounds, False, step)
        visited = lost = rounds = 0
        if not gone.isEmpty():
            affected, moved, visited = certified_affected(state, gone, step.mid.pairs(n, "dst"), program, limit)
            lost = affected.count()
            if lost:
                values, rounds = pull_repair(state, affected, step.mid.pairs(n, "dst"), program, limit, small=-1)
            else:
                values = state
            dirty = gone.select(F.col("dst").alias("v")).union(moved)
            mid = _keyed(refreshed(state, values, step.mid.pairs(n, "dst"), dirty, program))
            discard(affected, values)
        last = mid
        if not gained.isEmpty():
            state = mid.all()
            values, more = insert(state, gained, step.after.pairs(n), program, limit, size=step.after.size, small=-1)
            rounds += more
            last = _keyed(refreshed(state, values, step.after.pairs(n, "dst"), gained.select(F.col("dst").alias("v")), program))
            discard(values)
        discard(gone, gained)
        return Outcome(Live(step.after, last, program, n), mid, batch_metrics(step.plan), visited, lost, rounds, False, step)

    def _by_parts(self, step: IndexStep, gone: DataFrame, gained: DataFrame, home: DataFrame) -> Outcome:
        """All that rests on a vanished pair is looked at, part by part, and found anew."""
        program = self.program
        weighted = lambda pairs: pairs.select("src", "dst", program.weight(F.col("src"), F.col("dst")).alias("w"))
        out = settled(local.min_repair(self.state.all(), weighted(step.mid.pairs(self.n, "dst")), gone, weighted(gained), program.rooted, home, program.spread))
        mid, last = (_keyed(out.where(F.col("phase") == i)) for i in (0, 1))
        lost, rounds = out.agg(F.count(F.when(F.col("phase") == 2, 1)), F.max("rounds")).first()
        discard(out, gone, gained)
        return Outcome(Live(step.after, last, program, self.n), mid, batch_metrics(step.plan), lost, lost, rounds or 0, False, step)


def _keyed(state: DataFrame) -> Layered:
    return Layered.of(state.select("v", "value", "parent"), "v", ("v",), "value")


class _Lookups:
    """One small batch on a ``Live``: what is known of its neighbourhood, from lookups."""

    def __init__(self, live: Live, step: IndexStep):
        self.live, self.step, self.cost = live, step, live.program.cost
        self.value: dict[int, int | None] = {}
        self.parent: dict[int, int | None] = {}
        self.changed: set[int] = set()
        self.rounds = 0

    def know(self, vertices: set[int]) -> None:
        """Reads the state of vertices that are not known yet; those without a row are not reached."""
        new = {v for v in vertices if v not in self.value}
        self.value |= dict.fromkeys(new)
        self.parent |= dict.fromkeys(new)
        for v, value, parent in self.live.state.get(new):
            self.value[v], self.parent[v] = value, parent
        if len(self.value) > layers.MEMORY:
            raise TooMany

    def set(self, v: int, value: int | None, parent: int | None) -> None:
        if (value, parent) != (self.value[v], self.parent[v]):
            self.value[v], self.parent[v] = value, parent
            self.changed.add(v)

    def near(self, side: Layered, vertices: set[int]) -> list[tuple[int, int]]:
        n = self.live.n
        return [(s, d) for s, d, _ in side.get(vertices) if s != d and 0 <= s < n and 0 <= d < n]

    def saved(self, state: Layered) -> Layered:
        out = state.put([(v, self.value[v], self.parent[v] if self.value[v] is not None else None) for v in self.changed])
        self.changed = set()
        return out

    def outcome(self) -> Outcome:
        live, n = self.live, self.live.n
        gone = [(s, d) for s, d, had, _, _, g, _ in self.step.rows if g and g == had and 0 <= d < n]
        gained = [(s, d) for s, d, had, adds, _, g, ok in self.step.rows if ok and adds and had == g and 0 <= d < n]
        affected, visited = self.fallen(gone)
        self.pull(affected)
        mid = self.saved(live.state)
        self.insert(gained)
        last = self.saved(mid)
        return Outcome(Live(self.step.after, last, live.program, n), mid, batch_metrics(self.step.plan), visited, len(affected), self.rounds, True, self.step)

    def fallen(self, gone: list[tuple[int, int]]) -> tuple[set[int], int]:
        """The vertices without a proof, and how many were looked at; see ``certified_affected``."""
        self.know({d for _, d in gone})
        suspects, affected, visited = {d for s, d in gone if self.parent[d] == s and self.value[d] is not None}, set(), 0
        while suspects:
            visited, self.rounds = visited + len(suspects), self.rounds + 1
            into = self.near(self.step.mid.into, suspects)
            self.know({s for s, _ in into})
            proved: dict[int, int] = {}
            for s, d in into:
                if s not in affected and self.value[s] is not None and self.value[s] + self.cost(s, d) == self.value[d]:
                    proved[d] = min(s, proved.get(d, s))
            for v, s in proved.items():
                self.set(v, self.value[v], s)
            fallen = suspects - proved.keys()
            affected |= fallen
            out = self.near(self.step.mid.out, fallen)
            self.know({d for _, d in out})
            suspects = {d for s, d in out if self.parent[d] == s and d not in affected and self.value[d] is not None}
        return affected, visited

    def pull(self, affected: set[int]) -> None:
        """Gives the affected vertices the least values that the remaining edges allow."""
        if not affected:
            return
        self.rounds += 1
        program, into = self.live.program, self.near(self.step.mid.into, affected)
        self.know({s for s, _ in into})
        after, out = dict.fromkeys(affected), defaultdict(list)
        queue = [] if program.rooted else [(v * program.spread, v) for v in affected]
        for s, d in into:
            if s in affected:
                out[s].append(d)
            elif self.value[s] is not None:
                queue.append((self.value[s] + self.cost(s, d), d))
        heapq.heapify(queue)
        while queue:
            value, v = heapq.heappop(queue)
            if after[v] is None:
                after[v] = value
                for d in out[v]:
                    if after[d] is None:
                        heapq.heappush(queue, (value + self.cost(v, d), d))
        best: dict[int, int] = {}
        for s, d in into:
            value = after[s] if s in affected else self.value[s]
            if value is not None and after[d] == value + self.cost(s, d):
                best[d] = min(s, best.get(d, s))
        for v, value in after.items():
            self.set(v, value, None if not program.rooted and value == v * program.spread else best.get(v))

    def insert(self, gained: list[tuple[int, int]]) -> None:
        """Relaxes the new pairs, then whatever improved, round by round."""
        self.know({x for p in gained for x in p})
        active, todo, improved = set(), [p for p in gained if p[0] != p[1]], set()
        used = list(todo)
        while todo:
            self.rounds += 1
            active = set()
            for s, d in todo:
                if self.value[s] is not None:
                    value = self.value[s] + self.cost(s, d)
                    if self.value[d] is None or value < self.value[d]:
                        self.set(d, value, s)
                        active.add(d)
            improved |= active
            todo = self.near(self.step.after.out, active) if active else []
            self.know({d for _, d in todo})
            used += todo
        # parents are the smallest tight sources: of improved vertices anew, of others where a tight edge is new
        into = self.near(self.step.after.into, improved) if improved else []
        self.know({s for s, _ in into})
        tight: dict[int, int] = {}
        for s, d in [*into, *used]:
            if self.value[s] is not None and self.value[d] == self.value[s] + self.cost(s, d):
                tight[d] = min(s, tight.get(d, s))
        for d, s in tight.items():
            if d in improved or self.parent[d] is not None and s < self.parent[d]:
                self.set(d, self.value[d], s)


@dataclass(frozen=True)
class LiveRanks:
    """PageRank on an evolving graph; state rows are (v, rank, residual) of all vertices."""

    edges: EdgeIndex
    state: Layered
    n: int
    epsilon: float = ranks.EPSILON
    max_rounds: int = ranks.MAX_ROUNDS
    rounds: int = 0
    by_lookups: bool = False

    @classmethod
    def start(cls, edges: DataFrame | EdgeIndex, n: int, epsilon: float = ranks.EPSILON, max_rounds: int = ranks.MAX_ROUNDS, small: int | None = None) -> LiveRanks:
        index = edges if isinstance(edges, EdgeIndex) else EdgeIndex.of(edges)
        state, rounds, _ = ranks.ranked(index.view(), n, epsilon, max_rounds, small)
        return cls(index, Layered.of(state, "v", ("v",), "rank"), n, epsilon, max_rounds, rounds)

    def result(self) -> DataFrame:
        return self.state.all()

    def apply(self, batch: DataFrame) -> LiveRanks:
        """A batch: the touched sources' old messages are taken back and new ones sent, then residuals are passed on from where they are over epsilon."""
        step = self.edges.apply(batch, self.n)
        if step.rows is not None:
            try:
                return self._by_lookups(step)
            except TooMany:
                pass
        touched = settled(step.touched())
        mended = settled(ranks.amend(self.state.all(), self.edges.view(), step.after.view(), touched, self.n))
        state, rounds, _ = ranks.converge(mended, step.after.view(), self.n, self.epsilon, self.max_rounds, step.after.size)
        kept = Layered.of(state, "v", ("v",), "rank")
        discard(touched, mended, state)
        return LiveRanks(step.after, kept, self.n, self.epsilon, self.max_rounds, rounds)

    def _sent(self, rows: list[tuple], amount: Callable[[int], float], into: dict[int, float]) -> None:
        """Adds what sources with these edge rows send along them."""
        degree: dict[int, int] = defaultdict(int)
        for s, _, c in rows:
            degree[s] += c
        for s, d, c in rows:
            if 0 <= d < self.n:
                into[d] += ranks.DAMPING * amount(s) * c / degree[s]

    def _by_lookups(self, step: IndexStep) -> LiveRanks:
        touched = {r[0] for r in step.rows if r[6]}
        known: dict[int, list[float]] = {}

        def know(vertices: set[int]) -> None:
            known.update({v: [rank, residual] for v, rank, residual in self.state.get(vertices - known.keys())})

        know(touched)
        change: dict[int, float] = defaultdict(float)
        self._sent(self.edges.out.get(touched), lambda s: -known[s][0], change)
        self._sent(step.after.out.get(touched), lambda s: known[s][0], change)
        rounds = 0
        while True:
            know(set(change))
            for v, x in change.items():
                known[v][1] += x
            sending = {v: r[1] for v, r in known.items() if abs(r[1]) > self.epsilon}
            if not sending or rounds >= self.max_rounds:
                break
            rounds += 1
            change = defaultdict(float)
            self._sent(step.after.out.get(set(sending)), sending.__getitem__, change)
            for v, x in sending.items():
                known[v] = [known[v][0] + x, known[v][1] - x]
        return LiveRanks(step.after, self.state.put([(v, *r) for v, r in known.items()]), self.n, self.epsilon, self.max_rounds, rounds, True)
