"""Fixed points of graphs, or of whole parts of graphs, whose size is known to be small, inside tasks.

A round of the distributed loops costs some jobs, whatever its frontier.  Where the counted edges
stay below LOCAL_PAIRS, one task runs the same rounds over arrays.  Of larger graphs, those without a component over
the limit are solved by many tasks side by side, each with some whole components (``homes``: (v, part), see ``operators.parts``); the others take
the loops.  All give the same rows; tests run each operator these ways.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges (24 bytes each) that one task may hold.
LOCAL_PAIRS = 2_000_000


def limit(small: int | None) -> int:
    """The edges up to which one task solves: LOCAL_PAIRS, unless the caller says otherwise."""
    return LOCAL_PAIRS if small is None else small


def _rows(df: DataFrame, kind: int, a: str, b: str, c: str, numeric: str = "bigint") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(a).cast("bigint").alias("a"), F.expr(b).cast(numeric).alias("b"), F.expr(c).cast(numeric).alias("c"))


def _run(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, homes: DataFrame | None) -> DataFrame:
    """``run`` over all rows (kind, a, b, c) in one task, or with ``homes`` over the rows of each part, by the home of ``a``."""
    if homes is None:
        return rows.coalesce(1).mapInArrow(run, schema)

    def own(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(iter(table.select(["kind", "a", "b", "c"]).to_batches())))

    return rows.join(homes.hint("shuffle_hash").select(F.col("v").alias("a"), "part"), "a").groupBy("part").applyInArrow(own, schema)


def _gather(batches: Iterator[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
    got: dict[int, list[list[np.ndarray]]] = {}
    for batch in batches:
        kind = batch.column(0).to_numpy(zero_copy_only=False)
        cols = [pa.compute.fill_null(batch.column(i), -1).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
        for k in np.unique(kind):
            got.setdefault(int(k), []).append([c[kind == k] for c in cols])
    return {k: [np.concatenate(x) for x in zip(*parts)] for k, parts in got.items()}


def _adjacency(ids: np.ndarray, src: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(src, kind="stable")
    return order, np.searchsorted(src[order], np.arange(len(ids) + 1))


def _out(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places, in source order, of the out-edges of the vertices ``at``."""
    n = first[at + 1] - first[at]
    return np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())


class _Search:
    """Values of vertices over one set of edges, improved until none changes."""

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        self.ids = ids
        s, d = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        order, self.first = _adjacency(ids, s)
        self.src, self.dst, self.w = s[order], d[order], w[order]
        self.rounds = 0

    def improve(self, value: np.ndarray, v: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Takes each vertex's least value where it is better; the places that changed."""
        order = np.lexsort((x, v))
        v, x = v[order], x[order]
        head = np.concatenate(([True], v[1:] != v[:-1])) if len(v) else np.empty(0, bool)
        v, x = v[head], x[head]
        ok = x < value[v]
        value[v[ok]] = x[ok]
        return v[ok]

    def run(self, value: np.ndarray, new: np.ndarray) -> None:
        while len(new):
            self.rounds += 1
            e = _out(self.first, new)
            at = np.repeat(new, self.first[new + 1] - self.first[new])
            new = self.improve(value, self.dst[e], value[at] + self.w[e])

    def parents(self, value: np.ndarray, rooted: bool, spread: int = 1) -> np.ndarray:
        """The smallest tight source of each reached vertex but roots; -1 for none."""
        far = np.iinfo(np.int64).max
        on = (value[self.src] < far) & (self.src != self.dst)
        s, d = self.src[on], self.dst[on]
        ok = value[s] + self.w[on] == value[d]
        parent = np.full(len(self.ids), len(self.ids))
        np.minimum.at(parent, d[ok], s[ok])
        root = value == 0 if rooted else value == self.ids * spread
        none = (parent == len(self.ids)) | root | (value == far)
        return np.where(none, -1, self.ids[np.minimum(parent, max(len(self.ids) - 1, 0))] if len(self.ids) else parent)


def _state_batch(ids: np.ndarray, value: np.ndarray, parent: np.ndarray, phase: int, rounds: int) -> pa.RecordBatch:
    on = value < np.iinfo(np.int64).max
    n = int(on.sum())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[on]), pa.array(value[on]), pa.array(parent[on], mask=parent[on] < 0), pa.array(np.full(n, phase, np.int32)), pa.array(np.full(n, rounds))], ["v", "value", "parent", "phase", "rounds"])


_STATE = "v bigint, value bigint, parent bigint, phase int, rounds bigint"


def min_fixed_point(known: DataFrame, frontier: DataFrame, weighted: DataFrame, rooted: bool, homes: DataFrame | None = None, spread: int = 1) -> DataFrame:
    """(v, value, parent, phase, rounds) from known rows, better rows of a frontier, and edges (src, dst, w); parents are the smallest tight sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        none = [np.empty(0, np.int64)] * 3
        (kv, kx, _), (fv, fx, _), (src, dst, w) = (got.get(k, none) for k in (0, 1, 2))
        ids = np.unique(np.concatenate([kv, fv, src, dst]))
        search = _Search(ids, src, dst, w)
        value = np.full(len(ids), np.iinfo(np.int64).max)
        place = lambda x: np.searchsorted(ids, x)
        search.improve(value, place(kv), kx)
        search.improve(value, place(fv), fx)
        search.run(value, np.unique(place(fv)))
        yield _state_batch(ids, value, search.parents(value, rooted, spread), 0, search.rounds)

    rows = _rows(known, 0, "v", "value", "parent").union(_rows(frontier, 1, "v", "value", "parent")).union(_rows(weighted, 2, "src", "dst", "w"))
    return _run(rows, run, _STATE, homes)


def min_repair(state: DataFrame, edges: DataFrame, gone: DataFrame, added: DataFrame, rooted: bool, homes: DataFrame | None = None, spread: int = 1) -> DataFrame:
    """(v, value, parent, phase, rounds): the state after a batch's deletes (phase 0), after its adds (phase 1), and the affected vertices (phase 2).

    ``edges`` (src, dst, w) are those after the deletes, ``gone`` (src, dst) vanished pairs, ``added`` (src, dst, w) new ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        none = [np.empty(0, np.int64)] * 3
        (v, x, p), (src, dst, w), (gs, gd, _), (a_src, a_dst, a_w) = (got.get(k, none) for k in range(4))
        ids = np.unique(np.concatenate([v, src, dst, a_src, a_dst]))
        far = np.iinfo(np.int64).max
        value, parent = np.full(len(ids), far), np.full(len(ids), -1)
        at = np.searchsorted(ids, v)
        value[at], parent[at] = x, p
        search = _Search(ids, src, dst, w)
        hit = _tree_hit(ids, parent, gs, gd) if rooted or spread > 1 else _label_hit(ids, value, gs, gd, search)
        hit &= value < far
        lost = np.flatnonzero(hit)
        if len(lost):
            value[hit] = far
            if not rooted:
                value[hit] = ids[hit] * spread
            into = hit[search.dst] & ~hit[search.src] & (value[search.src] < far)
            new = search.improve(value, search.dst[into], value[search.src[into]] + search.w[into])
            search.run(value, new if rooted else np.unique(np.concatenate([new, lost])))
        if len(gs):  # also where no value was lost: a label's parent can be gone and its label still come another way
            parent = search.parents(value, rooted, spread)
        yield _state_batch(ids, value, parent, 0, search.rounds)
        yield _state_batch(ids[lost], np.zeros(len(lost), np.int64), np.full(len(lost), -1), 2, search.rounds)
        if len(a_src):
            more = _Search(ids, np.concatenate([src, a_src]), np.concatenate([dst, a_dst]), np.concatenate([w, a_w]))
            s, d = np.searchsorted(ids, a_src), np.searchsorted(ids, a_dst)
            on = value[s] < far
            more.run(value, more.improve(value, d[on], value[s[on]] + a_w[on]))
            yield _state_batch(ids, value, more.parents(value, rooted, spread), 1, search.rounds + more.rounds)
        else:
            yield _state_batch(ids, value, parent, 1, search.rounds)

    rows = _rows(state, 0, "v", "value", "parent").union(_rows(edges, 1, "src", "dst", "w")).union(_rows(gone, 2, "src", "dst", "0")).union(_rows(added, 3, "src", "dst", "w"))
    return _run(rows, run, _STATE, homes)


def rank_fixed_point(state: DataFrame, edges: DataFrame, before: DataFrame | None, touched: DataFrame | None, damping: float, epsilon: float, max_rounds: int, jacobi: float | None = None, homes: DataFrame | None = None) -> DataFrame:
    """(v, rank, residual, rounds) over a bag (src, dst, cnt), all of whose sources are in the state.

    With ``before``, the old rows of the ``touched`` sources, what these have sent is taken back first, and their rank is sent along
    their new rows.  With ``jacobi``, that base is added in each of exactly max_rounds full rounds, and there are no residuals.
    """

    def links(got: list[np.ndarray], v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        src, dst, cnt = got
        s = np.searchsorted(v, src)
        share = damping * cnt / np.maximum(np.bincount(s, cnt, len(v)), 1)[s]
        d, ok = _known(v, dst)
        return s[ok], d[ok], share[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        none = [np.empty(0)] * 3
        (v, rank, residual), after, old, (t, _, _) = (got.get(k, none) for k in range(4))
        order = np.argsort(v)
        v, rank, residual = v[order], rank[order].copy(), residual[order].copy()
        s, d, share = links(after, v)
        mark = np.zeros(len(v), bool)
        mark[_known(v, t)[0][_known(v, t)[1]] if len(v) else []] = True
        os, od, oshare = links(old, v)
        residual += np.bincount(d, np.where(mark[s], rank[s], 0) * share, len(v)) - np.bincount(od, np.where(mark[os], rank[os], 0) * oshare, len(v))
        rounds = 0
        while rounds < max_rounds:
            if jacobi is not None:
                rank = jacobi + np.bincount(d, rank[s] * share, len(v))
                rounds += 1
                continue
            on = np.abs(residual) > epsilon
            if not on.any():
                break
            rounds += 1
            sent = np.where(on, residual, 0.0)
            rank += sent
            residual = np.where(on, 0.0, residual) + np.bincount(d, sent[s] * share, len(v))
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)), pa.array(rank), pa.array(residual), pa.array(np.full(len(v), rounds))], ["v", "rank", "residual", "rounds"])

    rows = _rows(state, 0, "v", "rank", "residual", "double").union(_rows(edges, 1, "src", "dst", "cnt", "double"))
    if before is not None:
        rows = rows.union(_rows(before, 2, "src", "dst", "cnt", "double")).union(_rows(touched, 3, "src", "0", "0", "double"))
    return _run(rows, run, "v bigint, rank double, residual double, rounds bigint", homes)


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums in which NaN is nothing."""
    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, a + b))


@dataclass(frozen=True)
class Arrays:
    """A vertex program (``operators.vertex``) on arrays of doubles, in which NaN is nothing: ``join`` is np.fmin, np.fmax or ``added``."""

    send: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    join: Callable[[np.ndarray, np.ndarray], np.ndarray]
    active: Callable[[np.ndarray, np.ndarray], np.ndarray]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    large_first: bool

    def gathered(self, at: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
        """What n vertices get of the messages m to the places ``at``."""
        if self.join is added:
            return np.where(np.bincount(at, minlength=n) > 0, np.bincount(at, m, n), np.nan)
        out = np.full(n, np.nan)
        self.join.at(out, at, m)
        return out

    def threshold(self, waiting: np.ndarray, score: np.ndarray, share: float, fine: int) -> tuple[float, int]:
        """From where on what waits is urgent, and how many are, by the most urgent buckets that hold ``share`` of the scores."""
        bucket = np.full(len(waiting), -(1 << 20))
        bucket[waiting > 0] = np.floor(np.log2(waiting[waiting > 0]) * fine)
        if self.large_first:
            bucket = -bucket
        kinds, place = np.unique(bucket, return_inverse=True)
        held = np.cumsum(np.bincount(place, score))
        last = min(int(np.searchsorted(held, share * held[-1])), len(kinds) - 1)
        own = waiting[place == last]
        return (own.min() if self.large_first else own.max() + 1), int((place <= last).sum())


def urgent_rounds(state: DataFrame, links: DataFrame, program: Arrays, share: float, max_rounds: int, unroll: int, fine: int, homes: DataFrame | None = None) -> DataFrame:
    """(kind, v, value, delta, got) of turns from a state (v, value, delta) along links (src, dst, share), each part by a sketch of its own.

    Kind 0 is the state, ``got`` what the last turn brought; kind 1 a row a turn v: its first round's senders, those that waited, its messages; kind 2 a row
    of a part that the cap ended.  Numbers are below 2**53.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "v", "value", "delta", "got"]
        got = _gather(batches)
        none = [np.empty(0)] * 3
        (v, value, delta), (src, dst, part) = (got.get(k, none) for k in (0, 1))
        order = np.argsort(v)
        v, value, delta = v[order].astype(np.int64), value[order].copy(), delta[order].copy()
        s, d = np.searchsorted(v, src), np.searchsorted(v, dst)
        by, first = _adjacency(v, s)
        d, part = d[by], part[by]
        came, turns, capped = np.zeros(len(v), np.int64), [], False
        while (on := program.active(value, delta)).any():
            if len(turns) * unroll >= max_rounds:
                capped = True
                break
            urgency = np.abs(delta) if program.large_first else delta
            threshold, senders = program.threshold(urgency[on], program.score(value[on], delta[on]), share, fine)
            waiting = int(on.sum()) - senders
            came[:] = 0
            for _ in range(unroll):
                urgency = np.abs(delta) if program.large_first else delta
                at = np.flatnonzero(program.active(value, delta) & (urgency >= threshold if program.large_first else urgency < threshold))
                if not len(at):
                    break
                e, who = _out(first, at), np.repeat(at, first[at + 1] - first[at])
                m = program.send(delta[who], v[who], v[d[e]], part[e])
                value[at] = program.join(value[at], delta[at])
                delta[at] = np.nan
                came += np.bincount(d[e], minlength=len(v))
                delta = program.join(delta, program.gathered(d[e], m, len(v)))
            turns.append((1, len(turns), senders, waiting, int(came.sum())))
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(v), np.int32)), pa.array(v), pa.array(value, mask=np.isnan(value)), pa.array(delta, mask=np.isnan(delta)), pa.array(came)], names)
        more = turns + [(2, 0, 0, 0, 0)] * capped
        kinds = (pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in more], k) for i, k in enumerate(kinds)], names)

    nothing = "coalesce({}, double('NaN'))"
    rows = _rows(state, 0, "v", nothing.format("value"), nothing.format("delta"), "double").union(_rows(links, 1, "src", "dst", "share", "double"))
    return _run(rows, run, "kind int, v bigint, value double, delta double, got bigint", homes)


def _known(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in the sorted ids, and whether it is there."""
    at = np.minimum(np.searchsorted(ids, x), max(len(ids) - 1, 0))
    return at, (ids[at] == x if len(ids) else np.zeros(len(x), bool))


def _closure(start: np.ndarray, first: np.ndarray, to: np.ndarray, ok=None) -> np.ndarray:
    """Which vertices the started ones reach over an adjacency; ``ok(sources, targets)`` filters its steps."""
    met = start.copy()
    new = np.flatnonzero(met)
    while len(new):
        e = _out(first, new)
        d = to[e]
        keep = ~met[d]
        if ok is not None:
            keep &= ok(np.repeat(new, first[new + 1] - first[new]), d)
        new = np.unique(d[keep])
        met[new] = True
    return met


def _tree_hit(v: np.ndarray, parent: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which vertices are under a parent link that is among the pairs (src, dst)."""
    at, there = _known(v, dst)
    hit = np.zeros(len(v), bool)
    hit[at[there & (parent[at] == src)] if len(v) else []] = True
    up, has = _known(v, parent)
    child = np.flatnonzero(has & (parent >= 0))
    by, first = _adjacency(v, up[child])
    return _closure(hit, first, child[by])


def _label_hit(v: np.ndarray, label: np.ndarray, gs: np.ndarray, gd: np.ndarray, search: _Search) -> np.ndarray:
    """Members of the label groups of vanished pairs that the label's root no longer reaches inside its group."""
    (a, ok), (b, ok2) = _known(v, gs), _known(v, gd)
    a, b = a[ok & ok2], b[ok & ok2]
    suspect = np.unique(label[b[(a != b) & (label[a] == label[b]) & (label[b] < v[b])]])
    group = np.isin(label, suspect)
    return group & ~_closure(group & (v == label), search.first, search.dst, lambda x, y: group[y] & (label[x] == label[y]))


def tree_closure(state: DataFrame, gone: DataFrame) -> DataFrame:
    """(v): vertices under a parent link that is among the vanished edges (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        none = [np.empty(0, np.int64)] * 3
        (v, parent, _), (dst, src, _) = (got.get(k, none) for k in (0, 1))
        order = np.argsort(v)
        yield pa.RecordBatch.from_arrays([pa.array(v[order][_tree_hit(v[order], parent[order], src, dst)])], ["v"])

    rows = _rows(state, 0, "v", "parent", "0").union(_rows(gone, 1, "dst", "src", "0"))
    return rows.coalesce(1).mapInArrow(run, "v bigint")


def components(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex of each weakly connected component of (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        none = [np.empty(0, np.int64)] * 3
        (own, _, _), (src, dst, _) = (got.get(k, none) for k in (0, 1))
        a, b = _stars(src, dst)
        at, there = _known(a, own)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.where(there, b[at], own) if len(a) else own)], ["v", "component"])

    rows = _rows(vertices, 0, "v", "0", "0").union(_rows(pairs, 1, "src", "dst", "0"))
    return rows.coalesce(1).mapInArrow(run, "v bigint, component bigint")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An edge from each vertex but roots to the least vertex that it is connected with by the edges (a, b)."""
    ids = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(ids, a), np.searchsorted(ids, b)
    low = np.arange(len(ids))
    while len(a):  # each root takes the least root beside it, then paths are cut short
        x, y = low[a], low[b]
        on = x != y
        a, b, x, y = a[on], b[on], x[on], y[on]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    own = low != np.arange(len(ids))
    return ids[own], ids[low[own]]


#: Edges that a task gathers before it joins them.
GATHERED = 1 << 19


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b), a > b: each partition's edges replaced by stars that connect the same vertices; a task holds some edges and one star edge a vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, n = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0
        for batch in batches:
            more.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            n += batch.num_rows
            if n >= max(GATHERED, len(held[0])):
                held, more, n = _stars(*[np.concatenate([h, *x]) for h, x in zip(held, zip(*more))]), [], 0
        if more:
            held = _stars(*[np.concatenate([h, *x]) for h, x in zip(held, zip(*more))])
        for at in range(0, len(held[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + (1 << 16)]) for x in held], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def _lightest(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """The forest of the edges (a, b) that is lightest by (h, a, b): each tree takes its lightest edge to another one, until none has any."""
    order = np.lexsort((b, a, h))
    h, a, b = h[order], a[order], b[order]
    ids = np.unique(np.concatenate([a, b]))
    s, d = np.searchsorted(ids, a), np.searchsorted(ids, b)
    tree, keep, left = np.arange(len(ids)), np.zeros(len(a), bool), np.arange(len(a))
    while True:
        x, y = tree[s[left]], tree[d[left]]
        on = x != y
        left, x, y = left[on], x[on], y[on]
        if not len(left):
            return [h[keep], a[keep], b[keep]]
        best = np.full(len(ids), len(a))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        taken = np.unique(best[best < len(a)])
        keep[taken] = True
        own, least = _stars(tree[s[taken]], tree[d[taken]])
        low = np.arange(len(ids))
        low[own] = least
        tree = low[tree]


def lightest(edges: DataFrame) -> DataFrame:
    """(h, src, dst): each partition's edges but those that close a cycle of lighter ones, which are in no lightest forest of any more edges.

    A task holds some edges and a forest of its vertices.  Equal rows of a partition are taken once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, n = [np.empty(0, np.int64)] * 3, [], 0
        for batch in batches:
            more.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            n += batch.num_rows
            if n >= max(GATHERED, len(held[0])):
                held, more, n = _lightest(*[np.concatenate([x, *y]) for x, y in zip(held, zip(*more))]), [], 0
        if more:
            held = _lightest(*[np.concatenate([x, *y]) for x, y in zip(held, zip(*more))])
        for at in range(0, len(held[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[at:at + (1 << 16)]) for x in held], ["h", "src", "dst"])

    return edges.select("h", "src", "dst").mapInArrow(run, "h bigint, src bigint, dst bigint")


def strong(vertices: DataFrame, pairs: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """(v, component, level): strong components by one depth-first search, named by their smallest vertex, and the most edges of a path of components that ends at each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        none = [np.empty(0, np.int64)] * 3
        (ids, _, _), (src, dst, _) = (got.get(k, none) for k in (0, 1))
        ids = np.unique(ids)
        (s, ok), (d, ok2) = _known(ids, src), _known(ids, dst)
        s, d = s[ok & ok2], d[ok & ok2]
        order, first = _adjacency(ids, s)
        to, start = d[order].tolist(), first.tolist()
        n = len(ids)
        index, low, name, on = [-1] * n, [0] * n, [-1] * n, [False] * n
        stack: list[int] = []
        found: list[list[int]] = []  # components, those that are reached first
        turn = 0
        for root in range(n):
            if index[root] >= 0:
                continue
            work = [(root, start[root])]
            index[root] = low[root] = turn
            turn += 1
            stack.append(root)
            on[root] = True
            while work:
                v, e = work.pop()
                while e < start[v + 1]:
                    u = to[e]
                    e += 1
                    if index[u] < 0:
                        work.append((v, e))
                        index[u] = low[u] = turn
                        turn += 1
                        stack.append(u)
                        on[u] = True
                        work.append((u, start[u]))
                        break
                    if on[u]:
                        low[v] = min(low[v], index[u])
                else:
                    if low[v] == index[v]:
                        own = []
                        while not own or own[-1] != v:
                            u = stack.pop()
                            on[u] = False
                            name[u] = len(found)
                            own.append(u)
                        found.append(own)
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
        level = [0] * len(found)
        for c in range(len(found) - 1, -1, -1):  # sources come last
            for v in found[c]:
                for e in range(start[v], start[v + 1]):
                    if name[to[e]] != c:
                        level[name[to[e]]] = max(level[name[to[e]]], level[c] + 1)
        least = [min(own) for own in found]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([int(ids[least[c]]) for c in name], pa.int64()), pa.array([level[c] for c in name], pa.int64())], ["v", "component", "level"])

    rows = _rows(vertices, 0, "v", "0", "0").union(_rows(pairs, 1, "src", "dst", "0"))
    return _run(rows, run, "v bigint, component bigint, level bigint", homes)


def longest(own: DataFrame, pairs: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """(v, path): the most of the sums of ``own`` (v, own) on a path of an acyclic graph (src, dst) that ends at each vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        none = [np.empty(0, np.int64)] * 3
        (v, x, _), (src, dst, _) = (got.get(k, none) for k in (0, 1))
        order = np.argsort(v)
        v, x = v[order], x[order]
        s, d = np.searchsorted(v, src), np.searchsorted(v, dst)
        by, first = _adjacency(v, s)
        to, waits = d[by], np.bincount(d, minlength=len(v))
        path, new = x.copy(), np.flatnonzero(waits == 0)
        while len(new):  # vertices whose sources are all done
            e = _out(first, new)
            at = np.repeat(new, first[new + 1] - first[new])
            np.maximum.at(path, to[e], path[at] + x[to[e]])
            np.subtract.at(waits, to[e], 1)
            near = np.unique(to[e])
            new = near[waits[near] == 0]
        yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(path)], ["v", "path"])

    rows = _rows(own, 0, "v", "own", "0").union(_rows(pairs, 1, "src", "dst", "0"))
    return _run(rows, run, "v bigint, path bigint", homes)
