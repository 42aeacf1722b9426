"""Fixed points of graphs of any shape, in rounds of blocks.

The vertices 0 .. n - 1 are dealt to blocks by their remainder, and a block's out-edges are one row of arrays, ordered by destination.  A round is one
exchange: each block takes what arrived into its vertices, reduces what these send at the destinations, and sends every other block one row.
A block has about MOST edges, whatever the graph, and stays in its bucket; a turn of some rounds is one job, and the driver reads a
few numbers of it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .state import discard, settled

#: Edges that a block has at least, where there are fewer blocks than shuffle partitions, and about at most.
FEW, MOST = 300_000, 1_500_000
#: Rounds between two looks of the driver; twice as many where a fixed point has taken more.
TURN = 4
FAR = 1 << 62
ROWS = "block bigint, kind int, sender int, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double, s6 double, at binary, x binary"
LINKS = "block bigint, form string, bounds binary, target binary, first binary, source binary, weight binary"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_STATE, _MESSAGE = 0, 1
_NO = (0.0,) * 7


@dataclass(frozen=True)
class Blocks:
    """``keys`` names the blocks: their hashes fall into different partitions."""

    n: int
    keys: tuple[int, ...]

    @classmethod
    def of(cls, spark: SparkSession, n: int, size: int) -> Blocks:
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        count = max(2, min(partitions, math.ceil(size / FEW)), math.ceil(size / MOST))
        rows, tried = [], 16 * count
        while len(rows) < count:
            tried *= 2
            rows = spark.range(0, tried, 1, 1).groupBy(F.expr(f"pmod(hash(id), {count})").alias("p")).agg(F.min("id").alias("key")).orderBy("p").collect()
        return cls(n, tuple(r.key for r in rows))

    @property
    def count(self) -> int:
        return len(self.keys)

    def vertices(self, block: int) -> int:
        return max(0, -(-(self.n - block) // self.count))

    def block(self, v: Column) -> Column:
        return F.element_at(F.array(*[F.lit(k).cast("long") for k in self.keys]), F.pmod(v, F.lit(self.count)).cast("int") + 1)

    def links(self, edges: DataFrame, weight: str, damping: float | None = None, onto: DataFrame | None = None) -> DataFrame:
        """The out-edges (src, dst, ``weight``) by block; ``onto`` adds them to links that are there, which are then not to be used without them.

        With ``damping``, weights are counts, and become that part of what the source sends: an edge to a destination out of range counts in its
        source's degree and delivers nothing.
        """
        count, wide, n, size = self.count, -(-self.n // self.count), self.n, self.vertices

        def built(table: pa.Table) -> pa.Table:
            src, dst, w = (pc.fill_null(table[c], -1).to_numpy() for c in ("src", "dst", "w"))
            own = int(src[0]) % count
            at = src // count
            if damping is not None:
                w = damping * w / np.bincount(at, w, size(own))[at]
            elif not len(w) or np.abs(w).max() < 1 << 31:
                w = w.astype(np.int32)
            ok = (dst >= 0) & (dst < n)
            at, dst, w = at[ok], dst[ok], w[ok]
            place = (dst % count) * wide + dst // count
            order = np.argsort(place, kind="stable")
            place = place[order]
            first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.empty(0, np.int64)
            heads = place[first]
            bounds = np.searchsorted(heads, np.arange(count + 1) * wide)
            arrays = (bounds.astype(np.int64), (heads % wide).astype(np.int32), first.astype(np.int32), at[order].astype(np.int32), w[order])
            return pa.table([pa.array([table["block"][0].as_py()], pa.int64()), pa.array([w.dtype.str]), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], names=["block", "form", "bounds", "target", "first", "source", "weight"])

        inside = edges.where((F.col("src") >= 0) & (F.col("src") < self.n))
        rows = inside.select(self.block(F.col("src")).alias("block"), "src", "dst", F.col(weight).alias("w"))
        rows = rows.repartition(self.count, "block").groupBy("block").applyInArrow(built, LINKS)
        return settled(rows, "blocks", key="block", dealt=True, parts=self.count, dictionary=False, onto=onto)

    def state(self, rows: DataFrame, columns: tuple[str, ...], empty: float, new: bool | None = None) -> DataFrame:
        """Rows (v, ``columns``) as one row a block; vertices without a row have the value ``empty``, and ``new`` marks those with one."""
        count, size, place = self.count, self.vertices, self._place()
        kind = np.int64 if isinstance(empty, int) else np.float64

        def built(table: pa.Table) -> pa.Table:
            key = table["block"][0].as_py()
            own = place[key]
            table = table.filter(pc.is_valid(table["v"]))
            at = table["v"].to_numpy() // count
            out = np.full((len(columns), size(own)), empty, kind)
            for i, c in enumerate(columns):
                out[i, at] = table[c].to_numpy()
            mark = np.zeros(size(own), np.uint8)
            mark[at] = bool(new)
            return _rows([(key, _STATE, own, *_NO, mark.tobytes(), out.tobytes())])

        spark = rows.sparkSession
        every = spark.range(count).select(self.block(F.col("id")).alias("block"), F.lit(None).cast("long").alias("v"), *[F.lit(None).cast("long" if isinstance(empty, int) else "double").alias(c) for c in columns])
        own = rows.select(self.block(F.col("v")).alias("block"), "v", *columns).unionByName(every)
        return own.repartition(count, "block").groupBy("block").applyInArrow(built, ROWS)

    def _place(self) -> dict[int, int]:
        return {k: i for i, k in enumerate(self.keys)}

    def round(self, rows: DataFrame, links: DataFrame, step: Callable) -> DataFrame:
        """One exchange: ``step`` (block, its rows, its links) gives the rows that are sent on."""
        place = self._place()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _rows([])
            return _rows(step(place[left["block"][0].as_py()], left, right))

        return rows.repartition(self.count, "block").groupBy("block").cogroup(links.groupBy("block")).applyInArrow(run, ROWS)

    def gathered(self, rows: DataFrame, step: Callable) -> DataFrame:
        """What has arrived, taken in by ``step`` (block, its rows); nothing is sent."""
        place = self._place()

        def run(left: pa.Table) -> pa.Table:
            return _rows(step(place[left["block"][0].as_py()], left))

        return settled(rows.repartition(self.count, "block").groupBy("block").applyInArrow(run, ROWS), "blocks", dictionary=False)

    def emitted(self, rows: DataFrame, step: Callable[[int, pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
        place = self._place()

        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([step(place[table["block"][0].as_py()], table)])

        return rows.repartition(self.count, "block").groupBy("block").applyInArrow(run, schema)

    # -- ranks -------------------------------------------------------------------------------------------

    def ranked(self, state: DataFrame, links: DataFrame, epsilon: float, max_rounds: int, damping: float) -> tuple[DataFrame, int, bool]:
        """((v, rank, residual), rounds, converged): residuals over epsilon are taken into the rank and sent on, until there are none.

        With any step a, rank + a r and (1 - a) r + a P'r keep rank + residual = base + P'rank, so steps need not be 1.  After some rounds what is left
        points nearly one way and shrinks by the damping only; the first step of a turn is the one that makes the residuals' sum 0, where that
        leaves less of their squares than 1 does.  Where a turn leaves more than rounds of 1 do at worst, steps are 1 from then on.
        """
        keys, count = self.keys, self.count

        def moved(rank: np.ndarray, r: np.ndarray, got: np.ndarray, a: float) -> tuple[np.ndarray, np.ndarray]:
            return rank + a * r, (1 - a) * r + a * got

        def taken(left: pa.Table) -> tuple[np.ndarray, list]:
            row, messages = _split(left)
            x = np.frombuffer(row["x"], np.float64)
            return x, messages

        def got(messages: list, n: int) -> np.ndarray:
            out = np.zeros(n)
            for m in messages:
                out[np.frombuffer(m["at"], np.int32)] += np.frombuffer(m["x"], np.float64)
            return out

        def step(a: float, started: bool) -> Callable:
            def run(own: int, left: pa.Table, right: pa.Table) -> list[tuple]:
                n = self.vertices(own)
                x, messages = taken(left)
                x = x.reshape(-1, n)
                rank, r = x[0], x[1]
                if started:
                    rank, r = moved(rank, r, x[2] if len(x) > 2 else got(messages, n), a)
                out = [(keys[own], _STATE, own, *_NO, b"", np.concatenate([rank, r]).tobytes())]
                if r.any():
                    for bounds, target, first, source, weight in _links(right):
                        m = np.add.reduceat(r[source] * weight, first)
                        out += _messages(keys, own, bounds, target, m, m != 0)
                return out
            return run

        def end(own: int, left: pa.Table) -> list[tuple]:
            n = self.vertices(own)
            x, messages = taken(left)
            rank, r = x.reshape(-1, n)
            q = got(messages, n)
            sums = (q.sum(), r.sum(), q @ q, r @ q, r @ r, np.abs(q).sum(), np.abs(q).max(initial=0))
            return [(keys[own], _STATE, own, *map(float, sums), b"", np.concatenate([rank, r, q]).tobytes())]

        def rows_of(own: int, left: pa.Table) -> pa.RecordBatch:
            n = self.vertices(own)
            x, _ = taken(left)
            x = x.reshape(-1, n)
            rank, r = moved(*x, 1.0) if len(x) > 2 else x
            return pa.RecordBatch.from_arrays([pa.array(np.arange(n) * count + own), pa.array(rank), pa.array(r)], ["v", "rank", "residual"])

        first = state.select(F.max(F.abs("residual"))).first()[0] or 0.0
        rows, rounds, a, plain, converged, norm = self.state(state, ("rank", "residual"), 0.0), 0, 1.0, False, first <= epsilon, None
        while not converged and rounds < max_rounds:
            turn, old, started = min(TURN, max_rounds - rounds), rows, rounds > 0
            for i in range(turn):
                rows = self.round(rows, links, step(a if i == 0 else 1.0, started or i > 0))
            rows = self.gathered(rows, end)
            discard(old)
            rounds += turn
            q, r, qq, rq, rr, total, worst = rows.agg(*[F.sum(f"s{i}") for i in range(6)], F.max("s6")).first()
            converged = worst <= epsilon
            plain = plain or (norm is not None and total > norm * damping**turn)
            norm = total
            a = min(max(r / (r - q), 1.0), 1 / (1 - damping)) if not plain and r != q else 1.0
            if (1 - a) ** 2 * rr + 2 * a * (1 - a) * rq + a**2 * qq >= qq:
                a = 1.0
        out = settled(self.emitted(rows, rows_of, "v bigint, rank double, residual double"))
        discard(rows)
        return out, rounds, converged

    # -- least values ------------------------------------------------------------------------------------

    def least(self, rows: DataFrame, links: DataFrame, max_rounds: int, every: bool = False) -> tuple[DataFrame, int]:
        """(state, rounds) once no value of source + weight is less than its destination's; with ``every`` all vertices send first, not only new ones."""
        keys = self.keys

        def taken(own: int, left: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            row, messages = _split(left)
            value, new = np.frombuffer(row["x"], np.int64).copy(), np.frombuffer(row["at"], np.uint8).copy()
            for m in messages:
                at, x = np.frombuffer(m["at"], np.int32), np.frombuffer(m["x"], np.int64)
                ok = x < value[at]
                value[at[ok]] = x[ok]
                new[at[ok]] = 1
            return value, new

        def step(every: bool) -> Callable:
            def run(own: int, left: pa.Table, right: pa.Table) -> list[tuple]:
                value, new = taken(own, left)
                if every:
                    new[:] = 1
                out = [(keys[own], _STATE, own, *_NO, np.zeros(len(new), np.uint8).tobytes(), value.tobytes())]
                if new.any():
                    known = np.where(new > 0, value, FAR)
                    for bounds, target, first, source, weight in _links(right):
                        m = np.minimum.reduceat(known[source] + weight, first)
                        out += _messages(keys, own, bounds, target, m, m < FAR)
                return out
            return run

        def end(own: int, left: pa.Table) -> list[tuple]:
            value, new = taken(own, left)
            return [(keys[own], _STATE, own, float(new.sum()), *_NO[1:], new.tobytes(), value.tobytes())]

        rounds = 0
        while True:
            old, turn = rows, TURN if not rounds else 2 * TURN
            for i in range(turn):
                rows = self.round(rows, links, step(every and rounds + i == 0))
            rows = self.gathered(rows, end)
            discard(old)
            rounds += turn
            if not rows.agg(F.sum("s0")).first()[0]:
                return rows, rounds
            if rounds >= max_rounds:
                raise RuntimeError(f"no fixed point in {max_rounds} rounds")

    def reached(self, rows: DataFrame) -> DataFrame:
        """(v) of the vertices with a value."""
        count = self.count

        def rows_of(own: int, left: pa.Table) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(np.frombuffer(_split(left)[0]["x"], np.int64) < FAR) * count + own)], ["v"])

        return settled(self.emitted(rows, rows_of, "v bigint"))

    def rooted(self, rows: DataFrame, links: DataFrame, by_zero: bool, spread: int = 1) -> DataFrame:
        """(v, value, parent) of the reached vertices: the smallest source whose value and edge give the vertex's value; roots, with value 0 or their own id times ``spread``, have none."""
        keys, count = self.keys, self.count

        def step(own: int, left: pa.Table, right: pa.Table) -> list[tuple]:
            row, _ = _split(left)
            value = np.frombuffer(row["x"], np.int64)
            out = [(keys[own], _STATE, own, *_NO, b"", value.tobytes())]
            for bounds, target, first, source, weight in _links(right):
                x = value[source] + weight
                m = np.minimum.reduceat(x, first)
                at = np.minimum.reduceat(np.where(x == np.repeat(m, np.diff(np.append(first, len(x)))), source.astype(np.int64) * count + own, FAR), first)
                out += _messages(keys, own, bounds, target, np.stack([m, at], 1), m < FAR)
            return out

        def rows_of(own: int, left: pa.Table) -> pa.RecordBatch:
            row, messages = _split(left)
            value = np.frombuffer(row["x"], np.int64)
            parent = np.full(len(value), FAR)
            for m in messages:
                at, x = np.frombuffer(m["at"], np.int32), np.frombuffer(m["x"], np.int64).reshape(-1, 2)
                ok = x[:, 0] == value[at]
                parent[at[ok]] = np.minimum(parent[at[ok]], x[ok, 1])
            v = np.arange(len(value)) * count + own
            on = value < FAR
            none = (parent == FAR) | (value == 0 if by_zero else value == v * spread)
            return pa.RecordBatch.from_arrays([pa.array(v[on]), pa.array(value[on]), pa.array(parent[on], mask=none[on])], ["v", "value", "parent"])

        return settled(self.emitted(self.round(rows, links, step), rows_of, "v bigint, value bigint, parent bigint"))


def _rows(rows: list[tuple]) -> pa.Table:
    types = (pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 7, pa.binary(), pa.binary())
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=_NAMES)


def _split(table: pa.Table) -> tuple[dict, list[dict]]:
    """A block's state, and the messages to it by their senders, so that sums do not depend on the order of arrival."""
    rows = [{"kind": k.as_py(), "sender": s.as_py(), "at": a.as_buffer(), "x": x.as_buffer()} for k, s, a, x in zip(*[table[c] for c in ("kind", "sender", "at", "x")])]
    return next(r for r in rows if r["kind"] == _STATE), sorted((r for r in rows if r["kind"] == _MESSAGE), key=lambda r: r["sender"])


def _links(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    for i in range(table.num_rows):
        part = lambda c, kind: np.frombuffer(table[c][i].as_buffer(), kind)
        first = part("first", np.int32)
        if len(first):
            yield part("bounds", np.int64), part("target", np.int32), first, part("source", np.int32), part("weight", np.dtype(table["form"][i].as_py()))


def _messages(keys: tuple[int, ...], own: int, bounds: np.ndarray, target: np.ndarray, m: np.ndarray, ok: np.ndarray) -> list[tuple]:
    out = []
    for i, key in enumerate(keys):
        part = slice(bounds[i], bounds[i + 1])
        on = ok[part]
        if on.any():
            out.append((key, _MESSAGE, own, *_NO, target[part][on].tobytes(), m[part][on].tobytes()))
    return out
