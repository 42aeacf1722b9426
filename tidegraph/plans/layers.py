"""Tables that change a little at a time: a base that stays where it is, and the rows put since.

A ``Layered`` table has a base, bucketed and sorted by its key, an overlay of the same kind, and the newest
rows, of which the driver holds a bounded number.  Looking up a few keys reads the buckets and
row groups that can hold them, by a filter on literal keys: the base is neither scanned whole nor exchanged.  Reads by more keys than that
are joins on ``all()``.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .state import discard, settled

#: Keys of a lookup, and rows that it may return.
FEW = 5_000
#: Rows of the newest layer; beyond that they go to the overlay.
MEMORY = 20_000
#: Share of the base's rows, and rows besides, that the overlay may have; beyond that both become a new base.
SHARE, LEAST = 0.25, 10_000


class TooMany(Exception):
    """A step has more rows than a lookup may have; the caller goes on with joins."""


def local_frame(spark: SparkSession, rows: Iterable[Sequence], schema) -> DataFrame:
    """A few rows as a local relation: no job is needed to read them."""
    kind = to_arrow_schema(schema)
    columns = list(zip(*rows)) or [[] for _ in kind]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind), schema)


def among(columns: Sequence[str], keys: Iterable) -> Column:
    """Whether the columns are one of some literal keys (whole numbers, or tuples of such)."""
    text = ", ".join(f"({', '.join(f'{x}L' for x in k)})" if isinstance(k, tuple) else f"{k}L" for k in keys)
    left = f"({', '.join(columns)})" if len(columns) > 1 else columns[0]
    return F.expr(f"{left} IN ({text})") if text else F.lit(False)


def few_rows(df: DataFrame, most: int | None = None) -> list:
    """The rows of a frame, by one job; TooMany if there are more than ``most``."""
    most = FEW if most is None else most
    df.sparkSession.conf.set("spark.sql.limit.initialNumPartitions", str(1 << 20))  # all partitions at once, each up to the limit
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise TooMany
    return rows


@dataclass(frozen=True)
class Layered:
    """Rows told apart by ``unique``, looked up by ``key``.  A row whose ``value`` is null is not there: it hides an older one.

    Snapshots are immutable: ``put`` gives a new one, which shares the older layers.
    """

    base: DataFrame
    size: int
    key: str
    unique: tuple[str, ...]
    value: str
    over: DataFrame | None = None
    over_rows: int = 0
    mem: dict = field(default_factory=dict)

    @classmethod
    def of(cls, rows: DataFrame, key: str, unique: tuple[str, ...], value: str, count: int | None = None) -> Layered:
        base = settled(rows, key=key, sort=[key, *[c for c in unique if c != key]])
        return cls(base, base.count() if count is None else count, key, unique, value)

    @property
    def columns(self) -> list[str]:
        return self.base.columns

    def _newest(self) -> DataFrame:
        return local_frame(self.base.sparkSession, self.mem.values(), self.base.schema)

    def all(self) -> DataFrame:
        out = self.base
        for layer in (self.over, F.broadcast(self._newest()) if self.mem else None):  # at most MEMORY rows
            if layer is not None:
                out = out.join(layer.select(*self.unique), list(self.unique), "left_anti").unionByName(layer)
        return out.where(F.col(self.value).isNotNull()).select(*self.columns)  # the joins put the unique columns first

    def lookup(self, keys: Iterable[int], only: Iterable[tuple] | None = None) -> DataFrame:
        """The rows of base and overlay with these keys (or, of these, of the unique tuples ``only``), with their layer."""
        near = among([self.key], keys)
        if only is not None:
            near = near & among(self.unique, only)
        parts = [x.where(near).select("*", F.lit(i).alias("_layer")) for i, x in enumerate((self.base, self.over)) if x is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def get(self, keys: Iterable[int], only: set[tuple] | None = None, most: int | None = None) -> list[tuple]:
        """The current rows of some keys, as tuples; TooMany if there are too many of either."""
        keys = set(keys)
        if not keys:
            return []
        if len(keys) > (FEW if most is None else most):
            raise TooMany
        columns = self.columns
        at, place = columns.index(self.key), [columns.index(c) for c in self.unique]
        found = {}
        for r in sorted(few_rows(self.lookup(sorted(keys), only), most), key=lambda r: r["_layer"]):
            found[tuple(r[i] for i in place)] = tuple(r)[:-1]
        found |= {u: r for u, r in self.mem.items() if r[at] in keys and (only is None or u in only)}
        alive = columns.index(self.value)
        return [r for r in found.values() if r[alive] is not None]

    def put(self, rows: Iterable[Sequence]) -> Layered:
        """The table with some rows replaced or added."""
        place = [self.columns.index(c) for c in self.unique]
        mem = self.mem | {tuple(r[i] for i in place): tuple(r) for r in rows}
        out = replace(self, mem=mem)
        return out if len(mem) <= MEMORY else replace(out, mem={}).put_all(out._newest())

    def put_all(self, rows: DataFrame) -> Layered:
        """``put`` of a frame of any size; what the driver holds goes to the overlay with it."""
        names = list(self.unique)
        older = [x for x in (self.over, self._newest() if self.mem else None) if x is not None]
        fresh = rows.select(*self.columns)
        for layer in reversed(older):
            fresh = fresh.unionByName(layer.join(fresh.select(*names), names, "left_anti"))
        over = settled(fresh, key=self.key, sort=[self.key])
        out = replace(self, over=over, over_rows=over.count(), mem={})
        if out.over_rows > LEAST + SHARE * self.size:
            new = Layered.of(out.all(), self.key, self.unique, self.value)
            discard(over)
            return new
        return out

    def changes(self) -> DataFrame | None:
        """What hides the base: overlay and newest rows, those that are gone included; None if there are none."""
        if not self.mem:
            return self.over
        newest = self._newest()
        if self.over is None:
            return newest
        return self.over.join(F.broadcast(newest.select(*self.unique)), list(self.unique), "left_anti").unionByName(newest)

    def release(self, *kept: Layered) -> None:
        """Deletes the layers that none of the ``kept`` snapshots has."""
        held = [id(x) for k in kept for x in (k.base, k.over)]
        discard(*[x for x in (self.base, self.over) if x is not None and id(x) not in held])
