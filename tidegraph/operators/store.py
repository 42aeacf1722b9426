"""The edges of an evolving graph: a base that is not rewritten for a batch, and an overlay of the pairs touched since.

The overlay holds the current count of every touched pair, 0 where no occurrence is left.  A batch
looks up its own pairs, adds them to the overlay, and leaves the base where it is; once the overlay has a quarter of the base's
rows, both become a new base.  Reads are joins on base and overlay; ``live.EdgeIndex`` is the store for lookups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.state import discard, settled
from .topology import Applied, batch_metrics, effective_changes, planned

#: Share of the base's rows, and rows besides, that the overlay may have.
SHARE, LEAST = 0.25, 10_000


@dataclass(frozen=True)
class EdgeStore:
    base: DataFrame
    rows: int
    overlay: DataFrame | None = None
    touched: int = 0

    @classmethod
    def of(cls, edges: DataFrame | EdgeStore) -> EdgeStore:
        """A store of edges (src, dst, cnt), one row a pair; a store stays as it is."""
        if isinstance(edges, EdgeStore):
            return edges
        base = settled(edges.select("src", "dst", "cnt").repartitionByRange("src").sortWithinPartitions("src", "dst"))
        return cls(base, base.count())

    @property
    def size(self) -> int:
        """No fewer than the rows of the view."""
        return self.rows + self.touched

    def view(self) -> DataFrame:
        """The current bag (src, dst, cnt)."""
        if self.overlay is None:
            return self.base
        return self.base.join(self.overlay.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(self.overlay.where("cnt > 0"))

    def pairs(self, n: int) -> DataFrame:
        """The pairs with both ends in range."""
        return self.view().where((F.col("src") >= 0) & (F.col("src") < n) & (F.col("dst") >= 0) & (F.col("dst") < n)).select("src", "dst")

    def with_counts(self, counts: DataFrame, rows: int) -> EdgeStore:
        """The store with some pairs' counts (src, dst, cnt) replaced; not settled."""
        if self.overlay is not None:
            counts = self.overlay.join(counts.select("src", "dst"), ["src", "dst"], "left_anti").unionByName(counts)
        return EdgeStore(self.base, self.rows, counts, self.touched + rows)

    def apply(self, batch: DataFrame, n: int) -> Step:
        """One batch of (op 'a' or 'd', src, dst[, cnt]): deletes, then adds."""
        plan = settled(planned(self.view(), batch, n))
        rows = plan.count()
        mine = plan.where("ok and (gone > 0 or adds > 0)")
        left = F.col("have") - F.col("gone")
        mid = self.with_counts(mine.where("gone > 0").select("src", "dst", left.alias("cnt")), rows)
        after = self.with_counts(mine.select("src", "dst", (left + F.col("adds")).alias("cnt")), rows)
        after = EdgeStore(after.base, after.rows, settled(after.overlay), after.touched)
        if after.touched > LEAST + SHARE * after.rows:
            new = EdgeStore.of(after.view())
            discard(after.overlay)
            after = new
        return Step(self, plan, mid, after)


@dataclass(frozen=True)
class Step:
    """A batch on a store: the plan by pair, and the stores after its deletes and after its adds."""

    before: EdgeStore
    plan: DataFrame
    mid: EdgeStore
    after: EdgeStore

    def vanished(self) -> DataFrame:
        """Pairs whose last occurrence the deletes took."""
        return self.plan.where("gone > 0 and gone = have").select("src", "dst")

    def lost(self) -> DataFrame:
        """Pairs that are in the graph before the batch, and not after it."""
        return self.plan.where("gone > 0 and gone = have and adds = 0").select("src", "dst")

    def gained(self, n: int) -> DataFrame:
        """Pairs in range that the adds bring, or bring back."""
        return self.plan.where((F.col("ok")) & (F.col("adds") > 0) & (F.col("have") == F.col("gone")) & (F.col("dst") >= 0) & (F.col("dst") < n)).select("src", "dst")

    def touched(self) -> DataFrame:
        return self.plan.where("ok").select("src").distinct()

    def applied(self) -> Applied:
        return Applied(self.mid.view(), self.after.view(), effective_changes(self.plan), batch_metrics(self.plan), self.touched())
