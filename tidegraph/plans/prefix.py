"""Running sums over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .state import settled


def running_sum(rows: DataFrame, order: list[Column], value: Column, name: str, group: str | None = None, kind: str = "long") -> DataFrame:
    """``rows`` with ``name``: the sum of ``value``, cast to ``kind``, over all rows before, in the order (within ``group``).

    Rows are dealt out by ranges of the order and pinned; each range sums its own rows, and the sums
    of the ranges (one row each) give the offsets.
    """
    key = [F.col(group)] if group else []
    dealt = settled(rows.withColumn("_value", value.cast(kind)).repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()))
    by = ["_range", group] if group else ["_range"]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum("_value").over(before), F.lit(0).cast(kind)))
    sums = dealt.groupBy(*by).agg(F.sum("_value").alias("_sum"))
    ahead = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, F.coalesce(F.sum("_sum").over(ahead), F.lit(0).cast(kind)).alias("_ahead"))
    return own.join(offsets, by).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_own") + F.col("_ahead")).alias(name))
