"""Schemas of the engine's tables, and their validation at the API's edge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns])


LONG, TEXT, DOUBLE, FLAG = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
#: Vertex ids are unsigned 32-bit numbers; they are held as longs.
LARGEST_ID = 2**32 - 1
#: How an unreachable value is written where a file has no null.
UNREACHABLE = 2**32 - 1

EDGES = _table(("src", LONG), ("dst", LONG), ("cnt", LONG))
UPDATES = _table(("seq", LONG), ("op", TEXT), ("src", LONG), ("dst", LONG))
BATCH_SIZES = _table(("batch_id", LONG), ("add_count", LONG), ("del_count", LONG))
STATE = _table(("v", LONG), ("value", LONG), ("parent", LONG))
RANKS = _table(("v", LONG), ("rank", DOUBLE), ("residual", DOUBLE))


def require(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """The schema's columns, cast to its types; a missing column is an error, others are dropped."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return df.select([F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def positive(name: str, value: float, zero: bool = False) -> None:
    if value < 0 or value == 0 and not zero or value != value:
        raise ValueError(f"{name} must be {'at least' if zero else 'over'} 0, not {value}")
