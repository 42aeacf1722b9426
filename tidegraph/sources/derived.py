"""A directed multigraph and its update batches, derived from the order tables.

An edge leads from each line's part to the part of the next line of its order, in the order of
(line number, part, supplier).  The first years are the initial graph; later years are added, one
batch a year.  Each batch also deletes returned lines: those of its own year, which are not there yet and so are missing
deletes, and those of some of the first years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.state import settled

FIRST_YEARS = 1998
#: The batch that deletes the returned lines of the first years up to these.
RETURNS = {0: 1995, 1: 1997, 2: 1998}


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    return lines.withColumn("dst", F.lead("l_partkey").over(by)).where("dst is not null").select(
        F.col("l_partkey").alias("src"), "dst", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.year("l_shipdate").cast("long").alias("year"))


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, cnt) over all lines."""
    return order_lines(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("cnt"))


def vertex_count(spark: SparkSession, sf_dir: str) -> int:
    """One more than the largest part number."""
    return int(spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0]) + 1


def kept_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, flag, year) of ``order_lines``, written: putting lines in order moves whole lines, so what is derived from them several times moves them once."""
    return settled(order_lines(spark, sf_dir).select("src", "dst", "flag", "year"), "lines")


def evolving_graph(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The initial graph (src, dst, cnt), and the batches (batch_id, op, src, dst, cnt), of ``kept_lines``."""
    lines = kept_lines(spark, sf_dir) if lines is None else lines
    first = F.col("year") <= FIRST_YEARS
    initial = lines.where(first).groupBy("src", "dst").agg(F.count("*").alias("cnt"))
    own = F.col("year") - FIRST_YEARS - 1
    returned = F.coalesce(*[F.when(F.col("year") <= last, b) for b, last in RETURNS.items()], own)
    ends = [F.col("src"), F.col("dst")]
    asked = lines.where(F.col("flag") == "R").select(returned.cast("long").alias("batch_id"), F.lit("d").alias("op"), *ends).unionByName(lines.where(~first).select(own.cast("long").alias("batch_id"), F.lit("a").alias("op"), *ends))
    batches = asked.groupBy("batch_id", "op", "src", "dst").agg(F.count("*").alias("cnt"))
    return initial, batches
