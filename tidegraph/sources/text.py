"""Readers and writers of the engine's text formats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import as_export
from ..plans.prefix import running_sum
from ..plans.state import settled
from ..schema import BATCH_SIZES, LARGEST_ID, UNREACHABLE, UPDATES, require

_COMMENT = r"^\s*([#%].*)?$"


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where(~F.col("value").rlike(_COMMENT))
    return lines.select(F.split(F.trim(F.col("value")), r"\s+").alias("f"))


def _id(column: Column, strict: bool) -> Column:
    got = column.cast("decimal(20,0)")
    if not strict:
        return got.cast("long")
    ok = column.rlike(r"^\d{1,10}$") & (got <= LARGEST_ID)
    return F.when(ok, got.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not a vertex id: "), F.coalesce(column, F.lit("")))).cast("long"))


def compress(pairs: DataFrame) -> DataFrame:
    """Occurrences (src, dst) as (src, dst, cnt): parallel edges and loops are kept as counts."""
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("cnt"))


def read_edge_list(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(src, dst) occurrences of ``src dst [weight]`` lines; blank lines and # or % comments are skipped.

    A weight is ignored.  With ``strict``, a line of other than two fields, or an id outside of
    0 to 2**32 - 1, stops the read; else such a line is an error of the cast.
    """
    f = _fields(spark, path)
    if strict:
        f = f.withColumn("f", F.when(F.size("f") == 2, F.col("f")).otherwise(F.raise_error(F.lit("an edge line must have two fields")).cast("array<string>")))
    return f.select(_id(F.col("f")[0], strict).alias("src"), _id(F.col("f")[1], strict).alias("dst"))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Undirected pairs (src < dst, 0-based, distinct) of a ``pattern symmetric`` coordinate file.

    The banner and the size line are checked; loops and repeated pairs are dropped.
    """
    head = [r[0] for r in spark.read.text(path).limit(200).collect()]
    if not head or head[0].lower().split()[:1] != ["%%matrixmarket"] or head[0].lower().split()[-2:] != ["pattern", "symmetric"]:
        raise ValueError("not a MatrixMarket file of kind pattern symmetric")
    size = next(x for x in head if x.strip() and not x.startswith("%"))
    n = int(size.split()[0])
    f = _fields(spark, path).where(F.size("f") == 2)  # the size line has three fields
    a, b = F.col("f")[0].cast("long") - 1, F.col("f")[1].cast("long") - 1
    pairs = f.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
    bad = (F.col("src") < 0) | (F.col("dst") >= n)
    return pairs.where(F.when(bad, F.raise_error(F.lit("an index is outside of the matrix")).cast("boolean")).otherwise(F.col("src") != F.col("dst"))).distinct()


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(place, record) of files of fixed-length records, read in splits; place is the byte offset in the file."""
    rows = spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable",
        conf={"fixedlengthinputformat.record.length": str(size)},
    )
    return spark.createDataFrame(rows, "place bigint, record binary")


def read_packed_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of binary files of little-endian 64-bit words, source in the high half.  Files are split, whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u8")
            yield pa.RecordBatch.from_arrays([pa.array((words >> np.uint64(32)).astype(np.int64)), pa.array((words & np.uint64(0xFFFFFFFF)).astype(np.int64))], ["src", "dst"])

    return _records(spark, path, 8).select("record").mapInArrow(run, "src bigint, dst bigint")


def read_domain_map(spark: SparkSession, path: str) -> DataFrame:
    """(v, owner) of a binary file with a little-endian 16-bit number for each vertex in turn: 0 or 1, the side that owns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2")
            if (owner > 1).any():
                raise ValueError("an owner must be 0 or 1")
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy() // 2), pa.array(owner.astype(np.int32))], ["v", "owner"])

    return _records(spark, path, 2).mapInArrow(run, "v bigint, owner int")


def in_file_order(spark: SparkSession, path: str) -> tuple[DataFrame, list[Column]]:
    """The fields of text files, and columns whose order is that of the lines: file, place of the block, place in the block."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    lines = settled(lines.where(~F.col("value").rlike(_COMMENT)).select(F.split(F.trim(F.col("value")), r"\s+").alias("f"), "_file", "_block", "_at"))
    return lines, [F.col("_file"), F.col("_block"), F.col("_at")]


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    """(seq, op, src, dst) of ``a|d src dst [weight]`` lines; seq counts from 0 in the order of files by name, and of lines."""
    lines, order = in_file_order(spark, path)
    f = running_sum(lines, order, F.lit(1), "seq")
    return f.select("seq", F.col("f")[0].alias("op"), F.col("f")[1].cast("long").alias("src"), F.col("f")[2].cast("long").alias("dst"))


def read_batch_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(batch_id, add_count, del_count) of ``adds deletes`` lines, in the file's order."""
    lines, order = in_file_order(spark, path)
    return running_sum(lines, order, F.lit(1), "batch_id").select("batch_id", F.col("f")[0].cast("long").alias("add_count"), F.col("f")[1].cast("long").alias("del_count"))


def assign_batches(updates: DataFrame, sizes: DataFrame, max_batches: int | None = None) -> DataFrame:
    """``updates`` with batch_id: batch i takes the next add_count of all adds and the next del_count of all deletes.

    The order of adds among deletes does not matter.  Updates beyond the last batch are dropped.
    Positions are counted by ranges of seq, so no task sees more than its share of the stream.
    """
    updates, sizes = require(updates, UPDATES, "updates"), require(sizes, BATCH_SIZES, "batch sizes")
    bad = updates.where(~F.col("op").isin("a", "d") | F.col("op").isNull()).limit(1).count()
    if bad:
        raise ValueError("an update's op must be a or d")
    before = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)  # a row a batch
    sums = sizes.select("batch_id", "add_count", "del_count", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("add_count", "adds"), ("del_count", "dels"))])
    kinds = F.array(*[F.struct(F.lit(op).alias("op"), F.col(lo).alias("lo"), (F.col(lo) + F.col(c)).alias("hi")) for op, lo, c in (("a", "adds", "add_count"), ("d", "dels", "del_count"))])
    ranges = sums.select("batch_id", F.explode(kinds).alias("r")).select("batch_id", "r.*")
    if max_batches is not None:
        ranges = ranges.where(F.col("batch_id") < max_batches)
    placed = positions(updates, "seq", "op")
    return placed.join(ranges, (placed.op == ranges.op) & (F.col("position") >= F.col("lo")) & (F.col("position") < F.col("hi"))).select("batch_id", "seq", placed.op, "src", "dst")


def positions(rows: DataFrame, order: str, group: str) -> DataFrame:
    """``rows`` with ``position``, counted from 0 in the order within its group."""
    return running_sum(rows, [F.col(order)], F.lit(1), "position", group)


def write_state(state: DataFrame, path: str, infinity: str | int = UNREACHABLE) -> None:
    """``v value parent buffer`` lines in the order of v; the buffer equals the value."""
    value = as_export(F.col("value"), infinity)
    lines = state.select("v", F.concat_ws(" ", "v", value, as_export(F.col("parent"), infinity), value).alias("value"))
    lines.orderBy("v").select("value").write.mode("overwrite").text(path)


def write_distances(state: DataFrame, path: str) -> None:
    """``v distance`` lines, INF where unreachable."""
    state.select("v", F.concat_ws(" ", "v", as_export(F.col("value"), "INF")).alias("value")).orderBy("v").select("value").write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """The columns of each row, space-separated, in the order of the first: labels, ranks, edges and updates."""
    first = rows.columns[0]
    rows.select(F.col(first).alias("_o"), F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns]).alias("value")).orderBy("_o", "value").select("value").write.mode("overwrite").text(path)


def report(row: DataFrame) -> DataFrame:
    """A JSON text for each row of metrics."""
    return row.select(F.to_json(F.struct(*row.columns)).alias("report"))
