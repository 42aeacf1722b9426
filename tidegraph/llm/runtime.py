"""Session settings, row identities and shared storage used by the text operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.state import discard, settled

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "discard", "fresh", "prepare", "remainder", "row_hash", "sampled_labels", "stored", "table"]

#: Rows and bytes of an Arrow batch; with texts of a few KB, a Python worker holds some MB.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches, so that a Python worker's memory does not grow with the table."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str, key: str | None = None, dealt: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    return settled(df, name, "zstd", key, dealt)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column of that name is taken."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def row_hash(columns: Iterable[str], seed: int = 0) -> Column:
    """A 64-bit hash of the columns' values, nulls told from other values; another seed gives an independent hash."""
    parts = [F.lit(seed)]
    for c in columns:
        parts += [F.col(f"`{c}`").isNull(), F.col(f"`{c}`")]
    return F.xxhash64(*parts)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def sampled_labels(labels: DataFrame, column: str, parts: int, held: int, most: int) -> DataFrame:
    """At most about ``most`` labelled training rows (doc_id, label), chosen by a hash of doc_id.

    Rows with a null id or label, or whose remainder modulo ``parts`` is ``held``, are left out;
    of repeated ids one row stays.  ``most`` bounds the model's training set, and so what is broadcast.
    """
    rows = (
        labels.select("doc_id", F.col(column).cast("double").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (remainder(F.col("doc_id"), parts) != held))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return rows
