"""Cutting the lineage of iterative plans, with storage that outlives executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_databases: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; a temporary one is set only where there is none, in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegraph-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "rounds") -> str:
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    """The catalog's database of this application's settled tables: one statement drops what a failed run left."""
    name = "tidegraph_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    if name not in _databases:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
        _databases.add(name)
    return name


def settled(df: DataFrame, name: str = "rounds", codec: str = "lz4", key: str | None = None, dealt: bool = False, sort: Sequence[str] = (), path: str | None = None, parts: int | None = None, dictionary: bool = True, onto: DataFrame | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and later rounds start from it, not from its plan.

    With ``key``, the table is dealt out by that column, one file a shuffle partition, and the catalog
    knows it: joins and aggregations by the key do not move it again, and filters on literal keys read only
    the buckets that can hold them.  ``dealt`` says that ``df`` ends in an exchange by the key already (into ``parts``, or as many as shuffles
    have); files are sorted by ``sort``.  Without ``dictionary``, long binary values are not looked up among those before them.  ``onto`` is a table settled in the same way,
    to which the rows are added.
    """
    spark = df.sparkSession
    path = path or (onto._settled_path if onto is not None else new_path(spark, name))
    if key is None:
        df.write.option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        parts, table = parts or int(spark.conf.get("spark.sql.shuffle.partitions")), onto._settled_table if onto is not None else f"{_scratch(spark)}.settled_{uuid.uuid4().hex}"
        writer = (df if dealt else df.repartition(parts, key)).write.bucketBy(parts, key)
        (writer.sortBy(*sort) if sort else writer).option("path", path).option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).format("parquet").mode("error" if onto is None else "append").saveAsTable(table)
        out = spark.table(table)
        out._settled_table = table
    out._settled_path = path
    return out


def reopened(spark: SparkSession, path: str, schema: StructType, key: str, parts: int) -> DataFrame:
    """A table that ``settled`` wrote with a key, maybe in another session."""
    table = f"{_scratch(spark)}.settled_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {parts} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def discard(*tables: DataFrame | None) -> None:
    """Deletes settled tables that no later plan reads; other frames are left alone."""
    for df in tables:
        path = getattr(df, "_settled_path", None) if df is not None else None
        if path is None:
            continue
        spark = df.sparkSession
        if getattr(df, "_settled_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {df._settled_table}")
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
