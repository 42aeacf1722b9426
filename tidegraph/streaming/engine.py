"""Update batches as a stream: each micro-batch is applied, repaired and stored once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.live import EdgeIndex, Live
from ..operators.pagerank import pagerank, update_pagerank
from ..operators.programs import BFS, LABEL_WITNESS, SSSP, MinProgram, solve
from ..operators.repair import update
from ..operators.store import EdgeStore
from ..plans.layers import Layered
from ..plans.state import reopened, settled
from ..schema import EDGES, RANKS, STATE
from ..sources.text import report

BATCH = T.StructType([T.StructField("batch_id", T.LongType()), T.StructField("op", T.StringType()), T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
_EDGES = T.StructType([T.StructField(c, T.LongType()) for c in ("src", "dst", "cnt")])
_PUBLISHED = T.StructType([T.StructField(c, T.LongType()) for c in ("epoch", "base", "rows", "touched")])


#: The tables of a ``Live``: schema, key, unique columns, and the column whose null says that a row is gone.
_LIVE = {"out": (EDGES, "src", ("src", "dst"), "cnt"), "into": (EDGES, "dst", ("src", "dst"), "cnt"), "state": (STATE, "v", ("v",), "value")}
_LIVE_PUBLISHED = "epoch long, program string, n long, parts long, " + ", ".join(f"{t}_base long, {t}_rows long, {t}_over long" for t in _LIVE)


class LiveFolder:
    """A ``Live`` in a folder that survives the session: both sides of its edges and its state, published together.

    An epoch writes what has changed since its bases, and a base only when there is a new one; it counts when one small file
    names all of its tables.  A publication that was cut short leaves the epoch before as the last one, and what it wrote is written over.
    """

    def __init__(self, spark: SparkSession, folder: str, keep: int = 2):
        self.spark, self.folder, self.keep = spark, folder.rstrip("/"), keep
        self._bases: dict[str, tuple[DataFrame, int]] = {}

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _clear(self, path: str) -> None:
        fs, where = self._files(path)
        fs.delete(where, True)

    def _rows(self) -> list[Row]:
        """The published epochs, the last one first."""
        fs, where = self._files(f"{self.folder}/published")
        if not fs.exists(where):
            return []
        return self.spark.read.schema(_LIVE_PUBLISHED).parquet(f"{self.folder}/published/*").orderBy(F.desc("epoch")).collect()  # at most keep rows

    def _write(self, df: DataFrame, name: str, kind: str, epoch: int) -> DataFrame:
        path, key = f"{self.folder}/{kind}/{name}/{epoch}", _LIVE[name][1]
        self._clear(path)
        return settled(df, key=key, sort=[key], path=path)

    def _commit(self, row: tuple, epoch: int) -> None:
        self.spark.createDataFrame([row], _LIVE_PUBLISHED).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/published/{epoch}")

    def publish(self, live: Live, epoch: int) -> None:
        parts, bases = int(self.spark.conf.get("spark.sql.shuffle.partitions")), dict(self._bases)
        row: list = [epoch, live.program.name, live.n, parts]
        for name, table in {"out": live.edges.out, "into": live.edges.into, "state": live.state}.items():
            if name not in bases or bases[name][0] is not table.base:
                self._write(table.base, name, "base", epoch)
                bases[name] = (table.base, epoch)
            more = table.changes()
            row += [bases[name][1], table.size, -1 if more is None else self._write(more, name, "over", epoch).count()]
        self._commit(tuple(row), epoch)
        self._bases = bases
        rows = self._rows()
        needed = {(t, r[f"{t}_base"]) for r in rows[: self.keep] for t in _LIVE}
        for r in rows[self.keep:]:
            self._clear(f"{self.folder}/published/{r.epoch}")
            for t in _LIVE:
                self._clear(f"{self.folder}/over/{t}/{r.epoch}")
                if (t, r[f"{t}_base"]) not in needed:
                    self._clear(f"{self.folder}/base/{t}/{r[f'{t}_base']}")

    def published(self) -> int:
        """The last epoch, -1 if there is none."""
        rows = self._rows()
        return rows[0].epoch if rows else -1

    def open(self, epoch: int | None = None) -> Live:
        """The state of a kept epoch, the last one if none is given."""
        row = next((r for r in self._rows() if epoch is None or r.epoch == epoch), None)
        if row is None:
            raise ValueError(f"epoch {epoch} is not published, or no longer kept")
        tables = {}
        for name, (schema, key, unique, value) in _LIVE.items():
            base = reopened(self.spark, f"{self.folder}/base/{name}/{row[f'{name}_base']}", schema, key, row.parts)
            over = None if row[f"{name}_over"] < 0 else reopened(self.spark, f"{self.folder}/over/{name}/{row.epoch}", schema, key, row.parts)
            tables[name] = Layered(base, row[f"{name}_rows"], key, unique, value, over, max(0, row[f"{name}_over"]))
            self._bases[name] = (base, row[f"{name}_base"])
        program = {p.name: p for p in (BFS, SSSP, LABEL_WITNESS)}[row.program]
        return Live(EdgeIndex(tables["out"], tables["into"]), tables["state"], program, row.n)


@dataclass
class StreamingGraph:
    """A graph and one program's result, in a folder that survives the session.

    ``folder`` holds base/<epoch>, overlay/<epoch>, state/<epoch> and the published epochs.  An epoch writes the pairs touched
    since its base, not the whole graph, and its state; a new base is written when the overlay has grown.  An epoch is published by one
    small file after its tables are whole, so a batch that is delivered again, or was cut short, is applied once.
    Epoch 0 is the initial graph; batch i is epoch i + 1.  Tables of epochs older than the last ``keep`` are deleted.
    """

    spark: SparkSession
    folder: str
    program: MinProgram | None
    n: int
    source: int = 0
    keep: int = 2
    bucket: int | None = None

    def _path(self, kind: str, epoch: int | str) -> str:
        return f"{self.folder.rstrip('/')}/{kind}/{epoch}"

    def _files(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _row(self, epoch: int | None = None) -> Row | None:
        """The published row (epoch, base, rows, touched) of an epoch, or of the last one; None if there is none."""
        fs, where = self._files(self._path("published", ""))
        if not fs.exists(where):
            return None
        rows = self.spark.read.schema(_PUBLISHED).parquet(self._path("published", "*"))
        return (rows if epoch is None else rows.where(F.col("epoch") == epoch)).orderBy(F.desc("epoch")).first()

    def published(self) -> int:
        """The last published epoch, -1 if there is none."""
        row = self._row()
        return -1 if row is None else row.epoch

    def _store(self, epoch: int, store: EdgeStore, state: DataFrame, base: int) -> None:
        if store.overlay is None:  # a new base
            base = epoch
            store.base.write.mode("overwrite").parquet(self._path("base", epoch))
        else:
            store.overlay.write.mode("overwrite").parquet(self._path("overlay", epoch))
        state.write.mode("overwrite").parquet(self._path("state", epoch))
        row = self.spark.createDataFrame([(epoch, base, store.rows, store.touched if store.overlay is not None else -1)], _PUBLISHED)
        row.coalesce(1).write.mode("overwrite").parquet(self._path("published", epoch))
        self._reclaim(epoch)

    def _reclaim(self, epoch: int) -> None:
        """Deletes the tables of epochs that are no longer kept, and bases that no kept epoch needs."""
        rows = {r.epoch: r for r in self.spark.read.schema(_PUBLISHED).parquet(self._path("published", "*")).collect()}  # a row a kept epoch
        old = [e for e in rows if e <= epoch - self.keep]
        needed = {r.base for e, r in rows.items() if e not in old}
        for e in old:
            for kind in ("overlay", "state", "published", *(() if rows[e].base in needed else ("base",))):
                fs, where = self._files(self._path(kind, rows[e].base if kind == "base" else e))
                fs.delete(where, True)

    def start(self, edges: DataFrame) -> None:
        """Solves the initial graph, unless an epoch is published already."""
        if self.published() < 0:
            store = EdgeStore.of(edges)
            result = solve(store.base, self.program, self.n, self.source) if self.program else pagerank(store.base, self.n)
            self._store(0, store, result, 0)

    def store(self, epoch: int | None = None) -> EdgeStore:
        """The edges of a kept epoch, the last one if none is given."""
        row = self._row(epoch)
        if row is None:
            raise ValueError(f"epoch {epoch} is not published, or no longer kept")
        base = self.spark.read.schema(_EDGES).parquet(self._path("base", row.base))
        if row.touched < 0:
            return EdgeStore(base, row.rows)
        return EdgeStore(base, row.rows, self.spark.read.schema(_EDGES).parquet(self._path("overlay", row.epoch)), row.touched)

    def edges(self, epoch: int | None = None) -> DataFrame:
        return self.store(epoch).view()

    def state(self, epoch: int | None = None) -> DataFrame:
        return self.spark.read.schema(STATE if self.program else RANKS).parquet(self._path("state", self.published() if epoch is None else epoch))

    def apply(self, batch_id: int, batch: DataFrame) -> bool:
        """Applies batch ``batch_id``; False if it was published before.  Batches must come in order; an empty one is an epoch too."""
        row = self._row()
        last = -1 if row is None else row.epoch
        if batch_id + 1 <= last:
            return False
        if batch_id != last:
            raise ValueError(f"batch {batch_id} after epoch {last}: a batch is missing")
        store, state = self.store(last), self.state(last)
        done = update(store, state, batch, self.program, self.n, bucket=self.bucket) if self.program else update_pagerank(store, state, batch, self.n)
        self._store(batch_id + 1, done.store, done.state, row.base)
        more = done.metrics.withColumn("batch_id", F.lit(batch_id)).withColumn("rounds", F.lit(done.rounds)).withColumn("program", F.lit(self.program.name if self.program else "pagerank"))
        report(more.withColumn("stored_pairs", F.lit(done.store.size))).coalesce(1).write.mode("overwrite").text(self._path("reports", batch_id))
        return True

    def reports(self) -> DataFrame:
        """The JSON report of each applied batch: its metrics, the rounds of its repair, and the rows of the edge store."""
        return self.spark.read.text(self._path("reports", "*")).withColumnRenamed("value", "report")

    def _micro_batch(self, rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        for (batch_id,) in sorted(rows.select("batch_id").distinct().collect()):
            self.apply(batch_id, rows.where(F.col("batch_id") == batch_id))
        rows.unpersist()

    def run(self, updates: str, checkpoint: str, max_batches: int | None = None) -> StreamingQuery:
        """Reads update files (Parquet, one file a batch, in the order of their times) as far as there are any."""
        stream = self.spark.readStream.schema(BATCH).option("maxFilesPerTrigger", 1).parquet(updates)
        if max_batches is not None:
            stream = stream.where(F.col("batch_id") < max_batches)
        return stream.writeStream.foreachBatch(self._micro_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
