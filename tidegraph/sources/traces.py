"""Binary traces of an evolving graph as a Spark data source: ``spark.read.format("trace")`` after ``register(spark)``.

A trace is a header and a run of batches; a batch is a fixed head with counts, and sections of records.  The reader looks at the heads
only, and deals out ranges of records by their offsets, whatever the size of a batch; tasks decode theirs into Arrow batches.  The
writer makes a folder of traces, one a task that has rows: files get their names when all tasks are done, so a failed write leaves none.

Options: ``kind`` (below), ``section`` ("batches" for the heads), ``records`` (of one read task).  ``path`` is a file, or a folder of
which the files are read in the order of their names.  A truncated file, another magic number or version, and counts that do not fit
are errors.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Records of one read task.
RECORDS = 1 << 20


@dataclass(frozen=True)
class Section:
    """Records of one kind in a batch; ``count`` is the head's field that counts them."""

    count: str
    dtype: np.dtype
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Format:
    magic: int
    start: np.dtype
    head: np.dtype
    sections: dict[str, Section]
    #: Constant fields of the start, besides the magic number.
    fixed: dict[str, int] = field(default_factory=dict)
    #: A batch without records stands for the records of the one before.
    repeats: bool = False


def _dtype(*fields: tuple[str, str]) -> np.dtype:
    return np.dtype(list(fields))


_STATE = _dtype(("vertex", "<u4"), ("value", "<u4"), ("parent", "<u4"))
#: Magic numbers, versions and layouts of the file formats, little-endian and without padding.
FORMATS = {
    "cache": Format(
        0x4631434143484531, _dtype(("magic", "<u8")), _dtype(("batch_id", "<u4"), ("capacity_edges", "<u8"), ("count", "<u8")),
        {"records": Section("count", _dtype(("vertex", "<u4"), ("degree", "<u4")), ("vertex", "degree"))}, repeats=True),
    "replay": Format(
        0x4631525354415445, _dtype(("magic", "<u8"), ("version", "<u4")), _dtype(("batch_id", "<u4"), ("input", "<u8"), ("final", "<u8")),
        {"input": Section("input", _STATE, ("vertex", "value", "parent")), "final": Section("final", _STATE, ("vertex", "value", "parent"))}, {"version": 1}),
    "hotness": Format(
        0x49313543414E4431, _dtype(("magic", "<u8"), ("vertices", "<u4")), _dtype(("batch_id", "<i4"), ("capacity_edges", "<u8"), ("desired", "<u4"), ("order_hash", "<u8"), ("desired_hash", "<u8"), ("count", "<u4")),
        {"records": Section("count", _dtype(("vertex", "<u4"), ("score", "<u4"), ("degree", "<u4")), ("vertex", "score", "degree"))}),
    "region": Format(
        0x4631434F4D503031, _dtype(("magic", "<u8"), ("version", "<u4")), _dtype(("batch_id", "<u4"), ("vertices", "<u8"), ("incoming", "<u8"), ("events", "<u8"), ("has_events", "u1")),
        {
            "vertices": Section("vertices", _dtype(("vertex", "<u4")), ("vertex",)), "degrees": Section("vertices", _dtype(("out_degree", "<u4")), ("out_degree",)),
            "offsets": Section("offsets", _dtype(("offset", "<u8")), ("offset",)), "sources": Section("incoming", _dtype(("source", "<u4")), ("source",)), "events": Section("events", _dtype(("source", "<u4")), ("source",)),
        }, {"version": 2}),
}
#: Sections that are read together, place by place.
TOGETHER = {("region", "vertices"): ("vertices", "degrees")}


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    system, where = _located(path)
    info = system.get_file_info(where)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(fs.FileSelector(where))
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))


def _exactly(file, dtype: np.dtype, n: int = 1) -> np.ndarray:
    raw = file.read(dtype.itemsize * n)
    if len(raw) != dtype.itemsize * n:
        raise ValueError("truncated trace")
    return np.frombuffer(raw, dtype)


def _counts(head: np.void, form: Format) -> dict[str, int]:
    """The records of each section; offsets are one more than vertices."""
    return {name: int(head["vertices"]) + 1 if s.count == "offsets" else int(head[s.count]) for name, s in form.sections.items()}


def heads(path: str, size: int, form: Format) -> Iterator[tuple[np.void, dict[str, tuple[int, int]]]]:
    """(head, {section: (offset, count)}) of each batch of one file, which is not read beyond its heads."""
    system, where = _located(path)
    with system.open_input_file(where) as file:
        start = _exactly(file, form.start)[0]
        if start["magic"] != form.magic or any(start[k] != x for k, x in form.fixed.items()):
            raise ValueError(f"{path} is not a trace of this kind")
        at, before = form.start.itemsize, None
        while at < size:
            file.seek(at)
            head = _exactly(file, form.head)[0]
            at += form.head.itemsize
            places = {}
            for name, count in _counts(head, form).items():
                places[name] = (at, count)
                at += count * form.sections[name].dtype.itemsize
            if at > size:
                raise ValueError("truncated trace")
            if "offsets" in places:
                lo, n = places["offsets"]
                file.seek(lo)
                first = _exactly(file, form.sections["offsets"].dtype)["offset"][0]
                file.seek(lo + 8 * (n - 1))
                if first != 0 or _exactly(file, form.sections["offsets"].dtype)["offset"][0] != head["incoming"]:
                    raise ValueError("the offsets of a region do not fit its sources")
            if form.repeats and before is not None and head["count"] == 0:
                places = before
            before = places
            yield head, places


@dataclass
class Range(InputPartition):
    path: str
    head: dict
    #: (section, offset, records) that are read side by side.
    parts: list[tuple[str, int, int]]
    place: int


class TraceReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names = schema.fieldNames()
        self.types = [pa.int64()] * len(self.names)
        self.path, self.kind, self.section = options["path"], options["kind"], options.get("section", "records")
        self.records = int(options.get("records", RECORDS))

    def partitions(self) -> list[InputPartition]:
        form, out = FORMATS[self.kind], []
        for path, size in _files(self.path):
            for head, places in heads(path, size, form):
                values = {n: int(np.int64(np.uint64(head[n]).view(np.int64))) if head[n].dtype.kind == "u" else int(head[n]) for n in form.head.names}
                if self.section == "batches":
                    out.append(Range(path, values, [], 0))
                    continue
                sections = TOGETHER.get((self.kind, self.section), (self.section,))
                total = places[sections[0]][1]
                for lo in range(0, total, self.records):
                    n = min(self.records, total - lo)
                    out.append(Range(path, values, [(s, places[s][0] + lo * form.sections[s].dtype.itemsize, n) for s in sections], lo))
        return out or [Range("", {}, [], -1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.place < 0:
            return
        columns = dict(part.head)
        n = 1
        if part.parts:
            form, n = FORMATS[self.kind], part.parts[0][2]
            system, where = _located(part.path)
            with system.open_input_file(where) as file:
                for name, at, count in part.parts:
                    file.seek(at)
                    got = _exactly(file, form.sections[name].dtype, count)
                    columns |= {c: got[c].astype(np.int64) for c in form.sections[name].columns}
            columns["place"] = np.arange(part.place, part.place + n)
        arrays = [pa.array(np.broadcast_to(np.asarray(columns[c], np.int64), n)) for c in self.names]
        yield pa.RecordBatch.from_arrays(arrays, self.names)


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None
    final: str | None


class TraceWriter(DataSourceArrowWriter):
    """Rows of one task must come batch by batch; the head's fields that are no counts are columns."""

    def __init__(self, schema: StructType, options: dict):
        self.path, self.kind, self.section, self.run = options["path"], options["kind"], options.get("section", "records"), uuid.uuid4().hex
        self.vertices = int(options.get("vertices", 0))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        form = FORMATS[self.kind]
        section, system, where, pending, file, first = form.sections[self.section], *_located(self.path), [], None, None
        counts = {s.count for s in form.sections.values()} | {"count"}
        temporary = f"{where.rstrip('/')}/_temporary-{self.run}/{uuid.uuid4().hex}"

        def flush() -> None:
            rows = pa.Table.from_batches(pending)
            head, body = np.zeros(1, form.head), np.zeros(rows.num_rows, section.dtype)
            for name in form.head.names:
                if name == section.count:
                    head[name] = rows.num_rows
                elif name not in counts:
                    head[name] = rows[name][0].as_py() & (1 << 8 * head[name].dtype.itemsize) - 1 if head[name].dtype.kind == "u" else rows[name][0].as_py()
            for c in section.columns:
                x = rows[c].to_numpy()
                if len(x) and (x.min() < 0 or x.max() >= 1 << 32):
                    raise ValueError(f"{c} has values that do not fit into 32 bits")
                body[c] = x
            file.write(head.tobytes() + body.tobytes())

        for batch in iterator:
            ids = batch.column("batch_id").to_numpy()
            for lo, hi in zip([0, *(np.flatnonzero(np.diff(ids)) + 1)], [*(np.flatnonzero(np.diff(ids)) + 1), len(ids)]):
                if hi == lo:
                    continue
                if file is None:
                    system.create_dir(temporary.rsplit("/", 1)[0], recursive=True)
                    file, first = system.open_output_stream(temporary), int(ids[lo])
                    start = np.zeros(1, form.start)
                    for name in form.start.names:
                        start[name] = form.magic if name == "magic" else form.fixed.get(name, self.vertices)
                    file.write(start.tobytes())
                if pending and pending[0].column("batch_id")[0].as_py() != ids[lo]:
                    flush()
                    pending = []
                pending.append(batch.slice(lo, hi - lo))
        if file is None:
            return Written(None, None)
        flush()
        file.close()
        return Written(temporary, f"trace-{first + (1 << 31):011d}-{uuid.uuid4().hex[:8]}")

    def _clear(self) -> None:
        system, where = _located(self.path)
        if system.get_file_info(f"{where}/_temporary-{self.run}").type == fs.FileType.Directory:
            system.delete_dir(f"{where}/_temporary-{self.run}")

    def commit(self, messages: list[Written | None]) -> None:
        system, where = _located(self.path)
        system.create_dir(where, recursive=True)
        for m in messages:
            if m is not None and m.temporary:
                system.move(m.temporary, f"{where.rstrip('/')}/{m.final}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class TraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trace"

    def schema(self) -> str:
        form, section = FORMATS[self.options["kind"]], self.options.get("section", "records")
        if section == "batches":
            return ", ".join(f"{n} bigint" for n in form.head.names)
        counts = {s.count for s in form.sections.values()} | {"count", "incoming"}
        names = [n for n in form.head.names if n not in counts and n != "has_events"]
        names += [c for s in TOGETHER.get((self.options["kind"], section), (section,)) for c in form.sections[s].columns]
        return ", ".join(f"{n} bigint" for n in [*names, "place"])

    def reader(self, schema: StructType) -> TraceReader:
        return TraceReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> TraceWriter:
        return TraceWriter(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TraceSource)


def read_trace(spark: SparkSession, path: str, kind: str, section: str = "records", records: int = RECORDS) -> DataFrame:
    """A section of a trace: the head's fields, the section's columns and ``place``, the record's position in its batch."""
    register(spark)
    return spark.read.format("trace").option("kind", kind).option("section", section).option("records", str(records)).load(path)


def write_trace(rows: DataFrame, path: str, kind: str, section: str = "records", vertices: int = 0) -> None:
    """Rows (batch_id, the head's other fields, the section's columns) as a folder of traces, each batch in one of them, its records in the order of their columns."""
    register(rows.sparkSession)
    columns = FORMATS[kind].sections[section].columns
    dealt = rows.repartition("batch_id").sortWithinPartitions("batch_id", *columns)
    dealt.write.format("trace").option("kind", kind).option("section", section).option("vertices", str(vertices)).mode("append").save(path)


def read_region(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """(batch_id, vertex, out_degree, place, lo, hi) of region traces: lo and hi are the places of the vertex's incoming rows in the section "sources"."""
    from pyspark.sql import functions as F

    vertices = read_trace(spark, path, "region", "vertices", records)
    offsets = read_trace(spark, path, "region", "offsets", records).select("batch_id", "place", "offset")
    return vertices.join(offsets.withColumnRenamed("offset", "lo"), ["batch_id", "place"]).join(offsets.select("batch_id", (F.col("place") - 1).alias("place"), F.col("offset").alias("hi")), ["batch_id", "place"])
