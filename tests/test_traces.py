"""Binary traces: round trips, the records of hand-made files, and damaged ones."""

import struct

import pytest
from pyspark.sql import functions as F

from tidegraph.sources.traces import read_region, read_trace, write_trace


def test_cache_round_trip(spark, tmp_path):
    rows = [(b, 100 + b, v, v % 7) for b in range(5) for v in range(b * 300)]
    frame = spark.createDataFrame(rows, "batch_id long, capacity_edges long, vertex long, degree long")
    write_trace(frame.repartition(3), f"{tmp_path}/t", "cache")
    back = read_trace(spark, f"{tmp_path}/t", "cache", records=256)
    assert back.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, back.select("batch_id", "capacity_edges", "vertex", "degree").collect())) == rows
    assert {(r.batch_id, r["count"]) for r in read_trace(spark, f"{tmp_path}/t", "cache", "batches").collect()} == {(b, b * 300) for b in range(1, 5)}
    assert not [p for p in (tmp_path / "t").iterdir() if p.name.startswith("_")]


def test_empty_cache_batch_repeats_the_one_before(spark, tmp_path):
    raw = struct.pack("<Q", 0x4631434143484531) + struct.pack("<IQQ", 0, 9, 2) + struct.pack("<IIII", 4, 1, 5, 2) + struct.pack("<IQQ", 1, 8, 0)
    (tmp_path / "a").write_bytes(raw)
    rows = sorted(map(tuple, read_trace(spark, f"{tmp_path}/a", "cache").collect()))
    assert rows == [(0, 9, 4, 1, 0), (0, 9, 5, 2, 1), (1, 8, 4, 1, 0), (1, 8, 5, 2, 1)]
    for name, damaged in (("cut", raw[:-3]), ("short", raw[:30]), ("magic", b"\0" + raw[1:]), ("none", b"")):
        (tmp_path / name).write_bytes(damaged)
        with pytest.raises(Exception, match="trace"):
            read_trace(spark, f"{tmp_path}/{name}", "cache").collect()


def test_replay_and_hotness(spark, tmp_path):
    state = spark.createDataFrame([(b, v, v * 2, 2**32 - 1) for b in (3, 4) for v in range(4)], "batch_id long, vertex long, value long, parent long")
    write_trace(state, f"{tmp_path}/r", "replay", "final")
    assert sorted(map(tuple, read_trace(spark, f"{tmp_path}/r", "replay", "final").drop("place").collect())) == sorted(map(tuple, state.collect()))
    assert read_trace(spark, f"{tmp_path}/r", "replay", "input").count() == 0
    hot = spark.createDataFrame([(-1, 7, 1, -5, 2**62, v, 3, 4) for v in range(3)], "batch_id long, capacity_edges long, desired long, order_hash long, desired_hash long, vertex long, score long, degree long")
    write_trace(hot, f"{tmp_path}/h", "hotness", vertices=3)
    assert sorted(map(tuple, read_trace(spark, f"{tmp_path}/h", "hotness").drop("place").collect())) == sorted(map(tuple, hot.collect()))
    (tmp_path / "v2").write_bytes(struct.pack("<QI", 0x4631525354415445, 2))
    with pytest.raises(Exception, match="not a trace of this kind"):
        read_trace(spark, f"{tmp_path}/v2", "replay", "final").collect()


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(0, 1, 1, 1), (1, 1, 2**33, 1)], "batch_id long, capacity_edges long, vertex long, degree long")
    with pytest.raises(Exception, match="32 bits"):
        write_trace(bad, f"{tmp_path}/bad", "cache")
    assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())


def test_region(spark, tmp_path):
    vertices, degrees, offsets, sources, events = [1, 2, 3, 4], [2, 1, 0, 3], [0, 2, 5, 6, 7], [9, 9, 1, 8, 8, 2, 10], [1, 1, 4, 9]
    start = struct.pack("<QI", 0x4631434F4D503031, 2)
    body = lambda off: struct.pack("<IQQQB", 6, 4, 7, 4, 1) + struct.pack("<4I", *vertices) + struct.pack("<4I", *degrees) + struct.pack("<5Q", *off) + struct.pack("<7I", *sources) + struct.pack("<4I", *events)
    (tmp_path / "g").write_bytes(start + body(offsets))
    rows = read_region(spark, f"{tmp_path}/g", 3).orderBy("place").collect()
    assert [(r.batch_id, r.vertex, r.out_degree, r.lo, r.hi) for r in rows] == [(6, v, d, a, b) for v, d, a, b in zip(vertices, degrees, offsets, offsets[1:])]
    got = read_trace(spark, f"{tmp_path}/g", "region", "sources").join(read_region(spark, f"{tmp_path}/g").withColumnRenamed("place", "i"), "batch_id").where("place >= lo and place < hi")
    assert {(r.vertex, r.n) for r in got.groupBy("vertex").agg(F.count("*").alias("n")).collect()} == {(1, 2), (2, 3), (3, 1), (4, 1)}
    assert [r.source for r in read_trace(spark, f"{tmp_path}/g", "region", "events").orderBy("place").collect()] == events
    (tmp_path / "off").write_bytes(start + body([0, 2, 5, 6, 8]))
    with pytest.raises(Exception, match="offsets"):
        read_region(spark, f"{tmp_path}/off").collect()
