import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidegraph.operators import checks
from tidegraph.operators.programs import BFS, SSSP, all_vertices, solve
from tidegraph.sources import text
from tidegraph.streaming.engine import StreamingGraph


def test_text_formats(spark, tmp_path):
    (tmp_path / "g").write_text("# graph\n0 1 9\n0\t1\n\n 1   2 3\n")
    edges = text.compress(text.read_edge_list(spark, str(tmp_path / "g")))
    assert sorted(map(tuple, edges.collect())) == [(0, 1, 2), (1, 2, 1)]
    with pytest.raises(Exception, match="two fields"):
        text.read_edge_list(spark, str(tmp_path / "g"), strict=True).collect()
    (tmp_path / "big").write_text("0 4294967296\n")
    with pytest.raises(Exception, match="vertex id"):
        text.read_edge_list(spark, str(tmp_path / "big"), strict=True).collect()
    (tmp_path / "m").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% x\n3 3 4\n1 2\n2 1\n3 3\n3 2\n")
    assert sorted(map(tuple, text.read_matrix_market(spark, str(tmp_path / "m")).collect())) == [(0, 1), (1, 2)]
    (tmp_path / "bad").write_text("%%MatrixMarket matrix array real general\n1 1\n")
    with pytest.raises(ValueError):
        text.read_matrix_market(spark, str(tmp_path / "bad"))
    (tmp_path / "p").write_bytes(b"".join((a << 32 | b).to_bytes(8, "little") for a, b in ((1, 2), (4294967295, 7))))
    assert sorted(map(tuple, text.read_packed_pairs(spark, str(tmp_path / "p")).collect())) == [(1, 2), (4294967295, 7)]
    (tmp_path / "d").write_bytes(b"".join(x.to_bytes(2, "little") for x in (0, 1, 1)))
    assert sorted(map(tuple, text.read_domain_map(spark, str(tmp_path / "d")).collect())) == [(0, 0), (1, 1), (2, 1)]
    (tmp_path / "wrong").write_bytes(b"\2\0")
    with pytest.raises(Exception, match="0 or 1"):
        text.read_domain_map(spark, str(tmp_path / "wrong")).collect()


def test_updates_keep_the_order_of_files_and_lines(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for i in range(4):
        (tmp_path / "many" / f"{i}.txt").write_text("# x\n" + "".join(f"a {i} {j} 1\n" for j in range(50)))
    rows = text.read_updates(spark, str(tmp_path / "many")).orderBy("seq").collect()
    assert [(r.seq, r.src, r.dst) for r in rows] == [(50 * i + j, i, j) for i in range(4) for j in range(50)]


def test_batches_take_adds_and_deletes_by_count(spark, tmp_path):
    (tmp_path / "u").write_text("".join(f"a 0 {i} 1\n" for i in range(10)) + "".join(f"d 1 {i} 1\n" for i in range(10)))
    (tmp_path / "s").write_text("1 9\n9 1\n")
    out = text.assign_batches(text.read_updates(spark, str(tmp_path / "u")), text.read_batch_sizes(spark, str(tmp_path / "s")))
    got = {(r.batch_id, r.op): r["n"] for r in out.groupBy("batch_id", "op").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, "a"): 1, (0, "d"): 9, (1, "a"): 9, (1, "d"): 1}
    assert [r.dst for r in out.where("batch_id = 0 and op = 'a'").collect()] == [0]
    with pytest.raises(ValueError):
        text.assign_batches(spark.createDataFrame([(0, "x", 1, 2)], "seq long, op string, src long, dst long"), text.read_batch_sizes(spark, str(tmp_path / "s")))


def test_sinks(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 1)], "src long, dst long, cnt long")
    state = all_vertices(solve(edges, SSSP, 3), 3)
    text.write_state(state, str(tmp_path / "a"))
    text.write_distances(state, str(tmp_path / "b"))
    read = lambda name: [r[0] for r in spark.read.text(str(tmp_path / name)).orderBy("value").collect()]
    assert read("a") == ["0 0 4294967295 0", "1 2 0 2", "2 4294967295 4294967295 4294967295"]
    assert read("b") == ["0 0", "1 2", "2 INF"]
    text.write_rows(state.select("v", F.col("value")), str(tmp_path / "c"))
    assert read("c")[:2] == ["0 0", "1 2"]
    assert '"reachable":2' in text.report(checks.reachable_count(state)).first().report
    assert checks.ordered_checksum(state) == checks.ordered_checksum(state.repartition(3))


def test_stream_is_applied_once(spark, tmp_path):
    from collections import Counter

    bag = Counter([(0, 1), (0, 1), (1, 2), (2, 3), (0, 3)])
    edges = spark.createDataFrame([(u, v, c) for (u, v), c in bag.items()], "src long, dst long, cnt long")
    batches = [[("d", 0, 3), ("a", 3, 0)], [("d", 0, 1), ("d", 9, 9), ("a", 1, 3)], [("d", 1, 2)]]
    for i, batch in enumerate(batches):
        spark.createDataFrame([(i, *b) for b in batch], "batch_id long, op string, src long, dst long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    files = sorted((tmp_path / "in").glob("*/part-*"))
    (tmp_path / "stream").mkdir()
    import os
    import shutil

    for i, f in enumerate(files):
        shutil.copy(f, tmp_path / "stream" / f"{i}.parquet")
        os.utime(tmp_path / "stream" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    graph = StreamingGraph(spark, str(tmp_path / "graph"), BFS, 4)
    graph.start(edges)
    graph.run(str(tmp_path / "stream"), str(tmp_path / "c1")).awaitTermination()
    for batch in batches:
        bag = oracle.apply(4, bag, batch)[1]
    assert graph.published() == 3
    assert {r.v: r.value for r in graph.state().collect()} == oracle.solve("bfs", 4, bag)
    graph.run(str(tmp_path / "stream"), str(tmp_path / "c2")).awaitTermination()  # delivered again, as after a lost checkpoint
    assert graph.published() == 3 and Counter({(r.src, r.dst): r.cnt for r in graph.edges().collect()}) == bag
    assert sorted(x.name for x in (tmp_path / "graph" / "state").iterdir()) == ["2", "3"]  # older epochs are deleted
    with pytest.raises(ValueError):
        graph.store(0)
    import json

    reports = sorted((json.loads(r.report) for r in graph.reports().collect()), key=lambda x: x["batch_id"])
    assert [(x["additions"], x["deletions"], x["missing_deletes"]) for x in reports] == [(1, 1, 0), (1, 2, 1), (0, 1, 0)] and all(x["program"] == "bfs" for x in reports)
    with pytest.raises(ValueError):
        graph.apply(7, edges.limit(0).select(F.lit("a").alias("op"), "src", "dst"))
    ranks = StreamingGraph(spark, str(tmp_path / "ranks"), None, 4)
    ranks.start(edges)
    assert ranks.apply(0, spark.createDataFrame(batches[0], "op string, src long, dst long")) and ranks.state().count() == 4
