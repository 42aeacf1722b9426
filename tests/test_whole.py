"""Registered queries on small tables against plain Python."""

import datetime
import random
from collections import Counter

import pytest

from tests import oracle
from tidegraph.queries import QUERIES

N = 13


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with part and lineitem: orders of two lines, so each is one edge."""
    r = random.Random(11)
    edges = [(r.randrange(1, N), r.randrange(1, N), r.choice([1997, 1998, 1999, 2000, 2001]), r.choice("RN")) for _ in range(34)]
    rows = [(o, k, x, 1, 5.0, flag, datetime.date(year, 3, 1)) for o, (u, v, year, flag) in enumerate(edges) for k, x in ((1, u), (2, v))]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string, l_shipdate date").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(v,) for v in range(1, N)], "p_partkey long").write.parquet(f"{folder}/part.parquet")
    return folder, edges


def _reach(bag):
    reach = [{v} for v in range(N)]
    for _ in range(N):
        for u, v in bag:
            reach[u] |= reach[v]
    return reach


def test_labels_and_components_of_the_whole_graph(spark, tables):
    folder, edges = tables
    bag = Counter((u, v) for u, v, *_ in edges)
    got = lambda name: {r[0]: r[1] for r in QUERIES[name](spark, folder).collect()}
    reach = _reach(bag)
    both = _reach([*bag, *((v, u) for u, v in bag)])
    strong = {v: min(u for u in range(N) if u in reach[v] and v in reach[u]) for v in range(N)}
    weak = {v: min(both[v]) for v in range(N)}
    bfs = oracle.solve("bfs", N, bag, 1)
    assert got("min_label") == oracle.solve("min_label", N, bag)
    assert QUERIES["min_label_check"](spark, folder).first()[0] == 0
    assert got("weak_components") == weak
    assert got("strong_components") == strong
    assert QUERIES["reachable_count"](spark, folder).first()[0] == len(bfs)
    assert got("exported_distances") == {v: str(bfs.get(v, "INF")) for v in range(N)}
    assert got("local_ids") == {v: i for i, v in enumerate(sorted({x for p in bag for x in p}))}
    level = dict.fromkeys(set(strong.values()), 0)
    for _ in range(N):
        for u, v in bag:
            if strong[u] != strong[v]:
                level[strong[v]] = max(level[strong[v]], level[strong[u]] + 1)
    assert got("critical_levels") == level
    votes = Counter(weak.values())
    row = QUERIES["majority_component"](spark, folder).first()
    assert row.votes == max(votes.values()) and row.component == min(c for c, n in votes.items() if n == row.votes)


def test_every_batch_is_applied_in_order(spark, tables):
    folder, edges = tables
    bag = Counter((u, v) for u, v, year, _ in edges if year <= 1998)
    batches = [[("a", u, v) for u, v, y, _ in edges if y == year] for year in (1999, 2000, 2001)]
    for u, v, y, flag in edges:
        if flag == "R":
            batches[y - 1999 if y > 1998 else 0 if y <= 1995 else 1 if y <= 1997 else 2].append(("d", u, v))
    want = {"edges": set(), "metrics": set(), "bfs": set(), "min_label": set(), "final": set()}
    epochs = [bag]
    for b, batch in enumerate(batches):
        gd, ga, total = oracle.apply(N, bag, batch)
        for phase, g in (("delete", gd), ("add", ga)):
            want["edges"] |= {(b, phase, u, v, c) for (u, v), c in g.items()}
            for program in ("bfs", "min_label"):
                want[program] |= {(b, phase, v, x) for v, x in oracle.solve(program, N, g, 1).items()}
        want["metrics"].add((b, *total.values(), sum(ga.values())))
        want["final"] |= {(b, v, x) for v, x in oracle.solve("sssp", N, ga, 1).items()}
        bag = ga
        epochs.append(bag)
    got = lambda name, *cols: {tuple(r) for r in QUERIES[name](spark, folder).select(*cols).collect()}
    assert got("edges_after_batch", "batch_id", "phase", "src", "dst", "cnt") == want["edges"]
    assert got("batch_metrics", "*") == want["metrics"]
    assert got("bfs_after_batch", "*") == want["bfs"]
    assert got("min_label_after_batch", "*") == want["min_label"]
    assert got("sssp_final_state", "*") == want["final"]
    assert got("topology_audit", "*") == {(b, 0) for b in range(3)}
    ranks = {(r.batch_id, r.v): r["rank"] for r in QUERIES["pagerank_after_batch"](spark, folder).collect()}
    for b, g in enumerate(epochs[1:]):
        assert all(abs(ranks[b, v] - x) < 2e-3 for v, x in enumerate(oracle.pagerank(N, g)))
    assert {r.batch_id for r in QUERIES["cache_admission"](spark, folder).collect()} == {-1, 0, 1, 2}


def test_all_destinations_and_regions(spark, tables):
    folder, edges = tables
    bag = Counter((u, v) for u, v, *_ in edges)
    bfs = oracle.solve("bfs", N, bag, 1)
    got = lambda name: {tuple(r) for r in QUERIES[name](spark, folder).collect()}
    assert got("incoming_rows") == {(v, u, c) for (u, v), c in bag.items()}
    assert got("boundary_edges") == {(v % 4, u, v, c, u % 4 == v % 4) for (u, v), c in bag.items()}
    want = set()
    for k in range(4):
        into = [(u, v, c) for (u, v), c in bag.items() if v % 4 == k]
        over = [x for x in into if x[0] % 4 != k]
        near = [x for x in over if x[0] in bfs]
        total = lambda rows: sum(x[2] for x in rows)
        want.add((k, total(into), total(into) - total(over), total(over), len({x[0] for x in over}), total(near), len({x[1] for x in near})))
    assert got("region_report") == want
