import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidegraph.operators import analytics, checks, generate, pagerank, regions, repair, topology
from tidegraph.operators.components import connected_components, repair_components
from tidegraph.operators.programs import BFS, MIN_LABEL, SSSP, all_vertices, solve, vertex_range
from tidegraph.operators.store import EdgeStore

PROGRAMS = {"bfs": BFS, "sssp": SSSP, "min_label": MIN_LABEL}


def bag_frame(spark, bag):
    return spark.createDataFrame([(u, v, c) for (u, v), c in bag.items() if c > 0], "src long, dst long, cnt long")


def batch_frame(spark, batch):
    return spark.createDataFrame(batch, "op string, src long, dst long")


def values(state):
    return {r.v: r.value for r in state.collect()}


def as_bag(edges):
    return Counter({(r.src, r.dst): r.cnt for r in edges.collect()})


README = Counter([(0, 1), (0, 2), (1, 2), (1, 3), (2, 4), (3, 4)])
BATCHES = [[("a", 0, 3), ("a", 0, 4), ("d", 0, 1), ("d", 0, 2), ("d", 1, 2)], [("a", 1, 4), ("a", 2, 3), ("d", 1, 3), ("d", 2, 4), ("d", 3, 4)]]


def test_golden_replay(spark):
    bag = Counter([(0, 1), (0, 1), (0, 2), (2, 3), (3, 4)])
    batches = [[("d", 0, 1), ("a", 1, 2), ("d", 3, 4), ("a", 0, 3)], [("d", 0, 9), ("a", 2, 5)]]
    want = [(2, 2, 3, 3, 0, 0, 5), (1, 1, 2, 1, 1, 0, 6)]
    for batch, row in zip(batches, want):
        done = topology.apply_batch(bag_frame(spark, bag), batch_frame(spark, batch), 5)
        got = tuple(done.metrics.first())
        assert got[:6] == row[:6] and got[6] == max(Counter(u for _, u, _ in batch).values())
        bag = as_bag(done.after_add)
        assert sum(bag.values()) == row[6]


@pytest.mark.parametrize("name,start,after", [
    ("bfs", [0, 1, 1, 2, 2], [[0, None, None, 1, 1], [0, None, None, 1, 1]]),
    ("sssp", [0, 2, 3, 7, 10], [[0, None, None, 4, 5], [0, None, None, 4, 5]]),
    ("min_label", [0, 0, 0, 0, 0], [[0, 1, 2, 0, 0], [0, 1, 2, 0, 0]]),
])
def test_readme_example(spark, name, start, after):
    program, edges = PROGRAMS[name], bag_frame(spark, README)
    state = solve(edges, program, 5)
    assert [r.value for r in all_vertices(state, 5).orderBy("v").collect()] == start
    for batch, want in zip(BATCHES, after):
        done = repair.update(edges, state, batch_frame(spark, batch), program, 5)
        edges, state = done.edges, done.state
        assert [r.value for r in all_vertices(state, 5).orderBy("v").collect()] == want
        assert tuple(checks.parent_check(edges, state, program).first()) == (0, 0, 0)


def _random(seed, n):
    r = random.Random(seed)
    bag = Counter({(u, v): 1 + (r.randrange(5) == 0) for u in range(n) for v in range(n) if r.random() < 0.15})
    have = sorted(bag.elements())
    batch = [("d", *r.choice(have)) for _ in range(7)] + [("d", r.randrange(n), r.randrange(n)) for _ in range(2)]
    batch += [("a", r.randrange(n), r.randrange(n)) for _ in range(4)] + [("a", *batch[0][1:]), ("a", n + 3, 0), ("d", n + 3, 1), ("a", 0, n + 2)]
    r.shuffle(batch)
    return bag, batch


@pytest.mark.parametrize("name", list(PROGRAMS))
def test_repair_equals_recomputation(spark, name, both_ways):
    n = 8
    bag, batch = _random(20260923, n)
    program, edges = PROGRAMS[name], bag_frame(spark, bag)
    state = solve(edges, program, n)
    assert values(state) == oracle.solve(name, n, bag)
    mid, last, metrics = oracle.apply(n, bag, batch)
    done = repair.update(edges, state, batch_frame(spark, batch), program, n)
    assert done.metrics.first().asDict() == metrics
    assert values(done.after_delete) == oracle.solve(name, n, mid)
    assert values(done.state) == oracle.solve(name, n, last)
    assert as_bag(done.edges) == last
    inside = done.edges.where(f"dst < {n}")
    assert tuple(checks.bellman_check(inside, done.state, program).first()) == (0, 0)
    if both_ways == "rounds" and name != "sssp":
        return
    assert values(repair.final_state_update(edges, state, batch_frame(spark, batch), program, n).state) == oracle.solve(name, n, last)


def test_bucketed_rounds(spark, monkeypatch):
    from tidegraph.plans import local

    monkeypatch.setattr(local, "LOCAL_PAIRS", -1)
    bag = Counter({(u, (u + 1) % 9): 1 for u in range(9)} | {(0, 5): 1, (5, 2): 2})
    assert values(solve(bag_frame(spark, bag), SSSP, 9, bucket=8)) == oracle.solve("sssp", 9, bag)


def test_unsound_label_parents(spark):
    """After 0 -> 1 goes, the cycle 1 <-> 2 must not keep label 0 alive."""
    bag = Counter([(0, 1), (1, 2), (2, 1), (2, 3)])
    edges = bag_frame(spark, bag)
    done = repair.update(edges, solve(edges, MIN_LABEL, 4), batch_frame(spark, [("d", 0, 1)]), MIN_LABEL, 4)
    assert values(done.after_delete) == {0: 0, 1: 1, 2: 1, 3: 1}


def test_empty_batch_and_graph(spark):
    edges = bag_frame(spark, README)
    state = solve(edges, SSSP, 5)
    done = repair.update(edges, state, batch_frame(spark, []), SSSP, 5)
    assert values(done.state) == values(state) and done.metrics.first().additions == 0
    assert values(solve(edges.limit(0), BFS, 3, 99)) == {2: 0}
    with pytest.raises(ValueError):
        solve(edges, BFS, 0)


def test_pagerank(spark, both_ways):
    n = 12
    bag, batch = _random(7, n)
    edges = bag_frame(spark, bag)
    state = pagerank.pagerank(edges, n, 1e-8, 200)
    want = oracle.pagerank(n, bag)
    assert sum(abs(r["rank"] - want[r.v]) for r in state.collect()) <= pagerank.error_bound(n, 1e-8)
    done = pagerank.update_pagerank(edges, state, batch_frame(spark, batch), n, 1e-8, 200)
    final, state = done.edges, done.state
    assert done.converged and done.rounds > 0
    want = oracle.pagerank(n, oracle.apply(n, bag, batch)[1])
    assert sum(abs(r["rank"] - want[r.v]) for r in state.collect()) <= pagerank.error_bound(n, 1e-8)
    row = pagerank.invariant_defect(state, final, n).first()
    assert row.worst < 1e-9 and row.largest_residual <= 1e-8
    capped = pagerank.pagerank(edges, n, 1e-8, 1)
    assert pagerank.invariant_defect(capped, edges, n).first().worst < 1e-9
    with pytest.raises(ValueError):
        pagerank.pagerank(edges, n, 0)


def test_topology_tables(spark):
    n = 12
    bag, batch = _random(3, n)
    edges, changes = bag_frame(spark, bag), batch_frame(spark, [b for b in batch if b[1] < n])
    done = topology.apply_batch(edges, changes, n)
    log = topology.dependency_log(edges, changes.groupBy("op", "src", "dst").agg(F.count("*").alias("cnt")).withColumn("batch_id", F.lit(0).cast("long")))
    assert topology.topology_mismatches(topology.as_of(log, 1), done.after_add).count() == 0
    assert topology.topology_mismatches(topology.as_of(log, 0), edges).count() == 0
    both = as_bag(topology.undirected(edges))
    assert all(both[min(u, v), max(u, v)] == max(bag[u, v], bag[v, u]) for u, v in bag)
    rows = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 3, 7)], "src long, seq long, dst long")
    want = 0xCBF29CE484222325
    for x in (5, 6):
        want = (want ^ x) * 0x100000001B3 % 2**64
    got = {r.src: r.fnv % 2**64 for r in topology.ordered_digests(rows).collect()}
    assert got[0] == want


def test_components_and_regions(spark):
    r = random.Random(5)
    pairs = [(r.randrange(30), r.randrange(30)) for _ in range(28)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, cnt long")
    up = list(range(30))
    reach = [{v} for v in range(30)]
    for _ in range(30):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
            reach[a] |= reach[b]
    for _ in range(30):
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    assert {x.v: x.component for x in connected_components(vertex_range(spark, 30), edges).collect()} == dict(enumerate(up))
    assert {x.v: x.component for x in connected_components(vertex_range(spark, 30), edges, small=1000).collect()} == dict(enumerate(up))
    want = {v: min(u for u in range(30) if u in reach[v] and v in reach[u]) for v in range(30)}
    for small in (None, -1):
        strong = regions.strong_components(vertex_range(spark, 30), edges, small)
        assert {x.v: x.component for x in strong.collect()} == want
    dag = {(want[a], want[b]) for a, b in pairs if want[a] != want[b]}
    level = dict.fromkeys(want.values(), 0)
    for _ in range(30):
        for a, b in dag:
            level[b] = max(level[b], level[a] + 1)
    for small in (None, -1):
        got = regions.levels(strong.select(F.col("component").alias("v")).distinct(), regions.condensation(edges, strong), small)
        assert {x.v: x.level for x in got.collect()} == level


def test_long_chains_and_cycles(spark):
    chain = generate.chain(spark, 12_000)
    edges = chain.withColumn("cnt", F.lit(1).cast("long"))
    assert regions.levels(vertex_range(spark, 12_000), edges).agg(F.max("level")).first()[0] == 11_999
    assert regions.strong_components(vertex_range(spark, 12_000), edges).select("component").distinct().count() == 12_000
    assert regions.levels(vertex_range(spark, 14), generate.chain(spark, 14), -1).agg(F.max("level")).first()[0] == 13
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    for small in (None, -1):
        with pytest.raises(RuntimeError, match="cycle"):
            regions.levels(vertex_range(spark, 3), ring, small)


def test_components_are_repaired(spark):
    r = random.Random(12)
    for turn in range(3):
        n = 25
        bag = Counter((r.randrange(n), r.randrange(n)) for _ in range(22))
        batch = [("d", *p) for p in r.sample(sorted(bag), 8)] + [("a", r.randrange(n), r.randrange(n)) for _ in range(5)]
        store = EdgeStore.of(bag_frame(spark, bag))
        labels = connected_components(vertex_range(spark, n), store.pairs(n))
        step = store.apply(batch_frame(spark, batch), n)
        got = repair_components(labels, step.after.pairs(n), step.lost(), step.gained(n), small=1000 if turn else -1)
        want = connected_components(vertex_range(spark, n), step.after.pairs(n))
        assert sorted(got.collect()) == sorted(want.collect())


def test_store_keeps_its_base_until_the_overlay_has_grown(spark, monkeypatch):
    from tidegraph.operators import store as module

    r, n, bag = random.Random(13), 12, _random(5, 12)[0]
    for least in (10_000, 3):
        monkeypatch.setattr(module, "LEAST", least)
        store, want = EdgeStore.of(bag_frame(spark, bag)), bag
        for _ in range(4):
            batch = [("d", *r.choice(sorted(want)))] * 2 + [("a", r.randrange(n + 1), r.randrange(n)) for _ in range(3)]
            gd, ga, _ = oracle.apply(n, want, batch)
            step = store.apply(batch_frame(spark, batch), n)
            assert as_bag(step.mid.view()) == gd and as_bag(step.after.view()) == ga
            store, want = step.after, ga
        assert (store.overlay is not None) == (least > 3) or store.touched <= 3 + module.SHARE * store.rows


def test_undirected_batches(spark):
    r = random.Random(14)
    bag = Counter((r.randrange(6), r.randrange(6)) for _ in range(9))
    batches = [[(r.choice("ad"), r.randrange(6), r.randrange(6)) for _ in range(8)] for _ in range(3)]
    there = {tuple(sorted(p)) for p in bag if p[0] != p[1]}
    want = set()
    for b, batch in enumerate(batches):
        gone = {tuple(sorted(x[1:])) for x in batch if x[0] == "d" and x[1] != x[2]} & there
        there -= gone
        new = {tuple(sorted(x[1:])) for x in batch if x[0] == "a" and x[1] != x[2]} - there
        there |= new
        want |= {(b, op, *p[::k]) for op, pairs in (("d", gone), ("a", new)) for p in pairs for k in (1, -1)}
    rows = spark.createDataFrame([(b, *x) for b, batch in enumerate(batches) for x in batch], "batch_id long, op string, src long, dst long")
    initial, out = topology.undirected_batches(bag_frame(spark, bag), rows)
    assert sorted(map(tuple, out.drop("cnt").collect())) == sorted(want) and all(x.cnt == 1 for x in initial.collect())


def test_subsequence(spark):
    base = spark.createDataFrame([(0, 1, 5), (0, 2, 6), (1, 1, 7), (2, 1, 9)], "src long, seq long, dst long")
    source = spark.createDataFrame([(0, 1, 5), (0, 2, 4), (0, 3, 6), (1, 1, 8)], "src long, seq long, dst long")
    assert sorted(map(tuple, topology.is_subsequence(base, source).collect())) == [(0, 2, 2), (1, 1, 0), (2, 1, 0)]


def test_ratio_pools(spark):
    source = bag_frame(spark, Counter({(i, j): 1 + (i * j) % 3 for i in range(12) for j in range(12)}))
    base = source.where("(src + dst) % 2 = 0").withColumn("cnt", F.greatest(F.col("cnt") - 1, F.lit(1)))
    rows = analytics.ratio_pools(source, base, 20, 3).collect()
    have = {(r.src, r.dst): r.cnt for r in base.collect()}
    degree = Counter()
    for (u, _), c in have.items():
        degree[u] += c
    deletes, inserts = [r for r in rows if r.pool == "delete"], [r for r in rows if r.pool == "insert"]
    assert len(deletes) == len(inserts) == len({(r.src, r.dst) for r in inserts}) == 20
    assert all(have[r.src, r.dst] == r.multiplicity for r in deletes) and all((r.src, r.dst) not in have and r.multiplicity == 0 for r in inserts)
    assert all(r.degree == degree[r.src] for r in rows) and len({r.occ for r in rows}) == 40
    for wrong, size in ((base, 500), (source.withColumn("cnt", F.col("cnt") + 1), 5)):
        with pytest.raises(ValueError):
            analytics.ratio_pools(source, wrong, size)


def test_score_index(spark):
    rows = spark.createDataFrame([(0, 3, 2), (1, 5, 4), (2, 3, 1), (3, 0, 9)], "v long, score long, degree long")
    changed = analytics.rescored(rows, spark.createDataFrame([(1, 0, 4), (4, 9, 2)], "v long, score long, degree long"))
    got = {r.capacity: r.candidates for r in analytics.prefix_counts(changed, [0, 3, 5, 6, 100]).collect()}
    assert got == {0: 0, 3: 1, 5: 2, 6: 3, 100: 3}


def test_closed_parts(spark):
    """1 -> 2 -> 3 and 4 apart: parts are closed, and their work is that of their components."""
    edges = bag_frame(spark, Counter([(1, 2), (2, 3), (3, 2), (4, 4)]))
    strong = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4)], "v long, component long")
    rows = sorted(map(tuple, regions.closed_parts(strong, edges, 2).collect()))
    # weak, part, components, vertices, incoming, outgoing, work, cuts, path
    assert rows == [(1, 0, 2, 3, 3, 3, 9, 0, 9), (4, 0, 1, 1, 1, 1, 3, 0, 3)]
    rows = sorted(map(tuple, regions.closed_parts(strong, edges, 9).collect()))
    assert [x[:4] + x[6:] for x in rows] == [(1, 0, 1, 1, 2, 1, 2), (1, 2, 1, 2, 7, 0, 7), (4, 0, 1, 1, 3, 0, 3)]


def test_region_golden(spark):
    """Vertices 1-4; incoming 1: 9, 9; 2: 1, 8, 8; 3: 2; 4: 10."""
    region = spark.createDataFrame([(1,), (2,), (3,), (4,)], "v long")
    into = Counter([(9, 1), (9, 1), (1, 2), (8, 2), (8, 2), (2, 3), (10, 4)])
    changed = spark.createDataFrame([(1,), (1,), (4,), (9,)], "src long")
    row = regions.affected_report(region, bag_frame(spark, into), changed).first()
    assert (row.vertices, row.components, row.strong, row.incoming, row.internal, row.boundary, row.boundary_sources, row.changed_boundary_sources) == (4, 2, 4, 7, 2, 5, 3, 1)
    assert row.depth == 3


def test_hotness(spark):
    degree = spark.createDataFrame([(0, 0), (1, 2), (2, 0), (3, 3)], "v long, degree long")
    for scores, capacity, want in (([0, 0, 0, 0], 3, {0, 1, 2}), ([0, 0, 0, 0], 0, set()), ([0, 0, 1020, 0], 6, {0, 1, 2, 3}), ([0, 0, 0, 9], 3, set())):
        frame = spark.createDataFrame(list(enumerate(scores)), "v long, score long")
        assert {r.v for r in analytics.admission(frame, degree, capacity).collect()} == want
    hits = spark.createDataFrame([(1, b, 300) for b in range(6)], "v long, batch_id long, hits long")
    assert [r.score for r in analytics.activity(hits).orderBy("batch_id").collect()] == [44, 88, 132, 176, 176, 176]


def test_planner_and_sources(spark):
    rows = spark.createDataFrame([("all_gpu", 0.0, 9000.0, 0.0, True), ("edge_cut", 300.0, 2000.0, 10.0, True), ("high_cut", 300.0, 2000.0, 900.0, True)], "name string, cpu_edges double, gpu_edges double, events double, eligible boolean")
    rows = rows.select("*", *[F.lit(0.0).alias(c) for c in ("dependency_ns", "topology_ns", "placement_ns", "migration_ns")])
    rates = {"cpu": 100.0, "gpu": 1000.0, "events": 50.0}
    assert analytics.choose_plan(analytics.plan_costs(rows, rates)).first().chosen == "edge_cut"
    assert analytics.choose_plan(analytics.plan_costs(rows.withColumn("eligible", F.col("name") != "edge_cut"), rates)).first().chosen == "all_gpu"
    with pytest.raises(ValueError):
        analytics.plan_costs(rows, rates | {"cpu": 0})
    edges = bag_frame(spark, Counter([(1, 2), (2, 3), (3, 2), (4, 2), (5, 6)]))
    gone = spark.createDataFrame([(0, 2, 3), (1, 3, 2)], "batch_id long, src long, dst long")
    assert tuple(regions.best_sources(edges, gone).first()) == (1, 3, 2, 2)
    r = random.Random(17)
    bag = Counter((r.randrange(90), r.randrange(90)) for _ in range(100))
    gone = [(r.randrange(5), r.randrange(90), 0) for _ in range(60)]
    reach = {v: {v} for v in range(90)}
    for _ in range(90):
        for u, v in bag:
            reach[u] |= reach[v]
    want = sorted(((u, len(reach[u]), sum(g[1] in reach[u] for g in gone), len({g[0] for g in gone if g[1] in reach[u]})) for u in {u for u, _ in bag}), key=lambda x: (-x[3], -x[2], -x[1], x[0]))
    got = regions.best_sources(bag_frame(spark, bag), spark.createDataFrame(gone, "batch_id long, src long, dst long")).collect()
    assert [tuple(x) for x in got] == want[:8]


def test_generators(spark):
    def splitmix(x):
        z = (x + 0x9E3779B97F4A7C15) % 2**64
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    from tidegraph.functions.columns import splitmix64

    assert len(spark.range(1).select(splitmix64(F.col("id")))._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    for r in spark.createDataFrame([(0,), (1,), (2**40 + 7,), (-3,)], "x long").select("x", splitmix64(F.col("x")).alias("z")).collect():
        assert r.z % 2**64 == splitmix(r.x % 2**64)
    assert generate.chain(spark, 6, 3).count() == 4 and generate.clique(spark, 4).count() == 12
    a, b = generate.rmat(spark, 5, 200).collect(), generate.rmat(spark, 5, 200).repartition(3).collect()
    assert sorted(a) == sorted(b) and max(max(r) for r in a) < 32
    bag = Counter((r.src % 9, r.dst % 9) for r in a)
    initial, updates = generate.update_stream(bag_frame(spark, bag), 20, 3)
    row = generate.verify_stream(initial, updates).first()
    assert (row.adds, row.deletes, row.missing_deletes) == (30, 30, 0)
    assert sorted(r.dst for r in generate.permuted(generate.chain(spark, 5), 5).union(spark.createDataFrame([(0, 0)], "src long, dst long").limit(0)).collect()).__len__() == 4
    ring = spark.createDataFrame([(i, i + 1) for i in range(7)] + [(0, 7), (1, 5)], "src long, dst long")
    start, moves = generate.connected_stream(ring, 1, 2)
    assert moves.where("op = 'd'").count() == 4 and start.count() == 18
    for backbone in ("levels", "random"):
        start, moves = generate.connected_stream(ring, 1, 2, backbone=backbone)
        assert [r.components for r in generate.connectivity(start, moves, 9).orderBy("batch_id").collect()] == [2, 2, 2]
    with pytest.raises(ValueError):
        generate.connected_stream(ring, 2, 2)


def test_spanning_forest(spark):
    r = random.Random(15)
    pairs = sorted({tuple(sorted((r.randrange(20), r.randrange(20)))) for _ in range(40)})
    frame = spark.createDataFrame(pairs, "src long, dst long")
    forest = {tuple(x) for x in generate.spanning_forest(frame).collect()}
    parts = lambda rows: {x.v: x.component for x in connected_components(vertex_range(spark, 20), spark.createDataFrame(list(rows), "src long, dst long")).collect()}
    assert forest <= set(pairs) and parts(forest) == parts(pairs) and len(forest) == 20 - len(set(parts(pairs).values()))


def test_running_sum_over_partitions(spark):
    from tidegraph.plans.prefix import running_sum

    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2).alias("x")).repartition(7)
    got = running_sum(rows, [F.col("k")], F.col("x"), "before").collect()
    assert all(r.before == 2 * r.k for r in got) and len(got) == 1000
