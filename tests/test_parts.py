"""What a round of findings showed: layers that grow, and graphs whose components are solved side by side."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import generate, live, pagerank, parts, programs, regions, repair, vertex
from tidegraph.operators.score_index import ScoreIndex
from tidegraph.plans import layers, local
from tidegraph.plans.state import settled


def test_an_index_that_became_a_new_base_still_counts(spark, monkeypatch):
    monkeypatch.setattr(layers, "LEAST", 0)
    rows = lambda k: settled(spark.range(60).select(F.col("id").alias("v"), ((F.col("id") * k) % 7 + 1).alias("score"), (F.col("id") % 3 + 1).alias("degree")))
    old, new = rows(3), rows(5)
    index = ScoreIndex.of(old).update_all(old, new)
    assert index.nodes.over is None and index.nodes.all().columns == ["parent", "node", "total", "n"]
    order = sorted((-r.score, r.v, r.degree) for r in new.collect())
    for capacity in (0, 5, 40, 1000):
        used = taken = 0
        for _, _, degree in order:
            used += degree
            taken += used < capacity
        assert index.count(capacity) == taken


def _copies(spark, k=5, n=12, seed=3):
    """k graphs of n vertices that share none, with lone vertices at the end: (edges, a batch of deletes and adds, the vertices)."""
    rng = random.Random(seed)
    bag = Counter((c * n + rng.randrange(n), c * n + rng.randrange(n)) for c in range(k) for _ in range(30))
    pairs = sorted(bag)
    batch = [("d", *p) for p in rng.sample(pairs, 25)] + [("a", c * n + rng.randrange(n), c * n + rng.randrange(n)) for c in range(k) for _ in range(5)] + [("a", 1, k * n + 1), ("d", 0, 0)]
    edges = spark.createDataFrame([(u, v, c) for (u, v), c in bag.items()], "src long, dst long, cnt long")
    return settled(edges), settled(spark.createDataFrame(batch, "op string, src long, dst long")), k * n + 3


@pytest.fixture
def apart(monkeypatch):
    """Graphs of over 50 pairs are solved part by part; rounds are an error."""
    def rounds(*args, **kwargs):
        raise AssertionError("the graph was solved by rounds")

    def choose(on):
        monkeypatch.setattr(local, "LOCAL_PAIRS", 50 if on else 2_000_000)
        monkeypatch.setattr(parts, "GATHER", 40)
        for module, name in ((programs, "candidates"), (pagerank, "_round"), (repair, "tree_affected"), (repair, "label_affected"), (live, "certified_affected"), (regions, "least_colours")):
            monkeypatch.setattr(module, name, rounds)
    return choose


def _rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("program", [programs.SSSP, programs.MIN_LABEL], ids=lambda p: p.name)
def test_min_programs_of_small_components(spark, apart, program):
    edges, batch, n = _copies(spark)
    got = []
    for on in (False, True):
        apart(on)
        state = programs.solve(edges, program, n, 1)
        done = repair.update(edges, state, batch, program, n)
        got.append([_rows(x, "v", "value", "parent") for x in (state, done.after_delete, done.state)] + [_rows(done.affected, "v")])
    assert got[0] == got[1]


def test_ranks_of_small_components(spark, apart):
    edges, batch, n = _copies(spark)
    got = []
    for on in (False, True):
        apart(on)
        state = pagerank.pagerank(edges, n, 1e-9, 200)
        done = pagerank.update_pagerank(edges, state, batch, n, 1e-9, 200)
        assert done.converged
        got.append([{r.v: r.rank for r in x.collect()} for x in (state, done.state)])
    for a, b in zip(*got):
        assert a.keys() == b.keys() and all(abs(a[v] - b[v]) < 1e-7 for v in a)


def test_live_results_of_small_components(spark, apart, monkeypatch):
    monkeypatch.setattr(layers, "FEW", 0)
    edges, batch, n = _copies(spark, k=6)
    for program in (programs.SSSP, programs.LABEL_WITNESS):
        apart(False)
        want = programs.solve(edges, program, n, 1)
        done = repair.update(edges, want, batch, program, n)
        apart(True)
        found = live.Live.start(edges, program, n, 1).apply(batch)
        assert not found.by_lookups
        for a, b in ((done.after_delete, found.after_delete.all()), (done.state, found.live.result())):
            assert _rows(a, "v", "value", "parent") == _rows(b, "v", "value", "parent")
    start = live.LiveRanks.start(edges, n, 1e-9, 200)
    ranks = {r.v: r.rank for r in start.apply(batch).result().collect()}
    apart(False)
    want = pagerank.pagerank(start.edges.apply(batch, n).after.view(), n, 1e-9, 200)
    assert all(abs(r["rank"] - ranks[r.v]) < 1e-7 for r in want.collect())


def test_regions_of_small_components(spark, apart):
    edges, _, n = _copies(spark)
    vertices = programs.vertex_range(spark, n)
    forward = settled(edges.where("src < dst"))
    got = []
    for on in (False, True):
        apart(on)
        got.append([
            _rows(regions.strong_components(vertices, edges), "v", "component"), _rows(regions.levels(vertices, forward), "v", "level"),
            _rows(regions.closed_parts(settled(regions.strong_components(vertices, forward)), forward), "*"), _rows(generate.breadth_ranks(forward.select("src", "dst")), "v", "rank", "tree")])
    assert got[0] == got[1]


def test_a_large_component_has_no_parts(spark, apart):
    apart(True)
    chain = settled(generate.chain(spark, 80).withColumn("cnt", F.lit(1).cast("long")))
    assert parts.homes(programs.vertex_range(spark, 80), chain, 79) is None


def test_a_forest_is_the_lightest_however_its_edges_are_dealt(spark, monkeypatch):
    """Edges that close a cycle of lighter ones go before the rounds, which get a forest's worth of each range of vertices."""
    rng = random.Random(5)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(900)]
    edges = settled(spark.createDataFrame(pairs, "src long, dst long"))
    weight = {(r.a, r.b): r.h for r in edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a != b").select("a", "b", F.xxhash64("a", "b", F.lit(1)).alias("h")).collect()}
    tree, want = list(range(40)), set()
    for a, b in sorted(weight, key=lambda p: (weight[p], p)):
        x, y = tree[a], tree[b]
        if x != y:
            want.add((a, b))
            tree = [x if t == y else t for t in tree]
    seen, kept = [], generate.connected_components
    monkeypatch.setattr(generate, "connected_components", lambda v, e, *a, **k: seen.append(e.count()) or kept(v, e, *a, **k))
    for small, gathered in ((None, 1 << 19), (-1, 50)):
        monkeypatch.setattr(local, "GATHERED", gathered)
        assert {tuple(r) for r in generate.spanning_forest(edges, small=small).collect()} == want
        assert bool(seen) == (small == -1)


@pytest.mark.parametrize("program, share, unroll", [(vertex.HOPS, 1.0, 1), (vertex.DISTANCE, 0.2, 1), (vertex.LABEL, 0.3, 1), (vertex.WIDEST, 0.5, 1), (vertex.ranks(1e-9), 0.8, 4)], ids=lambda p: getattr(p, "name", None))
def test_urgent_vertices_of_small_components(spark, monkeypatch, program, share, unroll):
    """Each part by its own sketch, in one task, to the same results; a turn's messages are all parts' together."""
    edges, _, n = _copies(spark)
    want = vertex.run(program, vertex.started(spark, program, n, 1), program.links(edges, n), share, 1000, unroll) if program.kind == "long" else vertex.Run(
        pagerank.pagerank(edges, n, 1e-9, 200).select("v", F.col("rank").alias("value"), F.col("residual").alias("delta"), F.lit(0).cast("long").alias("got")))
    monkeypatch.setattr(parts, "GATHER", 40)
    monkeypatch.setattr(vertex, "_round", None)
    got = vertex.solve(program, edges, n, 1, share, 1000, unroll)
    assert got.converged and got.state.dtypes == want.state.dtypes
    a, b = ({r.v: r.value for r in x.result().collect()} for x in (got, want))
    assert a.keys() == b.keys() and all(a[v] == b[v] if program.kind == "long" else abs(a[v] - b[v]) < 1e-7 for v in a)
    if share == 1.0:
        assert got.rounds == want.rounds
    assert not vertex.solve(program, edges, n, 1, share, 1).converged


def test_ranks_do_not_write_what_they_do_not_read(spark, apart, monkeypatch):
    """A large batch of ranks puts the side by source alone, once; the other side and the graph between the phases come when they are read."""
    monkeypatch.setattr(layers, "FEW", 0)
    edges, batch, n = _copies(spark, k=6)
    apart(True)
    made, of, put_all = [], layers.Layered.of.__func__, layers.Layered.put_all
    monkeypatch.setattr(layers.Layered, "of", classmethod(lambda cls, rows, key, *a: made.append(key) or of(cls, rows, key, *a)))
    monkeypatch.setattr(layers.Layered, "put_all", lambda self, rows: made.append("put " + self.key) or put_all(self, rows))
    done = live.LiveRanks.start(edges, n, 1e-9, 200).apply(batch)
    assert sorted(made) == ["put src", "src", "v", "v"]
    assert _rows(done.edges.into.all(), "src", "dst", "cnt") == _rows(done.edges.out.all(), "src", "dst", "cnt")
