"""Results kept current by a two-sided index: by lookups and by joins, against recomputation."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import oracle
from tests.test_graph import as_bag, bag_frame, batch_frame
from tidegraph.operators import checks
from tidegraph.operators.direction import bfs_by_direction
from tidegraph.operators.live import EdgeIndex, Live, LiveRanks
from tidegraph.operators.pagerank import pagerank
from tidegraph.operators.programs import BFS, HOPS, LABEL_WITNESS, MIN_LABEL, SSSP
from tidegraph.operators.score_index import ScoreIndex
from tidegraph.plans import layers
from tidegraph.streaming.engine import LiveFolder

PROGRAMS = {"bfs": BFS, "sssp": SSSP, "min_label": LABEL_WITNESS}


def jobs_of(spark, run):
    """The result of ``run``, and how many jobs it took."""
    spark.sparkContext.setJobGroup("counted", "")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    spark.sparkContext.setJobGroup("other", "")
    return out, n


def _batches(seed, n, turns):
    r = random.Random(seed)
    bag = Counter({(u, v): 1 + (r.randrange(4) == 0) for u in range(n) for v in range(n) if r.random() < 0.12})
    out, now = [], bag
    for _ in range(turns):
        have = sorted(now.elements())
        batch = [("d", *r.choice(have)) for _ in range(6)] + [("d", r.randrange(n), r.randrange(n)), ("d", n + 1, 0)]
        batch += [("a", r.randrange(n), r.randrange(n)) for _ in range(3)] + [("a", *batch[0][1:]), ("a", 0, n + 2), ("a", n, 1)]
        mid, now, metrics = oracle.apply(n, now, batch)
        out.append((batch, mid, now, metrics))
    return bag, out


@pytest.mark.parametrize("name", list(PROGRAMS))
@pytest.mark.parametrize("way", ["lookups", "joins"])
def test_batches_equal_recomputation(spark, name, way, monkeypatch):
    monkeypatch.setattr(layers, "FEW", 5_000 if way == "lookups" else 3)
    n, program = 14, PROGRAMS[name]
    bag, batches = _batches(31, n, 3 if way == "lookups" else 1)
    live = Live.start(bag_frame(spark, bag), program, n)
    label = lambda rows: {r.v: r.value // program.spread for r in rows.collect()}
    for batch, mid, last, metrics in batches:
        done = live.apply(batch_frame(spark, batch))
        assert done.by_lookups == (way == "lookups")
        assert label(done.after_delete.all()) == oracle.solve(name, n, mid)
        assert label(done.live.result()) == oracle.solve(name, n, last)
        assert as_bag(done.live.edges.view()) == last == as_bag(done.live.edges.into.all())
        assert done.metrics.first().asDict() == metrics
        live = done.live
        inside = live.edges.pairs(n)
        assert not program.rooted or checks.parent_check(inside, live.result(), program).first() == (0, 0, 0)
        assert checks.bellman_check(inside, live.result(), program).first().relaxable == 0
        low = {}
        value = {r.v: r.value for r in live.result().collect()}
        for s, d in inside.where("src != dst").collect():
            if s in value and value[s] + program.cost(s, d) == value[d]:
                low[d] = min(s, low.get(d, s))
        root = (lambda v: value[v] == 0) if program.rooted else (lambda v: value[v] == v * HOPS)
        assert {r.v: r.parent for r in live.result().collect()} == {v: None if root(v) else low[v] for v in value}


@pytest.mark.parametrize("way", ["lookups", "joins"])
def test_ranks(spark, way, monkeypatch):
    monkeypatch.setattr(layers, "FEW", 5_000 if way == "lookups" else 3)
    n = 14
    epsilon = 1e-8 if way == "lookups" else 1e-4
    bag, batches = _batches(7, n, 2 if way == "lookups" else 1)
    live = LiveRanks.start(bag_frame(spark, bag), n, epsilon)
    for batch, _, last, _ in batches:
        live = live.apply(batch_frame(spark, batch))
        assert live.by_lookups == (way == "lookups")
        want = {r.v: r.rank for r in pagerank(bag_frame(spark, last), n, 1e-10, 300).collect()}
        got = {r.v: r.rank for r in live.result().collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 100 * epsilon for v in want)


def test_a_small_batch_reads_few_rows(spark):
    """A lost leaf of a giant group looks at one vertex, and a batch of ten pairs is a few jobs."""
    n = 4000
    edges = spark.range(1, n).select(F.floor((F.col("id") - 1) / 10).alias("src"), F.col("id").alias("dst"), F.lit(1).cast("long").alias("cnt"))
    live = Live.start(edges, LABEL_WITNESS, n)
    assert live.result().where(f"value >= {HOPS}").count() == 0
    done, jobs = jobs_of(spark, lambda: live.apply(batch_frame(spark, [("d", 399, 3999)] + [("a", 3998, 1 + i) for i in range(9)])))
    assert done.by_lookups and done.visited == 1 and done.affected == 1 and jobs <= 10
    assert [tuple(r) for r in done.live.result().where(f"value >= {HOPS}").collect()] == [(3999, 3999 * HOPS, None)]
    _, jobs = jobs_of(spark, lambda: done.live.apply(batch_frame(spark, [("a", 3998, 6)] * 10)))
    assert jobs <= 6


def test_plan_of_a_lookup(spark):
    """Literal keys: neither an exchange of the base nor a scan of all its buckets."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else plans do not show which buckets are read
    try:
        index = EdgeIndex.of(spark.range(1000).selectExpr("id AS src", "id + 1 AS dst", "1L AS cnt"))
        for found in (index.out.lookup([5]), index.incoming([7])):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange " not in plan and "SelectedBucketsCount: 1 out of 8" in plan and "EqualTo(" in plan
        # an update of both sides by joins does not move the base either
        joined = index.pairs(2000, "dst").join(spark.range(0, 2000, 2).selectExpr("id AS dst").hint("merge"), "dst")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_layers_grow_into_a_new_base(spark, monkeypatch):
    for name, x in (("MEMORY", 3), ("LEAST", 4), ("SHARE", 0.1)):
        monkeypatch.setattr(layers, name, x)
    table = layers.Layered.of(spark.range(5).selectExpr("id AS v", "id * 10 AS value"), "v", ("v",), "value")
    want, first = {i: i * 10 for i in range(5)}, table.base
    r = random.Random(2)
    for turn in range(8):
        rows = [(r.randrange(9), r.choice([None, turn])) for _ in range(3)]
        table = table.put(rows)
        want |= dict(rows)
        alive = {k: x for k, x in want.items() if x is not None}
        assert {x.v: x.value for x in table.all().collect()} == alive
        assert dict(table.get(range(9))) == alive and dict(table.get([2, 3], {(2,)})) == {k: x for k, x in alive.items() if k == 2}
    assert table.base is not first
    with pytest.raises(layers.TooMany):
        table.get(range(9), most=2)
    with pytest.raises(ValueError):
        Live.start(bag_frame(spark, Counter({(0, 1): 1})), MIN_LABEL, 2)


def test_a_failed_publication_leaves_the_epoch_before(spark, tmp_path, monkeypatch):
    n, (bag, batches) = 14, _batches(41, 14, 3)
    folder = LiveFolder(spark, str(tmp_path))
    live = Live.start(bag_frame(spark, bag), SSSP, n)
    folder.publish(live, 0)
    done = live.apply(batch_frame(spark, batches[0][0])).live
    with monkeypatch.context() as m:
        m.setattr(folder, "_commit", lambda *x: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            folder.publish(done, 1)
    again = LiveFolder(spark, str(tmp_path))
    assert again.published() == 0
    old = again.open()
    assert as_bag(old.edges.view()) == as_bag(old.edges.into.all()) == bag
    for epoch, (batch, _, last, _) in enumerate(batches, 1):
        old = old.apply(batch_frame(spark, batch)).live
        again.publish(old, epoch)
        old = LiveFolder(spark, str(tmp_path)).open()
        assert as_bag(old.edges.view()) == as_bag(old.edges.into.all()) == last
        assert {r.v: r.value for r in old.result().collect()} == oracle.solve("sssp", n, last)
    with pytest.raises(ValueError):
        again.open(0)
    assert "SelectedBucketsCount" in old.edges.out.lookup([1, 2])._jdf.queryExecution().executedPlan().toString() or old.edges.out.get([1, 2])


def test_score_index(spark, monkeypatch):
    """Counts equal a sort's after point updates and after whole ones; a count looks up a node a level, an update few rows."""
    r, degree = random.Random(4), {v: v % 5 for v in range(300)}
    score = {v: r.randrange(0, 1021) for v in range(300)}
    frame = lambda x: spark.createDataFrame([(v, s, degree[v]) for v, s in x.items()], "v long, score long, degree long")

    def want(capacity):
        used = n = 0
        for v in sorted((v for v in score if score[v]), key=lambda v: (-score[v], v)):
            used += degree[v]
            n += used < capacity
        return n

    index = ScoreIndex.of(frame(score))
    for turn in range(3):
        changes = {v: r.choice([0, 1, 1020, r.randrange(1021)]) for v in r.sample(range(300), 5)}
        if turn < 2:
            index = index.update([(v, (score[v], degree[v]), (s, degree[v])) for v, s in changes.items()])
            assert len(index.nodes.mem) <= (turn + 1) * 5 * 2 * 7
        else:
            index = index.update_all(frame({v: score[v] for v in changes}), frame(changes))
        score |= changes
        reads = []
        monkeypatch.setattr(layers.Layered, "get", lambda self, keys, *a, f=layers.Layered.get: reads.append(f(self, keys, *a)) or reads[-1])
        assert [index.count(c) for c in (0, 1, 57, 10**6)] == [want(c) for c in (0, 1, 57, 10**6)]
        monkeypatch.undo()
        assert len(reads) <= 4 * 7 and max(map(len, reads)) <= 64


def test_direction(spark):
    """A dense part is pulled, a chain is pushed; the levels are those of a search."""
    r, n = random.Random(6), 60
    bag = Counter((r.randrange(50), r.randrange(50)) for _ in range(400)) | Counter((u, u + 1) for u in range(49, 57)) | Counter({(3, 99): 1, (70, 1): 1})
    index = EdgeIndex.of(bag_frame(spark, bag))
    state, rounds = bfs_by_direction(index, n)
    assert {x.v: x.value for x in state.collect()} == oracle.solve("bfs", n, bag)
    assert {x.direction for x in rounds} == {"push", "pull"} and rounds[0].direction == "push" and rounds[-2].direction in ("push", "pull")
    only, plain = bfs_by_direction(index, n, share=10**9)
    assert {x.direction for x in plain} == {"push"} and sorted(only.collect()) == sorted(state.collect())
    cost = lambda x: x.push_edges if x.direction == "push" else x.pull_edges
    assert sum(map(cost, rounds)) < sum(map(cost, plain))
