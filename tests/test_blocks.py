"""Graphs of one large component, in rounds of blocks."""

import random
from collections import Counter

import numpy as np
import pytest

from tidegraph.operators import live, pagerank, programs, repair
from tidegraph.plans import blocks, layers, local
from tidegraph.plans.state import settled


@pytest.fixture
def in_blocks(monkeypatch):
    """Every graph goes by blocks of a few edges."""
    monkeypatch.setattr(local, "LOCAL_PAIRS", -1)
    monkeypatch.setattr(blocks, "FEW", 10)
    monkeypatch.setattr(blocks, "MOST", 60)


def _bag(n=60, m=400, seed=5):
    """A multigraph of one component with a lone vertex, dangling ones, loops, and edges out of range."""
    rng = random.Random(seed)
    bag = Counter((rng.randrange(n - 4), rng.randrange(n - 1)) for _ in range(m))
    return bag + Counter({(3, 3): 2, (5, n + 4): 2, (n + 2, 1): 1})


def _edges(spark, bag):
    return settled(spark.createDataFrame([(u, v, c) for (u, v), c in bag.items()], "src long, dst long, cnt long"))


def _exact(bag, n):
    p, degree = np.zeros((n, n)), Counter()
    for (u, _), c in bag.items():
        degree[u] += c
    for (u, v), c in bag.items():
        if u < n and v < n:
            p[v, u] = 0.85 * c / degree[u]
    return np.linalg.solve(np.eye(n) - p, np.full(n, 0.15))


def test_ranks_take_few_rounds(spark, in_blocks):
    n, bag = 60, _bag()
    edges = _edges(spark, bag)
    state, rounds, converged = pagerank.ranked(edges, n, 1e-9, 200)
    rows = {r.v: r for r in state.collect()}
    assert converged and rounds <= 60 and sorted(rows) == list(range(n))  # rounds of step 1 alone are over 80
    assert max(abs(r.residual) for r in rows.values()) <= 1e-9
    assert np.allclose([rows[v].rank for v in range(n)], _exact(bag, n), atol=1e-7)
    assert pagerank.invariant_defect(state, edges, n).first().worst < 1e-12


def test_ranks_stop_at_the_cap_and_go_on(spark, in_blocks):
    n, bag = 60, _bag(seed=6)
    edges = _edges(spark, bag)
    state, rounds, converged = pagerank.ranked(edges, n, 1e-9, 6)
    assert (rounds, converged) == (6, False)
    state, _, converged = pagerank.converge(state, edges, n, 1e-9, 200)
    assert converged and np.allclose([r.rank for r in state.orderBy("v").collect()], _exact(bag, n), atol=1e-7)


def test_ranks_after_a_batch(spark, in_blocks, monkeypatch):
    monkeypatch.setattr(layers, "FEW", 0)
    n, bag = 60, _bag(seed=7)
    edges = _edges(spark, bag)
    own = [p for p in sorted(bag) if p[0] < n]
    took, came = random.Random(1).sample(own, 40), [(1, 2), (2, n - 1), (n - 3, 7)]
    batch = settled(spark.createDataFrame([("d", *p) for p in took] + [("a", *p) for p in came], "op string, src long, dst long"))
    after = bag - Counter(took) + Counter(came)
    want = _exact(after, n)
    done = pagerank.update_pagerank(edges, pagerank.pagerank(edges, n, 1e-9, 200), batch, n, 1e-9, 200)
    found = live.LiveRanks.start(edges, n, 1e-9, 200, small=-1).apply(batch)
    assert done.converged and not found.by_lookups
    for state in (done.state, found.result()):
        assert np.allclose([r["rank"] for r in state.orderBy("v").collect()], want, atol=1e-7)


@pytest.mark.parametrize("program", [programs.SSSP, programs.LABEL_WITNESS], ids=lambda p: p.name)
def test_least_values_after_a_batch(spark, monkeypatch, program):
    """One component, by blocks and in one task; rounds of jobs are an error."""
    n, bag = 40, _bag(40, 160, 8)
    edges = _edges(spark, bag)
    own = [p for p in sorted(bag) if p[0] < n]
    batch = settled(spark.createDataFrame([("d", *p) for p in random.Random(2).sample(own, 70)] + [("a", 1, 9), ("a", 9, 30), ("a", 20, 39), ("a", 2, n + 1)], "op string, src long, dst long"))
    rows = lambda df: sorted(map(tuple, df.select("v", "value", "parent").collect()), key=str)
    state = programs.solve(edges, program, n, 1)
    done = repair.update(edges, state, batch, program, n)
    want = [rows(x) for x in (state, done.after_delete, done.state)]
    for module, name in ((programs, "candidates"), (repair, "tree_affected"), (live, "certified_affected")):
        monkeypatch.setattr(module, name, None)
    for name, most in (("FEW", 10), ("MOST", 60)):
        monkeypatch.setattr(blocks, name, most)
    monkeypatch.setattr(layers, "FEW", 0)
    monkeypatch.setattr(local, "LOCAL_PAIRS", -1)
    again = repair.update(edges, state, batch, program, n)
    found = live.Live.start(edges, program, n, 1, small=-1).apply(batch)
    assert not found.by_lookups
    assert [rows(x) for x in (again.after_delete, again.state)] == want[1:]
    assert [rows(x) for x in (found.after_delete.all(), found.live.result())] == want[1:]
