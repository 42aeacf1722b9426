"""What batches move: lines are put in order once, and components that lost edges are joined again where their pairs are."""

import pytest

from tidegraph.operators.components import connected_components, repair_components
from tidegraph.operators.programs import vertex_range
from tidegraph.sources.derived import evolving_graph


def test_an_evolving_graph_puts_its_lines_in_order_once(spark):
    for df in evolving_graph(spark, "/root/testdata/sf0.001"):
        assert "Window" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("hit", [1, 5])
def test_components_are_repaired_on_the_pairs_that_stay(spark, hit):
    """Six rings of four vertices, of which one or five lose two edges; a new edge connects two pieces."""
    schema, n = "src long, dst long", 24
    ring = [(4 * c + i, 4 * c + (i + 1) % 4) for c in range(6) for i in range(4)]
    lost = [(4 * c + i, 4 * c + i + 1) for c in range(hit) for i in (0, 2)]
    gained = [(1, 23)]
    stay = [p for p in ring if p not in lost]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    labels = connected_components(vertex_range(spark, n), frame(ring), small=1000)
    got = repair_components(labels, None, frame(lost), frame(gained), small=1000, stay=frame(stay))
    want = connected_components(vertex_range(spark, n), frame(stay + gained), small=1000)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
