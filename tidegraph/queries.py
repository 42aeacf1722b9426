"""The engine's registered queries on the driver's tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.columns import endpoint_weight, splitmix64
from .operators import analytics, checks, generate, pagerank, regions, repair, topology, vertex
from .operators.components import connected_components, repair_components
from .operators.direction import bfs_by_direction
from .operators.live import EdgeIndex, Live, LiveRanks, Outcome
from .operators.programs import BFS, LABEL_WITNESS, MIN_LABEL, SSSP, MinProgram, all_vertices, solve, vertex_range
from .operators.score_index import ScoreIndex
from .operators.store import EdgeStore, Step
from .plans.local import LOCAL_PAIRS
from .plans.state import new_path, settled
from .sources.derived import evolving_graph, kept_lines, order_lines, part_graph, vertex_count
from .sources.traces import read_trace, write_trace

ROOT, CAPACITY, JACOBI_ROUNDS = 1, 5_000, 20
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_LINES = """lines AS MATERIALIZED (SELECT * FROM (SELECT l_partkey AS src,
  lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag) AS dst,
  l_quantity AS quantity, l_returnflag AS flag, year(l_shipdate) AS year FROM lineitem) WHERE dst IS NOT NULL),
verts AS (SELECT unnest(range(0, (SELECT max(p_partkey) + 1 FROM part)))::BIGINT AS v)"""
_BAG = "SELECT src, dst, count(*)::BIGINT AS cnt FROM lines {} GROUP BY src, dst"
BATCHES = 3
_RETURNED = "CASE WHEN year <= 1995 THEN 0 WHEN year <= 1997 THEN 1 WHEN year <= 1998 THEN 2 ELSE year - 1999 END"


def _graph() -> str:
    return f"{_LINES}, g AS MATERIALIZED ({_BAG.format('')})"


def _evolving() -> str:
    """For each batch b: the graph before it (g0, g1, ...), its requests by pair with what is gone (p0, ...), and the graph after its deletes (m0, ...); g3 is the last."""
    out = f"{_LINES}, g0 AS MATERIALIZED ({_BAG.format('WHERE year <= 1998')})"
    for b in range(BATCHES):
        deleted, added = _BAG.format(f"WHERE flag = 'R' AND {_RETURNED} = {b}"), _BAG.format(f"WHERE year = {1999 + b}")
        out += f""",
p{b} AS MATERIALIZED (SELECT src, dst, coalesce(d.cnt, 0) AS dels, coalesce(a.cnt, 0) AS adds, least(coalesce(d.cnt, 0), coalesce(i.cnt, 0)) AS gone, coalesce(i.cnt, 0) AS have
  FROM ({deleted}) d FULL JOIN ({added}) a USING (src, dst) LEFT JOIN g{b} i USING (src, dst)),
m{b} AS MATERIALIZED (SELECT src, dst, g{b}.cnt - coalesce(gone, 0) AS cnt FROM g{b} LEFT JOIN p{b} USING (src, dst) WHERE g{b}.cnt - coalesce(gone, 0) > 0),
g{b + 1} AS MATERIALIZED (SELECT src, dst, sum(cnt)::BIGINT AS cnt FROM (SELECT * FROM m{b} UNION ALL SELECT src, dst, adds FROM p{b} WHERE adds > 0) GROUP BY src, dst)"""
    return out


def _each(sql: str) -> str:
    """The rows of ``sql`` for each batch, with batch_id; {b} is the batch, {c} the next one."""
    return " UNION ALL ".join(f"SELECT {b}::BIGINT AS batch_id, * FROM ({sql.format(b=b, c=b + 1)})" for b in range(BATCHES))


def _min_sql(name: str, graph: str, program: str) -> str:
    weight = {"bfs": "1", "sssp": "(e.src + e.dst) % 128 + 1", "label": "0"}[program]
    seed = "SELECT v, v AS value FROM verts" if program == "label" else f"SELECT {ROOT}::BIGINT AS v, 0::BIGINT AS value"
    return f"""{name}(v, value) USING KEY (v) AS ({seed} UNION
  SELECT e.dst, min(s.value + {weight})::BIGINT FROM {name} s JOIN {graph} e ON e.src = s.v LEFT JOIN recurring.{name} r ON r.v = e.dst
  WHERE r.v IS NULL OR r.value > s.value + {weight} GROUP BY e.dst)"""


def _parents(state: str, graph: str, program: str) -> str:
    weight = {"bfs": "1", "sssp": "(e.src + e.dst) % 128 + 1"}[program]
    return f"SELECT t.v, t.value, min(s.v) AS parent FROM {state} t LEFT JOIN {graph} e ON e.dst = t.v AND t.value > 0 LEFT JOIN {state} s ON s.v = e.src AND s.value + {weight} = t.value GROUP BY t.v, t.value"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return register


def _solved(spark: SparkSession, sf_dir: str, program: MinProgram) -> tuple[DataFrame, DataFrame, int]:
    n = vertex_count(spark, sf_dir)
    edges = settled(part_graph(spark, sf_dir))
    return edges, solve(edges, program, n, ROOT), n


# -- static queries ---------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'bfs')} {_parents('s', 'g', 'bfs')}".replace("t.value, min", "t.value AS hops, min"))
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir, BFS)[1].withColumnRenamed("value", "hops")


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'sssp')} {_parents('s', 'g', 'sssp')}".replace("t.value, min", "t.value AS dist, min"))
def sssp_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir, SSSP)[1].withColumnRenamed("value", "dist")


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'label')} SELECT v, value AS label FROM s")
def min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir, MIN_LABEL)[1].select("v", F.col("value").alias("label"))


_RANKS = """links AS MATERIALIZED (SELECT src, dst, 0.85::DOUBLE * cnt / sum(cnt) OVER (PARTITION BY src) AS share FROM {g}),
r(i, v, rank) AS (SELECT 0, v, 0.15::DOUBLE FROM verts UNION ALL
  SELECT i + 1, v, sum(x) FROM (SELECT r.i, unnest([r.v]) AS v, 0.15::DOUBLE AS x FROM r UNION ALL SELECT r.i, l.dst, r.rank * l.share FROM r JOIN links l ON l.src = r.v) WHERE i < {n} GROUP BY i, v)"""


@query(f"WITH RECURSIVE {_graph()}, {_RANKS.format(g='g', n=JACOBI_ROUNDS)} SELECT v, round(rank, 6) AS rank FROM r WHERE i = {JACOBI_ROUNDS}")
def pagerank_jacobi20(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = settled(part_graph(spark, sf_dir))
    return pagerank.jacobi(edges, vertex_count(spark, sf_dir), JACOBI_ROUNDS).select("v", F.round("rank", 6).alias("rank"))


@query(f"WITH RECURSIVE {_graph()}, {_RANKS.format(g='g', n=120)} SELECT v, round(rank, 3) AS rank FROM r WHERE i = 120")
def pagerank_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = settled(part_graph(spark, sf_dir))
    return pagerank.pagerank(edges, vertex_count(spark, sf_dir), 1e-9, 200).select("v", F.round("rank", 3).alias("rank"))


@query(f"WITH {_graph()} SELECT max(greatest(src, dst)) + 1 AS nnodes, sum(cnt)::BIGINT AS nedges, sum(cnt)::BIGINT / (max(greatest(src, dst)) + 1) AS avg_degree FROM g")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.graph_stats(part_graph(spark, sf_dir))


_DEGREE = "deg AS (SELECT v, coalesce(sum(cnt), 0)::BIGINT AS degree FROM verts LEFT JOIN g ON g.{side} = v GROUP BY v)"
_HIST = "SELECT CASE WHEN degree = 0 THEN -1 ELSE floor(log2(degree)) END::INT AS bucket, count(*) AS vertices FROM deg GROUP BY 1"


@query(f"WITH {_graph()}, {_DEGREE.format(side='src')} {_HIST}")
def out_degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.degree_histogram(analytics.degrees(part_graph(spark, sf_dir), vertex_count(spark, sf_dir)))


@query(f"WITH {_graph()}, {_DEGREE.format(side='dst')} {_HIST}")
def in_degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.degree_histogram(analytics.degrees(part_graph(spark, sf_dir), vertex_count(spark, sf_dir), "dst"))


@query(f"WITH {_graph()}, {_DEGREE.format(side='src')}, o AS (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS i, count(*) OVER () AS n FROM deg) SELECT min(degree) AS least, min(degree) FILTER (WHERE i = floor(0.5 * (n - 1))) AS median, min(degree) FILTER (WHERE i = floor(0.9 * (n - 1))) AS p90, max(degree) AS largest, sum(degree)::BIGINT AS total FROM o")
def degree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.degree_summary(analytics.degrees(part_graph(spark, sf_dir), vertex_count(spark, sf_dir)))


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'bfs')} SELECT count(*) AS reachable FROM s")
def reachable_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vertex_count(spark, sf_dir)
    return checks.reachable_count(solve(settled(part_graph(spark, sf_dir)), BFS, n, ROOT))


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'sssp')} SELECT count(*) AS rows, sum(value)::BIGINT AS total, sum(((v % 1000003) * 7919 + (value % 1000003) * 104729 + (v % 1000003) * (value % 1000003)) % 1000003)::BIGINT AS mark FROM s")
def distance_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.fingerprint(_solved(spark, sf_dir, SSSP)[1])


# -- checks: of right results, and of damaged ones, whose faults SQL counts -----------------------


@query("SELECT 0::BIGINT AS relaxable, 0::BIGINT AS unwitnessed")
def bellman_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state, _ = _solved(spark, sf_dir, SSSP)
    return checks.bellman_check(edges, state, SSSP)


@query("SELECT 0::BIGINT AS missing_parent, 0::BIGINT AS no_edge, 0::BIGINT AS not_tight")
def parent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state, _ = _solved(spark, sf_dir, BFS)
    return checks.parent_check(edges, state, BFS)


@query("SELECT 0::BIGINT AS wrong")
def min_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state, n = _solved(spark, sf_dir, MIN_LABEL)
    return checks.label_check(edges, state, n).agg(F.count("*").alias("wrong"))


@query("SELECT true AS converged, true AS invariant")
def pagerank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, edges = vertex_count(spark, sf_dir), settled(part_graph(spark, sf_dir))
    row = pagerank.invariant_defect(pagerank.pagerank(edges, n), edges, n)
    return row.select((F.col("largest_residual") <= pagerank.EPSILON).alias("converged"), (F.col("worst") < 1e-9).alias("invariant"))


_DAMAGED = "t AS MATERIALIZED (SELECT v, CASE WHEN v % 50 = 7 THEN value + 3 WHEN v % 50 = 11 THEN greatest(value - 2, 0) ELSE value END AS value FROM s)"


def _damaged(state: DataFrame) -> DataFrame:
    """Every fiftieth value too large, another too small."""
    wrong = F.when(F.col("v") % 50 == 7, F.col("value") + 3).when(F.col("v") % 50 == 11, F.greatest(F.col("value") - 2, F.lit(0))).otherwise(F.col("value"))
    return state.withColumn("value", wrong)


@query(f"""WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'sssp')}, {_DAMAGED},
e AS (SELECT g.dst, a.value + (g.src + g.dst) % 128 + 1 AS x, b.value AS y FROM g JOIN t a ON a.v = g.src LEFT JOIN t b ON b.v = g.dst)
SELECT (SELECT count(*) FROM e WHERE y IS NULL OR x < y) AS relaxable, (SELECT count(*) FROM t WHERE value <> 0 AND v NOT IN (SELECT dst FROM e WHERE x = y)) AS unwitnessed""")
def bellman_check_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state, _ = _solved(spark, sf_dir, SSSP)
    return checks.bellman_check(edges, _damaged(state), SSSP)


@query(f"""WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'bfs')}, w AS ({_parents('s', 'g', 'bfs')}),
t AS (SELECT v, value, CASE WHEN v % 40 = 3 THEN NULL WHEN v % 40 = 5 THEN (v + 1) % (SELECT max(v) + 1 FROM verts) ELSE parent END AS parent FROM w WHERE value <> 0)
SELECT count(*) FILTER (WHERE t.parent IS NULL) AS missing_parent, count(*) FILTER (WHERE t.parent IS NOT NULL AND g.src IS NULL) AS no_edge, count(*) FILTER (WHERE t.parent IS NOT NULL AND coalesce(u.value + 1 <> t.value, true)) AS not_tight
FROM t LEFT JOIN g ON g.src = t.parent AND g.dst = t.v LEFT JOIN s u ON u.v = t.parent""")
def parent_check_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fortieth parent taken away, another replaced by the next vertex."""
    edges, state, n = _solved(spark, sf_dir, BFS)
    wrong = F.when(F.col("v") % 40 == 3, F.lit(None)).when(F.col("v") % 40 == 5, (F.col("v") + 1) % n).otherwise(F.col("parent")).cast("long")
    return checks.parent_check(edges, state.withColumn("parent", F.when(F.col("value") != 0, wrong)), BFS)


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'label')} SELECT v, value + 1 AS label, value AS expected FROM s WHERE v % 50 = 7")
def min_label_check_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state, n = _solved(spark, sf_dir, MIN_LABEL)
    return checks.label_check(edges, state.withColumn("value", F.when(F.col("v") % 50 == 7, F.col("value") + 1).otherwise(F.col("value"))), n)


@query(f"WITH {_graph()} SELECT (SELECT count(*) FROM verts WHERE v % 50 = 7) AS broken")
def pagerank_check_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals changed by 0.5 break the invariant at just these vertices."""
    n, edges = vertex_count(spark, sf_dir), settled(part_graph(spark, sf_dir))
    state = pagerank.pagerank(edges, n).withColumn("residual", F.col("residual") + F.when(F.col("v") % 50 == 7, 0.5).otherwise(0.0))
    return pagerank.invariant_gaps(state, edges, n).where("gap > 0.1").agg(F.count("*").alias("broken"))


# -- all batches in order, each from what the one before left ----------------------------------------

Each = Callable[[Step, DataFrame, int], DataFrame]


def _batch_list(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> tuple[DataFrame, list[tuple[int, DataFrame]], int]:
    initial, batches = evolving_graph(spark, sf_dir, lines)
    batches = settled(batches)
    ids = sorted(r.batch_id for r in batches.select("batch_id").distinct().collect())
    return initial, [(b, batches.where(F.col("batch_id") == b).select("op", "src", "dst", "cnt")) for b in ids], vertex_count(spark, sf_dir)


def _batches(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> tuple[EdgeStore, list[tuple[int, DataFrame]], int]:
    initial, batches, n = _batch_list(spark, sf_dir, lines)
    return EdgeStore.of(initial), batches, n


def _by_batch(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    out = [x.select(F.lit(b).cast("long").alias("batch_id"), "*") for b, x in parts]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _replayed(spark: SparkSession, sf_dir: str, each: Each) -> DataFrame:
    """The rows of ``each`` (step, batch, n) of every batch."""
    store, batches, n = _batches(spark, sf_dir)
    parts = []
    for b, batch in batches:
        step = store.apply(batch, n)
        parts.append((b, each(step, batch, n)))
        store = step.after
    return _by_batch(parts)


@query(f"""WITH {_evolving()} {_each("SELECT (SELECT sum(adds) FROM p{b})::BIGINT AS additions, (SELECT sum(dels) FROM p{b})::BIGINT AS deletions, count(DISTINCT src) AS touched_sources, "
 "count(DISTINCT src) FILTER (WHERE gone > 0 OR adds > 0) AS changed_sources, sum(dels - gone)::BIGINT AS missing_deletes, 0::BIGINT AS invalid_additions, "
 "(SELECT max(x) FROM (SELECT sum(adds + dels) AS x FROM p{b} GROUP BY src))::BIGINT AS max_source_work, (SELECT sum(cnt) FROM g{c})::BIGINT AS graph_edges FROM p{b}")}""")
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda step, b, n: topology.batch_metrics(step.plan).join(F.broadcast(step.after.view().agg(F.sum("cnt").alias("graph_edges")))))


@query(f"WITH {_evolving()} {_each('SELECT src, dst, -gone AS delta FROM p{b} WHERE gone > 0 UNION ALL SELECT src, dst, adds FROM p{b} WHERE adds > 0')}")
def batch_effective_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda step, b, n: topology.effective_changes(step.plan))


@query(f"WITH {_evolving()} {_each('SELECT src, dst, (dels - gone)::BIGINT AS missing FROM p{b} WHERE dels > gone')}")
def missing_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda step, b, n: step.plan.select("src", "dst", (F.col("dels") - F.col("gone")).alias("missing")).where("missing > 0"))


_PHASES = "SELECT 'delete' AS phase, * FROM m{b} UNION ALL SELECT 'add', * FROM g{c}"


@query(f"WITH {_evolving()} {_each(_PHASES)}")
def edges_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda step, b, n: step.mid.view().withColumn("phase", F.lit("delete")).unionByName(step.after.view().withColumn("phase", F.lit("add"))))


@query(f"WITH {_evolving()} {_each('SELECT src, sum(cnt)::BIGINT AS degree, count(*) AS pairs, sum(((dst * 40503 + cnt * 7919) % 1000003) * cnt)::BIGINT AS multiset FROM g{c} GROUP BY src')}")
def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda step, b, n: topology.digests(step.after.view()))


@query(f"WITH {_evolving()} {_each('SELECT DISTINCT src FROM p{b} WHERE dels > 0 OR adds > 0')}")
def changed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda step, b, n: topology.changed_sources(b.where("op = 'd'"), b.where("op = 'a'")))


@query(f"WITH {_graph()} SELECT dst, src, cnt FROM g")
def incoming_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.incoming(part_graph(spark, sf_dir), vertex_range(spark, vertex_count(spark, sf_dir)))


@query(_each("SELECT 0::BIGINT AS mismatches"))
def topology_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch applied by bag arithmetic against the interval log of all batches at the same epoch."""
    log = settled(topology.dependency_log(*evolving_graph(spark, sf_dir)))
    epochs = iter(range(1, BATCHES + 1))
    return _replayed(spark, sf_dir, lambda step, b, n: topology.topology_mismatches(step.after.view(), topology.as_of(log, next(epochs))).agg(F.count("*").alias("mismatches")))


@query(f"WITH {_evolving()} {_each('SELECT coalesce(x.src, y.src) AS src, coalesce(x.dst, y.dst) AS dst, coalesce(x.cnt, 0) - coalesce(y.cnt, 0) AS delta FROM g{c} x FULL JOIN m{b} y USING (src, dst) WHERE coalesce(x.cnt, 0) <> coalesce(y.cnt, 0)')}")
def topology_audit_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after each batch against one that lacks the batch's adds."""
    return _replayed(spark, sf_dir, lambda step, b, n: topology.topology_mismatches(step.after.view(), step.mid.view()))


def _log_sql() -> str:
    """Occurrences by pair, the epochs at which they are born and retired; a delete takes those that were born last."""
    out, live = "", "SELECT src, dst, 0::BIGINT AS born, cnt FROM g0"
    for b in range(BATCHES):
        out += f""", live{b} AS MATERIALIZED ({live}),
cut{b} AS MATERIALIZED (SELECT l.src, l.dst, l.born, l.cnt, greatest(0, least(l.cnt, coalesce(p.gone, 0) - coalesce(sum(l.cnt) OVER (PARTITION BY l.src, l.dst ORDER BY l.born DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS gone
  FROM live{b} l LEFT JOIN p{b} p USING (src, dst))"""
        live = f"SELECT src, dst, born, cnt - gone AS cnt FROM cut{b} WHERE cnt > gone UNION ALL SELECT src, dst, {b + 1}, adds FROM p{b} WHERE adds > 0"
    ended = " UNION ALL ".join(f"SELECT src, dst, born, {b + 1}::BIGINT AS retired, gone AS cnt FROM cut{b} WHERE gone > 0" for b in range(BATCHES))
    return f"WITH {_evolving()}{out} {ended} UNION ALL SELECT src, dst, born, 0, cnt FROM ({live})"


@query(_log_sql())
def dependency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.dependency_log(*evolving_graph(spark, sf_dir))


@query(f"WITH {_graph()} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, greatest(sum(cnt) FILTER (WHERE src <= dst), sum(cnt) FILTER (WHERE src > dst))::BIGINT AS cnt FROM g GROUP BY 1, 2")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.undirected(part_graph(spark, sf_dir))


def _undirected_sql() -> str:
    pair = "SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM {} WHERE src <> dst AND {}"
    out, have, parts = "", pair.format("g0", "true"), []
    for b in range(BATCHES):
        out += f", u{b} AS MATERIALIZED ({have}), ud{b} AS MATERIALIZED ({pair.format(f'p{b}', 'dels > 0')} INTERSECT SELECT * FROM u{b}), ua{b} AS MATERIALIZED ({pair.format(f'p{b}', 'adds > 0')} EXCEPT (SELECT * FROM u{b} EXCEPT SELECT * FROM ud{b}))"
        have = f"(SELECT * FROM u{b} EXCEPT SELECT * FROM ud{b}) UNION SELECT * FROM ua{b}"
        parts += [f"SELECT {b}::BIGINT AS batch_id, '{op}' AS op, {ends} FROM {t}{b}" for op, t in (("d", "ud"), ("a", "ua")) for ends in ("src, dst", "dst, src")]
    return f"WITH {_evolving()}{out} {' UNION ALL '.join(parts)}"


@query(_undirected_sql())
def undirected_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.undirected_batches(*evolving_graph(spark, sf_dir))[1].drop("cnt")


@query(f"WITH {_evolving()} {_each('SELECT src, max(adds)::BIGINT AS version, coalesce(any_value(d.degree), 0)::BIGINT AS degree FROM p{b} LEFT JOIN (SELECT src, sum(cnt) AS degree FROM g{c} GROUP BY src) d USING (src) WHERE adds > 0 GROUP BY src')}")
def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    degree = lambda edges: edges.groupBy("src").agg(F.sum("cnt").alias("degree"))
    return _replayed(spark, sf_dir, lambda step, b, n: topology.latest_versions(b.where("op = 'a'").select("src", F.col("cnt").alias("version")), degree(step.after.view())))


@query(f"WITH {_evolving()} {_each('SELECT src, dst, x.cnt AS base_cnt, least(x.cnt, coalesce(y.cnt, 0)) AS matched FROM g{b} x LEFT JOIN g{c} y USING (src, dst)')}")
def ordered_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replayed(spark, sf_dir, lambda step, b, n: topology.ordered_survivors(step.before.view(), step.after.view()))


@query(f"WITH {_graph()}, d AS (SELECT src, sum(cnt) AS degree FROM g GROUP BY src), p AS (SELECT src, sum(degree) OVER (ORDER BY src) - degree AS before, sum(degree) OVER () AS total FROM d) SELECT src AS v, floor(before * 16 / total)::INT AS segment FROM p")
def vertex_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.segments(part_graph(spark, sf_dir), 16)


# -- rows in their order: each vertex's out-edges by order and line ------------------------------------------

_ROWS = """o AS MATERIALIZED (SELECT l_partkey AS src, l_orderkey * 1000 + l_linenumber AS seq, l_returnflag AS flag, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag) AS dst FROM lineitem),
rows AS MATERIALIZED (SELECT src, list(dst ORDER BY seq, dst) AS r, list(dst ORDER BY seq, dst) FILTER (WHERE flag <> 'R') AS s FROM o WHERE dst IS NOT NULL GROUP BY src)"""


def _rows_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, seq, dst, flag) of every edge, in the order of its order and line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag")
    rows = lines.select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"), F.lead("l_partkey").over(by).alias("dst"), F.col("l_returnflag").alias("flag"))
    return rows.where("dst is not null")


@query(f"""WITH {_ROWS}, h AS (SELECT src, len(r)::BIGINT AS degree, list_reduce([14695981039346656037::UBIGINT] || list_transform(r, lambda x: x::UBIGINT), lambda h, x: ((xor(h, x)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS u FROM rows)
SELECT src, degree, CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS fnv FROM h""")
def ordered_source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.ordered_digests(_rows_in_order(spark, sf_dir).select("src", "seq", "dst"))


@query(f"WITH {_ROWS} SELECT src, len(r)::BIGINT AS base_rows, list_reduce([0::BIGINT] || coalesce(s, []), lambda i, y: CASE WHEN r[i + 1] = y THEN i + 1 ELSE i END)::BIGINT AS matched FROM rows")
def ordered_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vertex's row is matched in order by the row without returned lines."""
    rows = _rows_in_order(spark, sf_dir)
    return topology.is_subsequence(rows.select("src", "seq", "dst"), rows.where("flag != 'R'").select("src", "seq", "dst"))


# -- incremental queries: both phases of all batches ---------------------------------------------------


def _both(done: repair.Repaired, column: str) -> DataFrame:
    one = done.after_delete.withColumn("phase", F.lit("delete")).unionByName(done.state.withColumn("phase", F.lit("add")))
    return one.select("phase", "v", F.col("value").alias(column))


def _repaired(spark: SparkSession, sf_dir: str, program: MinProgram, column: str, **how: int) -> DataFrame:
    store, batches, n = _batches(spark, sf_dir)
    state, parts = solve(store.base, program, n, ROOT, small=how.get("small")), []
    for b, batch in batches:
        done = repair.update(store, state, batch, program, n, **how)
        parts.append((b, _both(done, column)))
        store, state = done.store, done.state
    return _by_batch(parts)


def _both_sql(program: str, column: str) -> str:
    states = ", ".join(f"{_min_sql(f'x{b}', f'm{b}', program)}, {_min_sql(f'y{b}', f'g{b + 1}', program)}" for b in range(BATCHES))
    return f"WITH RECURSIVE {_evolving()}, {states} " + _each(f"SELECT 'delete' AS phase, v, value AS {column} FROM x{{b}} UNION ALL SELECT 'add', v, value FROM y{{b}}")


@query(_both_sql("bfs", "hops"))
def bfs_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, BFS, "hops")


@query(_both_sql("sssp", "dist"))
def sssp_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, SSSP, "dist")


@query(_both_sql("label", "label"))
def min_label_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, MIN_LABEL, "label")


@query(f"WITH RECURSIVE {_evolving()}, {', '.join(_min_sql(f'y{b}', f'g{b + 1}', 'sssp') for b in range(BATCHES))} {_each('SELECT v, value AS dist FROM y{b}')}")
def sssp_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, batches, n = _batches(spark, sf_dir)
    state, parts = solve(store.base, SSSP, n, ROOT), []
    for b, batch in batches:
        done = repair.final_state_update(store, state, batch, SSSP, n)
        parts.append((b, done.state.select("v", F.col("value").alias("dist"))))
        store, state = done.store, done.state
    return _by_batch(parts)


def _ranks_sql(b: int) -> str:
    return _RANKS.format(g=f"g{b + 1}", n=120).replace("links", f"links{b}").replace("r(i, v", f"r{b}(i, v").replace("FROM r ", f"FROM r{b} r ")


_RANKED = f"WITH RECURSIVE {_evolving()}, {', '.join(_ranks_sql(b) for b in range(BATCHES))} {_each('SELECT v, round(rank, 3) AS rank FROM r{b} WHERE i = 120')}"


@query(_RANKED)
def pagerank_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, batches, n = _batches(spark, sf_dir)
    state, parts = pagerank.pagerank(store.base, n, 1e-9, 200), []
    for b, batch in batches:
        done = pagerank.update_pagerank(store, state, batch, n, 1e-9, 200)
        parts.append((b, done.state.select("v", F.round("rank", 3).alias("rank"))))
        store, state = done.store, done.state
    return _by_batch(parts)


# -- the same by the distributed rounds, whatever the size of the graph -----------------------------------


@query(ORACLE_SQL["bfs_levels"])
def bfs_levels_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vertex_count(spark, sf_dir)
    return solve(settled(part_graph(spark, sf_dir)), BFS, n, ROOT, small=-1).withColumnRenamed("value", "hops")


@query(ORACLE_SQL["bfs_levels"])
def bfs_levels_by_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds that push or pull, by the edges that they would read."""
    return bfs_by_direction(EdgeIndex.of(part_graph(spark, sf_dir)), vertex_count(spark, sf_dir), ROOT)[0].withColumnRenamed("value", "hops")


@query(ORACLE_SQL["sssp_dist"])
def sssp_dist_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vertex_count(spark, sf_dir)
    return solve(settled(part_graph(spark, sf_dir)), SSSP, n, ROOT, small=-1).withColumnRenamed("value", "dist")


@query(ORACLE_SQL["min_label"])
def min_label_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = vertex_count(spark, sf_dir)
    return solve(settled(part_graph(spark, sf_dir)), MIN_LABEL, n, ROOT, small=-1).select("v", F.col("value").alias("label"))


@query(ORACLE_SQL["pagerank_residual"])
def pagerank_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = settled(part_graph(spark, sf_dir))
    return pagerank.pagerank(edges, vertex_count(spark, sf_dir), 1e-9, 200, small=-1).select("v", F.round("rank", 3).alias("rank"))


@query(ORACLE_SQL["bfs_after_batch"])
def bfs_after_batch_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounds ordered by ranges of two hops."""
    return _repaired(spark, sf_dir, BFS, "hops", small=-1, bucket=2)


@query(ORACLE_SQL["min_label_after_batch"])
def min_label_after_batch_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repaired(spark, sf_dir, MIN_LABEL, "label", small=-1)


def _live(spark: SparkSession, sf_dir: str, program: MinProgram) -> list[tuple[int, Outcome]]:
    """Every batch on a two-sided index; batches of more rows than a lookup may have are repaired by rounds."""
    initial, batches, n = _batch_list(spark, sf_dir)
    live, out = Live.start(initial, program, n, ROOT), []
    for b, batch in batches:
        out.append((b, live.apply(batch)))
        live = out[-1][1].live
    return out


def _phases(done: Outcome, value: Column) -> DataFrame:
    one = done.after_delete.all().withColumn("phase", F.lit("delete")).unionByName(done.live.result().withColumn("phase", F.lit("add")))
    return one.select("phase", "v", value)


@query(ORACLE_SQL["sssp_after_batch"])
def sssp_after_batch_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_batch([(b, _phases(done, F.col("value").alias("dist"))) for b, done in _live(spark, sf_dir, SSSP)])


@query(ORACLE_SQL["min_label_after_batch"].replace("v, value AS label", "v, value AS label, true AS certified").replace("'add', v, value", "'add', v, value, true"))
def label_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after each phase, and whether each is proved: by being its own root, or by a parent of the same label that is nearer to it, over an edge that is there."""
    parts = []
    for b, done in _live(spark, sf_dir, LABEL_WITNESS):
        for phase, state, edges in (("delete", done.after_delete, done.step.mid), ("add", done.live.state, done.step.after)):
            parts.append((b, checks.certified_labels(state.all(), edges.pairs(done.live.n, "dst")).select(F.lit(phase).alias("phase"), "v", "label", "certified")))
    return _by_batch(parts)


@query(_RANKED)
def pagerank_after_batch_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, batches, n = _batch_list(spark, sf_dir)
    live, parts = LiveRanks.start(initial, n, 1e-9, 200), []
    for b, batch in batches:
        live = live.apply(batch)
        parts.append((b, live.result().select("v", F.round("rank", 3).alias("rank"))))
    return _by_batch(parts)


@query(f"WITH {_evolving()} {_each('SELECT dst, src, cnt FROM g{c}')}")
def incoming_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incoming rows of all vertices after each batch, from the index's side by destination."""
    initial, batches, n = _batch_list(spark, sf_dir)
    index, parts = EdgeIndex.of(initial), []
    for b, batch in batches:
        index = index.apply(batch, n).after
        parts.append((b, index.into.all().select("dst", "src", "cnt")))
    return _by_batch(parts)


# -- general vertex programs; the most urgent vertices send first -----------------------------------------


def _run(spark: SparkSession, sf_dir: str, program: vertex.VertexProgram, share: float) -> vertex.Run:
    return vertex.solve(program, settled(part_graph(spark, sf_dir)), vertex_count(spark, sf_dir), ROOT, share)


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'sssp')} SELECT v, value AS dist FROM s")
def sssp_dist_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, vertex.DISTANCE, 0.2).result("dist")


@query(ORACLE_SQL["min_label"])
def min_label_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, vertex.LABEL, 0.2).result("label")


@query(f"""WITH RECURSIVE {_graph()}, s(v, width) USING KEY (v) AS (SELECT {ROOT}::BIGINT, {1 << 31}::BIGINT UNION
  SELECT e.dst, max(least(s.width, (e.src + e.dst) % 128 + 1))::BIGINT FROM s JOIN g e ON e.src = s.v LEFT JOIN recurring.s r ON r.v = e.dst
  WHERE r.v IS NULL OR r.width < least(s.width, (e.src + e.dst) % 128 + 1) GROUP BY e.dst) SELECT v, width FROM s""")
def widest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest width of a path from the root, which is that of its narrowest edge."""
    return _run(spark, sf_dir, vertex.WIDEST, 0.5).result("width")


@query(f"""WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'bfs')}, d AS (SELECT src, count(*) AS out FROM g GROUP BY src)
SELECT value + 1 AS round, count(*) AS senders, 0::BIGINT AS waiting, coalesce(sum(out), 0)::BIGINT AS messages, coalesce(sum(out), 0)::BIGINT * 16 AS bytes FROM s LEFT JOIN d ON d.src = s.v GROUP BY value""")
def round_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every round of a breadth-first search sends."""
    return _run(spark, sf_dir, vertex.HOPS, 1.0).ledger()


@query(ORACLE_SQL["pagerank_residual"])
def pagerank_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = vertex.solve(vertex.ranks(1e-9), settled(part_graph(spark, sf_dir)), vertex_count(spark, sf_dir), share=0.8, max_rounds=400, unroll=4)
    return done.result("rank").select("v", F.round("rank", 3).alias("rank"))


# -- analytics ----------------------------------------------------------------------------------

_HITS = f"""WITH {_LINES}, hits AS MATERIALIZED (SELECT src AS v, (year - 1990)::BIGINT AS batch_id, count(*)::BIGINT AS hits FROM lines GROUP BY 1, 2),
score AS MATERIALIZED (SELECT v, batch_id, sum(hits % 256) OVER (PARTITION BY v ORDER BY batch_id RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)::BIGINT AS score FROM hits)"""


def _hits(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("src").alias("v"), (F.col("year") - 1990).alias("batch_id")).agg(F.count("*").alias("hits"))


@query(f"{_HITS} SELECT * FROM score")
def activity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.activity(_hits(order_lines(spark, sf_dir)))


_ADMITTED = """, deg{c} AS (SELECT src AS v, sum(cnt)::BIGINT AS degree FROM g{c} GROUP BY src),
adm{c} AS MATERIALIZED (SELECT v, score, degree, before FROM (SELECT v, score, degree, (sum(degree) OVER (ORDER BY score DESC, v) - degree)::BIGINT AS before FROM score JOIN deg{c} USING (v) WHERE batch_id = {y}) WHERE before + degree < """ + f"{CAPACITY})"
_ADMITS = f"{_HITS}, {_evolving().removeprefix(_LINES + ', ')}" + "".join(_ADMITTED.format(c=c, y=c + 8) for c in range(BATCHES + 1))


def _admitted(spark: SparkSession, sf_dir: str) -> list[tuple[int, DataFrame]]:
    """(batch_id, what is admitted after it), with -1 for the initial graph; the hits of batch b are those of its year."""
    lines = kept_lines(spark, sf_dir)
    store, batches, n = _batches(spark, sf_dir, lines)
    scores, out = settled(analytics.activity(_hits(lines))), []
    for b, batch in [(-1, None), *batches]:
        store = store if batch is None else store.apply(batch, n).after
        degree = store.view().groupBy(F.col("src").alias("v")).agg(F.sum("cnt").alias("degree"))
        out.append((b, settled(analytics.admission(scores.where(F.col("batch_id") == b + 9).select("v", "score"), degree, CAPACITY))))
    return out


@query(_ADMITS + " " + " UNION ALL ".join(f"SELECT {c - 1}::BIGINT AS batch_id, * FROM adm{c}" for c in range(BATCHES + 1)))
def cache_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_batch(_admitted(spark, sf_dir))


@query(_ADMITS + " " + _each("""SELECT count(*) FILTER (WHERE a.v IS NULL) AS admitted, count(*) FILTER (WHERE b.v IS NULL) AS evicted, count(*) FILTER (WHERE a.degree <> b.degree) AS degree_changed, count(*) FILTER (WHERE a.degree = b.degree) AS kept,
coalesce(sum(b.degree) FILTER (WHERE a.v IS NULL OR a.degree <> b.degree), 0)::BIGINT AS patch_edges, (4 * coalesce(sum(b.degree) FILTER (WHERE a.v IS NULL OR a.degree <> b.degree), 0))::BIGINT AS patch_bytes FROM adm{b} a FULL JOIN adm{c} b ON a.v = b.v"""))
def cache_patch_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _admitted(spark, sf_dir)
    return _by_batch([(b, analytics.cache_diff(old, new)) for (_, old), (b, new) in zip(kept, kept[1:])])


@query(_ADMITS + " " + _each("SELECT (SELECT count(*) FROM adm{b}) <> (SELECT count(*) FROM adm{c}) OR EXISTS (SELECT v FROM adm{c} EXCEPT SELECT v FROM adm{b}) AS refresh, false AS same"))
def cache_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _admitted(spark, sf_dir)
    rows = [(b, analytics.needs_refresh(old, new), analytics.needs_refresh(new, new)) for (_, old), (b, new) in zip(kept, kept[1:])]
    return spark.createDataFrame(rows, "batch_id bigint, refresh boolean, same boolean")


@query(ORACLE_SQL["cache_patch_diff"])
def cache_patch_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same differences from the admitted sets as they are written to binary traces and read back."""
    path = new_path(spark, "traces")
    sets = [x.select(F.lit(b + 1).cast("long").alias("batch_id"), F.lit(CAPACITY).cast("long").alias("capacity_edges"), F.col("v").alias("vertex"), "degree") for b, x in _admitted(spark, sf_dir)]
    for more in sets[1:]:
        sets[0] = sets[0].unionByName(more)
    write_trace(sets[0], path, "cache")
    back = read_trace(spark, path, "cache")
    kept = [back.where(F.col("batch_id") == b).select(F.col("vertex").alias("v"), "degree") for b in range(BATCHES + 1)]
    return _by_batch([(b, analytics.cache_diff(old, new)) for b, (old, new) in enumerate(zip(kept, kept[1:]))])


def _sources_sql() -> str:
    """Reached sets as bit strings, a bit a vertex."""
    gone = " UNION ALL ".join(f"SELECT {b} AS b, src, dels FROM p{b} WHERE dels > 0" for b in range(BATCHES))
    return f"""WITH RECURSIVE {_evolving()}, own AS MATERIALIZED (SELECT v, set_bit(repeat('0', (SELECT count(*) FROM verts)::INT)::BIT, v::INT, 1) AS m FROM verts),
r(v, m) USING KEY (v) AS (SELECT v, m FROM own UNION
  SELECT e.src, bit_or(r.m | o.m) FROM r JOIN g0 e ON e.dst = r.v LEFT JOIN recurring.r o ON o.v = e.src WHERE (r.m | o.m) <> o.m GROUP BY e.src),
d AS MATERIALIZED (SELECT src AS v, sum(dels)::BIGINT AS records, bit_or(1 << b) AS batches FROM ({gone}) GROUP BY src)
SELECT r.v AS source, bit_count(any_value(r.m))::BIGINT AS reachable, coalesce(sum(d.records), 0)::BIGINT AS deletion_records, coalesce(bit_count(bit_or(d.batches)), 0)::BIGINT AS deletion_batches
FROM r LEFT JOIN d ON get_bit(r.m, d.v::INT) = 1 WHERE r.v IN (SELECT src FROM g0) GROUP BY r.v ORDER BY deletion_batches DESC, deletion_records DESC, reachable DESC, source LIMIT 8"""


@query(_sources_sql())
def best_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight vertices of the initial graph that see the most of all batches' deletions."""
    initial, batches = evolving_graph(spark, sf_dir)
    return regions.best_sources(settled(initial), settled(batches.where("op = 'd'")))


CAPACITIES = [0, 1_000, 5_000, 20_000, 1_000_000]


@query(f"""{_HITS}, deg AS (SELECT src AS v, count(*)::BIGINT AS degree FROM lines GROUP BY src), c AS (SELECT unnest({CAPACITIES})::BIGINT AS capacity),
t AS (SELECT v, CASE WHEN batch_id = 11 THEN score ELSE score / 2 END::BIGINT AS score FROM score WHERE batch_id >= 10 AND (batch_id = 11 OR v NOT IN (SELECT v FROM score WHERE batch_id = 11))),
r AS (SELECT sum(degree) OVER (ORDER BY score DESC, v) AS upto FROM t JOIN deg USING (v) WHERE score > 0)
SELECT capacity, count(upto) AS candidates FROM c LEFT JOIN r ON upto < capacity GROUP BY capacity""")
def score_index_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the scores of one batch, then the next batch's scores in their place; how many candidates fit several capacities."""
    scores = settled(analytics.activity(_hits(order_lines(spark, sf_dir))))
    degree = part_graph(spark, sf_dir).groupBy(F.col("src").alias("v")).agg(F.sum("cnt").alias("degree"))
    rows = lambda b, score: scores.where(F.col("batch_id") == b).join(degree, "v").select("v", score.cast("long").alias("score"), "degree")
    now = analytics.rescored(rows(10, F.floor(F.col("score") / 2)), rows(11, F.col("score")))
    return analytics.prefix_counts(now, CAPACITIES)


_CAPS = f"c AS (SELECT unnest({CAPACITIES})::BIGINT AS capacity)"


@query(f"{_ADMITS}, {_CAPS} " + " UNION ALL ".join(
    f"SELECT {c - 1}::BIGINT AS batch_id, capacity, count(upto) AS candidates FROM c LEFT JOIN (SELECT sum(degree) OVER (ORDER BY score DESC, v) AS upto FROM score JOIN deg{c} USING (v) WHERE batch_id = {c + 8} AND score > 0) ON upto < capacity GROUP BY capacity"
    for c in range(BATCHES + 1)))
def score_index_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates fit several capacities after each batch, by one index that each batch changes."""
    lines = kept_lines(spark, sf_dir)
    store, batches, n = _batches(spark, sf_dir, lines)
    scores, out, index, old = settled(analytics.activity(_hits(lines))), [], None, None
    for b, batch in [(-1, None), *batches]:
        store = store if batch is None else store.apply(batch, n).after
        degree = store.view().groupBy(F.col("src").alias("v")).agg(F.sum("cnt").alias("degree"))
        new = settled(scores.where(F.col("batch_id") == b + 9).select("v", "score").join(degree, "v"))
        index = ScoreIndex.of(new) if index is None else index.update_all(old, new)
        old = new
        out += [(b, c, index.count(c)) for c in CAPACITIES]
    return spark.createDataFrame(out, "batch_id bigint, capacity bigint, candidates bigint")


@query(f"""WITH RECURSIVE {_HITS.removeprefix('WITH ')}, g AS MATERIALIZED ({_BAG.format('')}), {_min_sql('s', 'g', 'bfs')}
SELECT x.v, x.batch_id, CASE WHEN s.value <= 1 THEN score ELSE 0 END::BIGINT AS score FROM score x LEFT JOIN s ON s.v = x.v""")
def masked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of what the root reaches in one hop; the others' are 0."""
    _, state, _ = _solved(spark, sf_dir, BFS)
    return analytics.masked(analytics.activity(_hits(order_lines(spark, sf_dir))), state.where("value <= 1"))


REGIONS = 4


@query(f"WITH {_graph()} SELECT dst % {REGIONS} AS region, src, dst, cnt, src % {REGIONS} = dst % {REGIONS} AS internal FROM g")
def boundary_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.partition_edges(part_graph(spark, sf_dir), _regions(spark, sf_dir))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_range(spark, vertex_count(spark, sf_dir)).select("v", (F.col("v") % REGIONS).alias("region"))


@query(f"""WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'bfs')}, e AS (SELECT g.*, dst % {REGIONS} AS region, src % {REGIONS} = dst % {REGIONS} AS internal, s.v IS NOT NULL AS ok FROM g LEFT JOIN s ON s.v = g.src)
SELECT region, sum(cnt)::BIGINT AS incoming, coalesce(sum(cnt) FILTER (WHERE internal), 0)::BIGINT AS internal, coalesce(sum(cnt) FILTER (WHERE NOT internal), 0)::BIGINT AS boundary, count(DISTINCT src) FILTER (WHERE NOT internal) AS boundary_sources,
coalesce(sum(cnt) FILTER (WHERE NOT internal AND ok), 0)::BIGINT AS finite_boundary, count(DISTINCT dst) FILTER (WHERE NOT internal AND ok) AS seeds FROM e GROUP BY region""")
def region_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, state, _ = _solved(spark, sf_dir, BFS)
    return analytics.partition_report(edges, _regions(spark, sf_dir), state)


@query(f"WITH {_graph()} SELECT v, row_number() OVER (ORDER BY v) - 1 AS local FROM (SELECT src AS v FROM g UNION SELECT dst FROM g)")
def local_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_graph(spark, sf_dir)
    return analytics.local_ids(edges.select(F.col("src").alias("v")).union(edges.select("dst")))


def _wide(x: str, sign: str, b: int) -> str:
    return f"((({x})::UHUGEINT {sign} {b}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _splitmix_sql(x: str) -> str:
    """SplitMix64 of an unsigned 64-bit expression."""
    z = _wide(x, "+", 0x9E3779B97F4A7C15)
    z = _wide(f"xor({z}, {z} >> 30)", "*", 0xBF58476D1CE4E5B9)
    z = _wide(f"xor({z}, {z} >> 27)", "*", 0x94D049BB133111EB)
    return f"xor({z}, {z} >> 31)"


POOL, POOL_SEED = 500, 1


@query(f"""WITH {_evolving()}, n AS (SELECT src, dst, g3.cnt, coalesce(x.cnt, 0) AS base_cnt, sum(g3.cnt) OVER (ORDER BY src, dst) - g3.cnt AS before FROM g3 LEFT JOIN (SELECT src, dst, least(g0.cnt, y.cnt) AS cnt FROM g0 JOIN g3 y USING (src, dst)) x USING (src, dst)),
o AS (SELECT src, dst, base_cnt, (before + i)::BIGINT AS occ, i < base_cnt AS in_base FROM (SELECT *, unnest(range(0, cnt)) AS i FROM n)),
h AS MATERIALIZED (SELECT *, {_splitmix_sql(f"xor(occ::UBIGINT, {POOL_SEED}::UBIGINT)")} AS u FROM o),
d AS (SELECT * FROM h WHERE in_base ORDER BY u, occ LIMIT {POOL}),
i AS (SELECT * FROM (SELECT * FROM h WHERE NOT in_base ORDER BY u, occ LIMIT {2 * POOL}) WHERE base_cnt = 0 QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY u, occ) = 1 ORDER BY u, occ LIMIT {POOL}),
b AS (SELECT src, sum(base_cnt)::BIGINT AS degree FROM n GROUP BY src)
SELECT pool, src, dst, occ, base_cnt AS multiplicity, coalesce(degree, 0) AS degree FROM (SELECT 'delete' AS pool, * FROM d UNION ALL SELECT 'insert', * FROM i) LEFT JOIN b USING (src)""")
def ratio_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes of what is left of the initial graph after all batches, and inserts that it did not have."""
    store, batches, n = _batches(spark, sf_dir)
    first = store
    for _, batch in batches:
        store = store.apply(batch, n).after
    source = settled(store.view())
    left = first.view().withColumnRenamed("cnt", "c").join(source, ["src", "dst"]).select("src", "dst", F.least("c", "cnt").alias("cnt"))
    return analytics.ratio_pools(source, settled(left), POOL, POOL_SEED)


_WEAK = """both_ways AS MATERIALIZED (SELECT src, dst FROM g UNION SELECT dst, src FROM g),
wcc(v, c) USING KEY (v) AS (SELECT v, v AS c FROM verts UNION SELECT e.dst, min(w.c)::BIGINT FROM wcc w JOIN both_ways e ON e.src = w.v LEFT JOIN recurring.wcc r ON r.v = e.dst WHERE r.c > w.c GROUP BY e.dst)"""


@query(f"WITH RECURSIVE {_graph()}, {_WEAK} SELECT v, c AS component FROM wcc")
def weak_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(vertex_range(spark, vertex_count(spark, sf_dir)), settled(part_graph(spark, sf_dir)), small=LOCAL_PAIRS)


@query(ORACLE_SQL["weak_components"])
def weak_components_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connected_components(vertex_range(spark, vertex_count(spark, sf_dir)), settled(part_graph(spark, sf_dir)))


def _weak_after_sql() -> str:
    parts = [_WEAK.replace("both_ways", f"b{b}").replace("FROM g", f"FROM g{b + 1}").replace("wcc", f"w{b}") for b in range(BATCHES)]
    return f"WITH RECURSIVE {_evolving()}, {', '.join(parts)} {_each('SELECT v, c AS component FROM w{b}')}"


@query(_weak_after_sql())
def weak_components_after_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components repaired after each batch: those that lost an edge are joined again, those that new edges connect are merged."""
    store, batches, n = _batches(spark, sf_dir)
    labels, parts = settled(connected_components(vertex_range(spark, n), store.pairs(n), small=LOCAL_PAIRS)), []
    for b, batch in batches:
        step = store.apply(batch, n)
        labels = settled(repair_components(labels, step.after.pairs(n), step.lost(), step.gained(n), small=LOCAL_PAIRS, stay=step.mid.pairs(n)))
        parts.append((b, labels))
        store = step.after
    return _by_batch(parts)


@query(f"""WITH RECURSIVE {_graph()}, {_WEAK}, h AS (SELECT v, c, {_splitmix_sql("xor(v::UBIGINT, 1::UBIGINT)")} AS u FROM wcc)
SELECT c AS component, count(*) AS votes FROM (SELECT * FROM h ORDER BY u, v LIMIT 256) GROUP BY c ORDER BY votes DESC, component LIMIT 1""")
def majority_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.majority_component(weak_components(spark, sf_dir))


# strong components by reached sets, as bit strings with a bit a vertex; then the components' graph and its levels
_STRONG = f"""{_graph()}, own AS MATERIALIZED (SELECT v, set_bit(repeat('0', (SELECT count(*) FROM verts)::INT)::BIT, v::INT, 1) AS m FROM verts),
rs(v, m) USING KEY (v) AS (SELECT v, m FROM own UNION
  SELECT e.src, bit_or(x.m | o.m) FROM rs x JOIN g e ON e.dst = x.v LEFT JOIN recurring.rs o ON o.v = e.src WHERE (x.m | o.m) <> o.m GROUP BY e.src),
rm AS MATERIALIZED (SELECT v, m FROM rs),
sc AS MATERIALIZED (SELECT a.v, min(b.v) AS c FROM rm a JOIN rm b ON get_bit(a.m, b.v::INT) = 1 AND get_bit(b.m, a.v::INT) = 1 GROUP BY a.v),
nodes AS MATERIALIZED (SELECT DISTINCT c AS v FROM sc),
dag AS MATERIALIZED (SELECT a.c AS src, b.c AS dst, sum(cnt)::BIGINT AS cnt FROM g JOIN sc a ON a.v = g.src JOIN sc b ON b.v = g.dst WHERE a.c <> b.c GROUP BY ALL),
lv(v, level) USING KEY (v) AS (SELECT v, 0::BIGINT FROM nodes UNION SELECT d.dst, max(l.level + 1)::BIGINT FROM lv l JOIN dag d ON d.src = l.v LEFT JOIN recurring.lv r ON r.v = d.dst WHERE r.level < l.level + 1 GROUP BY d.dst)"""


def _strong(spark: SparkSession, sf_dir: str, small: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole graph, and its vertices' strong components."""
    edges = settled(part_graph(spark, sf_dir))
    return edges, settled(regions.strong_components(vertex_range(spark, vertex_count(spark, sf_dir)), edges, small))


@query(f"WITH RECURSIVE {_STRONG} SELECT v, c AS component FROM sc")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strong(spark, sf_dir)[1]


@query(ORACLE_SQL["strong_components"])
def strong_components_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strong(spark, sf_dir, -1)[1]


@query(f"WITH RECURSIVE {_STRONG} SELECT v, level FROM lv")
def critical_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, components = _strong(spark, sf_dir)
    return regions.levels(components.select(F.col("component").alias("v")).distinct(), settled(regions.condensation(edges, components)))


@query(ORACLE_SQL["critical_levels"])
def critical_levels_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same levels by rounds."""
    edges, components = _strong(spark, sf_dir)
    return regions.levels(components.select(F.col("component").alias("v")).distinct(), settled(regions.condensation(edges, components)), -1)


@query(f"""WITH RECURSIVE {_STRONG}, work AS MATERIALIZED (SELECT v, vertices + coalesce(i, 0) + coalesce(o, 0) AS work, vertices, coalesce(i, 0) AS incoming, coalesce(o, 0) AS outgoing FROM (SELECT c AS v, count(*) AS vertices FROM sc GROUP BY c)
  LEFT JOIN (SELECT c AS v, sum(cnt) AS i FROM g JOIN sc ON sc.v = g.dst GROUP BY c) USING (v) LEFT JOIN (SELECT c AS v, sum(cnt) AS o FROM g JOIN sc ON sc.v = g.src GROUP BY c) USING (v)),
{_WEAK.replace("FROM g", "FROM dag").replace("FROM verts", "FROM nodes")},
placed AS MATERIALIZED (SELECT v, c AS weak, work, vertices, incoming, outgoing, least(floor((sum(work) OVER (PARTITION BY c ORDER BY level, v) - work) * 4 / sum(work) OVER (PARTITION BY c)), 3)::INT AS part FROM work JOIN lv USING (v) JOIN wcc USING (v)),
e AS MATERIALIZED (SELECT dag.src, dag.dst, a.weak, a.part AS p, b.part AS q FROM dag JOIN placed a ON a.v = dag.src JOIN placed b ON b.v = dag.dst),
path(v, path) USING KEY (v) AS (SELECT v, work::BIGINT FROM placed UNION SELECT e.dst, max(x.path + w.work)::BIGINT FROM path x JOIN e ON e.src = x.v AND e.p = e.q JOIN work w ON w.v = e.dst LEFT JOIN recurring.path r ON r.v = e.dst WHERE r.path < x.path + w.work GROUP BY e.dst)
SELECT placed.weak, placed.part, count(*) AS components, sum(vertices)::BIGINT AS vertices, sum(incoming)::BIGINT AS incoming, sum(outgoing)::BIGINT AS outgoing, sum(work)::BIGINT AS work, coalesce(any_value(n), 0)::BIGINT AS successor_cuts, max(path) AS path
FROM placed JOIN path USING (v) LEFT JOIN (SELECT weak, p AS part, count(*) AS n FROM e WHERE p < q GROUP BY 1, 2) k ON k.weak = placed.weak AND k.part = placed.part GROUP BY placed.weak, placed.part""")
def condensation_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each weak component of the whole graph's condensation in four parts by work."""
    edges, strong = _strong(spark, sf_dir)
    return regions.closed_parts(strong, edges)


def _acyclic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs but loops, led from the smaller to the larger part number: a graph without a cycle, so that levels and paths are long."""
    ends = part_graph(spark, sf_dir).where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "cnt")
    return settled(ends.groupBy("src", "dst").agg(F.sum("cnt").alias("cnt")))


_FORWARD = f"{_LINES}, g AS MATERIALIZED (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, count(*)::BIGINT AS cnt FROM lines WHERE src <> dst GROUP BY 1, 2), lv(v, level) USING KEY (v) AS (SELECT v, 0::BIGINT FROM verts UNION SELECT d.dst, max(l.level + 1)::BIGINT FROM lv l JOIN g d ON d.src = l.v LEFT JOIN recurring.lv r ON r.v = d.dst WHERE r.level < l.level + 1 GROUP BY d.dst)"


@query(f"WITH RECURSIVE {_FORWARD} SELECT v, level FROM lv")
def forward_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.levels(vertex_range(spark, vertex_count(spark, sf_dir)), _acyclic(spark, sf_dir))


@query(f"""WITH RECURSIVE {_FORWARD}, work AS MATERIALIZED (SELECT v, 1 + coalesce(i, 0) + coalesce(o, 0) AS work, 1 AS vertices, coalesce(i, 0) AS incoming, coalesce(o, 0) AS outgoing FROM verts
  LEFT JOIN (SELECT dst AS v, sum(cnt) AS i FROM g GROUP BY dst) USING (v) LEFT JOIN (SELECT src AS v, sum(cnt) AS o FROM g GROUP BY src) USING (v)),
{_WEAK},
placed AS MATERIALIZED (SELECT v, c AS weak, work, incoming, outgoing, least(floor((sum(work) OVER (PARTITION BY c ORDER BY level, v) - work) * 4 / sum(work) OVER (PARTITION BY c)), 3)::INT AS part FROM work JOIN lv USING (v) JOIN wcc USING (v)),
e AS MATERIALIZED (SELECT g.src, g.dst, a.weak, a.part AS p, b.part AS q FROM g JOIN placed a ON a.v = g.src JOIN placed b ON b.v = g.dst),
path(v, path) USING KEY (v) AS (SELECT v, work::BIGINT FROM placed UNION SELECT e.dst, max(x.path + w.work)::BIGINT FROM path x JOIN e ON e.src = x.v AND e.p = e.q JOIN work w ON w.v = e.dst LEFT JOIN recurring.path r ON r.v = e.dst WHERE r.path < x.path + w.work GROUP BY e.dst)
SELECT placed.weak, placed.part, count(*) AS components, count(*) AS vertices, sum(incoming)::BIGINT AS incoming, sum(outgoing)::BIGINT AS outgoing, sum(work)::BIGINT AS work, coalesce(any_value(n), 0)::BIGINT AS successor_cuts, max(path) AS path
FROM placed JOIN path USING (v) LEFT JOIN (SELECT weak, p AS part, count(*) AS n FROM e WHERE p < q GROUP BY 1, 2) k ON k.weak = placed.weak AND k.part = placed.part GROUP BY placed.weak, placed.part""")
def closed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each weak component of the acyclic graph in four parts by work."""
    edges = _acyclic(spark, sf_dir)
    strong = settled(regions.strong_components(vertex_range(spark, vertex_count(spark, sf_dir)), edges))
    return regions.closed_parts(strong, edges)


@query("""WITH c AS (SELECT o_orderpriority AS name, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::DOUBLE AS cpu_edges, count(*)::DOUBLE AS gpu_edges, count(DISTINCT o_custkey)::DOUBLE AS events, bool_or(o_totalprice > 0) AS eligible FROM orders GROUP BY 1),
t AS (SELECT name, greatest(cpu_edges / 100.0, gpu_edges / 1000.0) + events / 50.0 + 1.0 + 2.0 AS cost FROM c WHERE eligible) SELECT min_by(name, (cost, name)) AS chosen, min(cost) AS cost FROM t""")
def owner_cost_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = orders.groupBy(F.col("o_orderpriority").alias("name")).agg(
        F.sum((F.col("o_orderstatus") == "F").cast("double")).alias("cpu_edges"), F.count("*").cast("double").alias("gpu_edges"), F.count_distinct("o_custkey").cast("double").alias("events"), F.max(F.col("o_totalprice") > 0).alias("eligible"))
    rows = rows.select("*", F.lit(1.0).alias("dependency_ns"), F.lit(0.0).alias("topology_ns"), F.lit(2.0).alias("placement_ns"), F.lit(0.0).alias("migration_ns"))
    return analytics.choose_plan(analytics.plan_costs(rows, {"cpu": 100.0, "gpu": 1000.0, "events": 50.0}))


@query("SELECT l_returnflag AS kind, round(exp(avg(ln(l_extendedprice / l_quantity))), 4) AS geometric_mean, round(median(l_extendedprice / l_quantity), 4) AS median, round(avg(l_extendedprice / l_quantity), 4) AS mean FROM lineitem WHERE l_extendedprice / l_quantity > 0 GROUP BY 1")
def ratio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_returnflag").alias("kind"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"))
    out = analytics.geometric_mean(lines, "ratio", "kind")
    return out.select("kind", *[F.round(c, 4).alias(c) for c in ("geometric_mean", "median", "mean")])


@query("WITH " + _LINES + " SELECT src, dst, ((src + dst) % 128 + 1)::BIGINT AS weight FROM (SELECT DISTINCT src, dst FROM lines)")
def endpoint_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).select("src", "dst", endpoint_weight(F.col("src"), F.col("dst")).alias("weight"))


@query("SELECT p_partkey AS v, (p_partkey + 1)::BIGINT AS next FROM part WHERE p_partkey < (SELECT max(p_partkey) FROM part)")
def chain_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.chain(spark, vertex_count(spark, sf_dir)).select(F.col("src").alias("v"), F.col("dst").alias("next"))


@query("SELECT 250::BIGINT AS adds, 250::BIGINT AS deletes, 0::BIGINT AS missing_deletes, 500::BIGINT AS updates")
def update_stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, updates = generate.update_stream(part_graph(spark, sf_dir), 100, 5)
    return generate.verify_stream(settled(initial), settled(updates))


@query(f"WITH RECURSIVE {_graph()}, {_WEAK} SELECT c AS component, count(*) - 1 AS edges FROM wcc GROUP BY c HAVING count(*) > 1")
def forest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random spanning forest has an edge less than vertices in each component."""
    edges, n = settled(part_graph(spark, sf_dir)), vertex_count(spark, sf_dir)
    forest = generate.spanning_forest(edges.select("src", "dst"))
    component = connected_components(vertex_range(spark, n), edges, small=LOCAL_PAIRS)
    return forest.join(component.withColumnRenamed("v", "src"), "src").groupBy("component").agg(F.count("*").alias("edges"))


@query(f"WITH RECURSIVE {_graph()}, {_WEAK} SELECT batch_id, pieces FROM (SELECT unnest(range(-1, 3))::BIGINT AS batch_id), (SELECT count(*) AS pieces FROM (SELECT c FROM wcc GROUP BY c HAVING count(*) > 1))")
def connected_stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream on the graph's pairs, of which the forest's stay: the reached part stays in one piece."""
    n = vertex_count(spark, sf_dir)
    pairs = settled(topology.undirected(part_graph(spark, sf_dir)).where("src < dst").select("src", "dst"))
    initial, updates = generate.connected_stream(pairs, 50, 3, backbone="random")
    alone = n - pairs.select(F.col("src").alias("v")).union(pairs.select("dst")).distinct().count()
    return generate.connectivity(initial, settled(updates), n).select("batch_id", (F.col("components") - alone).alias("pieces"))


CORE_PERCENT, CORE_SWAPS = 60, 50


def _core_stream(spark: SparkSession, sf_dir: str, batches: int) -> generate.CoreStream:
    pairs = settled(topology.undirected(part_graph(spark, sf_dir)).where("src < dst").select("src", "dst"))
    return generate.core_stream(pairs, CORE_PERCENT, CORE_SWAPS, batches)


_CORE = f"""WITH RECURSIVE {_graph()}, {_WEAK}, up AS MATERIALIZED (SELECT src, dst FROM both_ways WHERE src < dst),
members AS MATERIALIZED (SELECT v, c, count(*) OVER (PARTITION BY c) AS size FROM wcc WHERE v IN (SELECT src FROM up UNION SELECT dst FROM up)),
near(v, hops) USING KEY (v) AS (SELECT v, 0::BIGINT FROM members WHERE v = c UNION
  SELECT e.dst, min(s.hops + 1)::BIGINT FROM near s JOIN both_ways e ON e.src = s.v LEFT JOIN recurring.near r ON r.v = e.dst WHERE r.v IS NULL OR r.hops > s.hops + 1 GROUP BY e.dst),
ranks AS MATERIALIZED (SELECT v, row_number() OVER (ORDER BY size DESC, c, hops, v) AS k, (v <> c)::INT AS tree FROM members JOIN near USING (v)),
closed AS (SELECT greatest(a.k, b.k) AS k, count(*) AS n FROM up JOIN ranks a ON a.v = src JOIN ranks b ON b.v = dst GROUP BY 1),
prefixes AS (SELECT k, sum(coalesce(n, 0)) OVER (ORDER BY k)::BIGINT AS edges, sum(tree) OVER (ORDER BY k)::BIGINT AS trees, (SELECT count(*) FROM up) * {CORE_PERCENT} // 100 AS base FROM ranks LEFT JOIN closed USING (k)),
core AS (SELECT k AS core_vertices, base AS base_edges, trees AS protected_edges, edges AS core_edges, least(base - trees, edges - base) AS capacity FROM prefixes WHERE least(base - trees, edges - base) >= 0 ORDER BY capacity DESC, k DESC LIMIT 1)"""


@query(f"{_CORE} SELECT * FROM core")
def core_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix of breadth-first ranks in which an update stream has the most room on both sides."""
    return _core_stream(spark, sf_dir, 0).core


@query(f"{_CORE} SELECT batch_id, core_vertices - protected_edges AS pieces, 2 * base_edges AS edges FROM core, (SELECT unnest(range(-1, 3))::BIGINT AS batch_id)")
def core_stream_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The core's components and the directed edges before the stream (-1) and after each batch of paired swaps."""
    n, made = vertex_count(spark, sf_dir), _core_stream(spark, sf_dir, 3)
    updates = settled(made.updates)
    outside = n - made.core.first().core_vertices
    sizes = made.initial.agg(F.sum("cnt").alias("start")).join(F.broadcast(updates.groupBy("batch_id").agg(F.sum(F.when(F.col("op") == "a", 1).otherwise(-1)).alias("change"))), how="cross")
    edges = sizes.select("batch_id", "start", F.sum("change").over(Window.orderBy("batch_id")).alias("change")).select("batch_id", (F.col("start") + F.col("change")).alias("edges"))  # a row a batch
    first = made.initial.agg(F.lit(-1).cast("long").alias("batch_id"), F.sum("cnt").alias("edges"))
    pieces = generate.connectivity(made.initial, updates, n).select("batch_id", (F.col("components") - outside).alias("pieces"))
    return pieces.join(first.unionByName(edges), "batch_id")


RMAT_SCALE = 12


@query(f"""WITH RECURSIVE u AS MATERIALIZED (SELECT id, level, ({_splitmix_sql("(id * 1000003 + 64 + level)::UBIGINT")} >> 11)::DOUBLE / 9007199254740992 AS u FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS id), range({RMAT_SCALE}) l(level)),
e AS (SELECT id, sum(CASE WHEN u >= 0.76 THEN 1 ELSE 0 END * (1 << ({RMAT_SCALE - 1} - level)::INT))::BIGINT AS src FROM u GROUP BY id),
d AS (SELECT src, count(*) AS degree FROM e GROUP BY src)
SELECT bucket, count(*) AS vertices FROM (SELECT CASE WHEN degree IS NULL THEN -1 ELSE floor(log2(degree)) END::INT AS bucket FROM range({1 << RMAT_SCALE}) v(v) LEFT JOIN d ON d.src = v.v) GROUP BY bucket""")
def rmat_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph with as many edges as there are orders."""
    edges = generate.rmat(spark, RMAT_SCALE, spark.read.parquet(f"{sf_dir}/orders.parquet").count()).groupBy("src", "dst").agg(F.count("*").alias("cnt"))
    return analytics.degree_histogram(analytics.degrees(edges, 1 << RMAT_SCALE))


@query(f"WITH {_LINES}, z AS (SELECT v, {_splitmix_sql('v::UBIGINT')} AS u FROM verts) SELECT v, CASE WHEN u >= 9223372036854775808 THEN (u::HUGEINT - 18446744073709551616)::BIGINT ELSE u::BIGINT END AS rank FROM z")
def splitmix_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertex_range(spark, vertex_count(spark, sf_dir)).select("v", splitmix64(F.col("v")).alias("rank"))


@query(f"WITH RECURSIVE {_graph()}, {_min_sql('s', 'g', 'bfs')} SELECT verts.v, coalesce(value::VARCHAR, 'INF') AS distance FROM verts LEFT JOIN s ON s.v = verts.v")
def exported_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, state, n = _solved(spark, sf_dir, BFS)
    return all_vertices(state, n).select("v", F.coalesce(F.col("value").cast("string"), F.lit("INF")).alias("distance"))
