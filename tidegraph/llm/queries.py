"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .audio import media_digests
from .decontaminate import containment_search
from .html import extract_pages
from .language import fit_language, identify
from .lines import keep_bitmaps, kept_text
from .mixing import mix_documents
from .neardup import near_duplicates
from .quality import fit_quality, quality_scores
from .runtime import remainder, stored, table
from .substring import remove_repeats
from .survivors import golden_records
from .toxicity import fit_toxicity, toxicity_scores
from .trie import prefix_nodes, turn_sequences, with_heads
from .urls import SUFFIXES, filter_urls, page_outcomes


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("row_key")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit_language(docs))
    return out.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = filter_urls(pages, page_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality_scores(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = golden_records(table(spark, sf_dir, "clients"))
    return out.withColumn("balance_cents", F.floor(F.lit(100) * F.col("balance") + F.lit(0.5)).cast("long")).drop("balance")


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = stored(turn_sequences(table(spark, sf_dir, "conversations")), "trie")
    c = F.col("conv_id")
    heads = F.crc32(c.cast("string").cast("binary")) % 9
    return prefix_nodes(with_heads(turns, c - c % 5, heads, 8))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = keep_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_media, op3_neardup, op4_language, op5_mixing, op6_urls, op7_substrings, op8_html, op9_quality, op10_decontamination, op11_survivors, op12_prefixes, op13_lines, pipeline)
}

_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP3 = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_FOLD)} AS words FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS joint FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * joint >= 85 * (x.n + y.n - joint)),
reach(root, v) AS (SELECT doc_id, doc_id FROM w UNION SELECT root, b FROM reach JOIN e ON v = a),
c AS (SELECT root, min(v) AS component_id FROM reach GROUP BY root)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w JOIN c ON c.root = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

_OP5 = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
t AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER o, 0)::DOUBLE AS clamped, sum(w) OVER f AS open_w, (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE FROM s) AS total
      FROM t WINDOW o AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT coalesce(min_by((total - clamped) / open_w, cap / w) FILTER (WHERE (total - clamped) / open_w <= cap / w), 1e300) AS level FROM r),
g AS (SELECT source, source_size, least(cap, level * w) AS target FROM r, l),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
x AS (SELECT d.*, k.source_size, k.target, k.whole, greatest(0.0, k.target - k.whole * k.source_size) AS more,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN more > 0 AND start + size / 2.0 <= more THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""

_OP6 = r"""
WITH u AS (SELECT page_id, url,
  translate(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT doc_id, min(CASE WHEN coalesce(quality, 1) <> 1 OR coalesce(toxic, 0) = 1 THEN 0 ELSE 1 END) AS good FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
o AS (SELECT host, good FROM u JOIN j ON j.doc_id = try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.html)?/?$', 1), '') AS BIGINT) WHERE host <> ''),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(good)::DOUBLE AS good, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({suffixes}) THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
  CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN ({suffixes}) THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix FROM o GROUP BY host),
m0 AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM h),
g1 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m0.m) AS m FROM h, m0 GROUP BY suffix),
k1 AS (SELECT {strength} AS k FROM g1),
p1 AS (SELECT suffix, (m * k + good) / (k + n) AS m FROM g1, k1),
g2 AS (SELECT domain, h.suffix, sum(n) AS n, sum(good) AS good, any_value(p1.m) AS m FROM h JOIN p1 ON p1.suffix = h.suffix GROUP BY domain, h.suffix),
k2 AS (SELECT {strength} AS k FROM g2),
p2 AS (SELECT domain, (m * k + good) / (k + n) AS m FROM g2, k2),
g3 AS (SELECT host, n, good, p2.m AS m FROM h JOIN p2 ON p2.domain = h.domain),
k3 AS (SELECT {strength} AS k FROM g3),
p3 AS (SELECT host, (m * k + good) AS a, ((1 - m) * k + n - good) AS b FROM g3, k3),
b AS (SELECT host, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM p3),
f AS (SELECT u.*, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u)
SELECT page_id, f.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN f.host <> '' AND coalesce(upper < (SELECT m FROM m0), false) THEN 'block' ELSE 'allow' END AS verdict
FROM f LEFT JOIN b ON b.host = f.host
"""
_RHO = "((sum(n * (good / n - m) * (good / n - m)) FILTER (WHERE n > 1) - sum(m * (1 - m)) FILTER (WHERE n > 1)) / nullif(sum((n - 1) * m * (1 - m)) FILTER (WHERE n > 1), 0))"
_ERROR = "(sqrt(2.0 * sum(m * (1 - m) * m * (1 - m)) FILTER (WHERE n > 1)) / nullif(sum((n - 1) * m * (1 - m)) FILTER (WHERE n > 1), 0))"
_STRENGTH = f"coalesce(greatest(1 / (CASE WHEN {_RHO} > 0 THEN {_RHO} ELSE 0.0 END + {_ERROR}) - 1, 2.0), 100.0)"

_OP7 = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
e AS MATERIALIZED (SELECT doc_id, i, hash(array_to_string(words[i:i + 34], ' ')) AS h1, md5(array_to_string(words[i:i + 34], ' ')) AS h2
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)),
r AS (SELECT h2 FROM e GROUP BY h2 HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS place FROM e JOIN r USING (h2)),
l AS (SELECT doc_id, list(place) AS gone, count(*) AS n FROM g GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN l.n IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(l.gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN l ON l.doc_id = w.doc_id
"""

_OP10 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_FOLD)} AS words FROM documents),
b AS MATERIALIZED (SELECT item_id, {_WORDS.format(_FOLD)} AS words FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT DISTINCT item_id, least(len(words), 5) AS k, array_to_string(words[i:i + 4], ' ') AS s FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM b WHERE len(words) > 0)),
ks AS (SELECT DISTINCT k FROM bs),
ds AS (SELECT DISTINCT doc_id, k, array_to_string(words[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM d, ks WHERE len(words) >= k)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id),
h AS (SELECT doc_id, item_id, count(*) AS n_shared FROM bs JOIN ds USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment FROM h JOIN n USING (item_id) WHERE 5 * n_shared >= 4 * n_item
"""

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_RECENT = "updated_at DESC NULLS LAST, trust DESC, client_id ASC NULLS LAST"


def _first(value: str, order: str, out: str, when: str = "true") -> str:
    """The value that comes first in an order, and its client_id; larger values break ties."""
    return ", ".join(f"first({x} ORDER BY {order}, {value} DESC) FILTER (WHERE {when}) AS {name}" for x, name in ((value, out), ("client_id", f"{out}_from")))


_OP11 = f"""
WITH s AS (SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, CASE trim(source, {_BLANK}) WHEN '' THEN 0 ELSE CASE source WHEN 'crm' THEN 4 WHEN 'web' THEN 3 WHEN 'store' THEN 2 WHEN 'partner' THEN 1 ELSE 0 END END AS trust,
  {', '.join(f"CASE WHEN trim({c}, {_BLANK}) <> '' THEN {c} END AS {c}" for c in ('name', 'email', 'city', 'segment'))}, nation_id, CASE WHEN isfinite(balance) THEN balance END AS balance FROM clients),
l AS MATERIALIZED (SELECT *, coalesce(updated_at >= max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 1440 HOURS, false) AS fresh, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled FROM s),
b AS (SELECT cluster_id, count(*) AS n_records, count(*) FILTER (WHERE NOT fresh) AS n_stale,
  {_first("name", f"length(name) DESC, fresh DESC, trust DESC, {_RECENT}", "name", "name IS NOT NULL")},
  {_first("email", f"fresh DESC, trust DESC, {_RECENT}", "email", "email IS NOT NULL")},
  {_first("segment", _RECENT, "segment", "segment IS NOT NULL")},
  {_first("{'city': city, 'nation_id': nation_id}", f"filled DESC, {_RECENT}", "address")} FROM l GROUP BY cluster_id),
m AS (SELECT l.cluster_id, {_first("balance", f"(l.segment IS NOT DISTINCT FROM b.segment) DESC, {_RECENT}", "balance", "balance IS NOT NULL")} FROM l JOIN b ON l.cluster_id IS NOT DISTINCT FROM b.cluster_id GROUP BY l.cluster_id)
SELECT b.cluster_id, n_records, n_stale, name, email, segment, address.city AS city, address.nation_id AS nation_id, floor(100 * balance + 0.5)::BIGINT AS balance_cents, name_from, email_from, segment_from, balance_from,
  CASE WHEN address.city IS NOT NULL OR address.nation_id IS NOT NULL THEN address_from END AS address_from
FROM b JOIN m ON m.cluster_id IS NOT DISTINCT FROM b.cluster_id
"""

# the CRC of a decimal number's digits, bit by bit
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_OP12 = f"""
WITH t AS (SELECT conv_id, list({{'k': k, 's': s}} ORDER BY turn NULLS FIRST, k) AS turns FROM (
  SELECT conv_id, turn, left(sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS k, octet_length(encode(coalesce(text, ''))) AS s FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, turns, ({_CRC} % 9)::INT AS h FROM t),
r AS MATERIALIZED (SELECT h.conv_id, coalesce(d.turns[:h], []) || h.turns[h + 1:] AS turns FROM h LEFT JOIN t d ON d.conv_id = h.conv_id - h.conv_id % 5),
p AS MATERIALIZED (SELECT conv_id, d, sha256(array_to_string(list_transform(turns[:d], lambda x: x.k), '')) AS node, sha256(array_to_string(list_transform(turns[:d - 1], lambda x: x.k), '')) AS parent, CASE WHEN d = 0 THEN 0 ELSE turns[d].s END AS s, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(s) AS s, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ends FROM p GROUP BY node, d),
k AS (SELECT parent, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN k ON k.parent = n.node AND k.d = n.d),
a AS (SELECT p.node, p.d, sum(CASE WHEN w.kids = 0 THEN 1 ELSE 0 END)::BIGINT AS leaves, sum((w.n - 1) * w.s)::BIGINT AS saved FROM w JOIN p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.node, p.d)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n AS n_convs, w.kids AS n_children, a.leaves AS n_leaves, a.saved AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
FROM w JOIN a ON a.node = w.node AND a.d = w.d LEFT JOIN n u ON u.node = w.parent AND u.d = w.d - 1 AND w.d > 0
"""

_OP13 = f"""
WITH s AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM s)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id < last) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT coalesce(doc_id < last, false)), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY r
"""

ORACLE_SQL: dict[str, str] = {
    "op3_neardup": _OP3,
    "op5_mixing": _OP5,
    "op6_urls": _OP6.replace("{strength}", _STRENGTH).replace("{suffixes}", ", ".join(f"'{x}'" for x in SUFFIXES)),
    "op7_substrings": _OP7,
    "op10_decontamination": _OP10,
    "op11_survivors": _OP11,
    "op12_prefixes": _OP12,
    "op13_lines": _OP13,
}
