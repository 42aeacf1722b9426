"""Line dedup, golden records and conversation tries against plain Python, with odd rows."""

import datetime as dt
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import lines, queries, survivors, trie

SPACE = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- lines ----------------------------------------------------------------------------------


def kept_lines(docs, least=20, docs_least=3):
    """[(doc_id, n_lines, n_dropped, kept text)] of [(doc_id, text)]."""
    key = lambda line: line.strip(SPACE).translate(FOLD)
    holders = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(d)
    low = lambda d: float("-inf") if d is None else d
    out = []
    for d, text in docs:
        every = (text or "").split("\n")
        stay = [x for x in every if not (len(key(x)) >= least and len(holders[key(x)]) >= docs_least and low(d) < max(map(low, holders[key(x)])))]
        out.append((d, len(every), len(every) - len(stay), "\n".join(stay)))
    return out


def line_docs():
    r = random.Random(3)
    common = ["The Same LINE of twenty and more", "  another line, Ünder twenty signs?\t", "exactly twenty chars", "nineteen characters", "İ" * 20, "\x0b a line with odd blanks at its ends \x0c"]
    docs = [(i, "\n".join(r.choice([r.choice(common), r.choice(common).upper(), f"own line {r.random()}", ""]) for _ in range(r.randrange(0, 12)))) for i in range(40)]
    hot = "one line that most of all documents hold"
    docs += [(100 + i, f"{hot}\n{hot.upper()} \nend {i}") for i in range(60)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, hot + "\r\n" + hot), (None, hot + "\nno id"), (None, None), (204, "x" * 300_000 + "\n" + hot + "\n" + "y\n" * 50_000)]
    docs += [(300, f"same id {hot}\n" * 2), (300, f"same id {hot}\n" * 2), (301, f"same id {hot}"), (301, f"other text\nsame id {hot}"), (302, f"same id {hot}")]
    return docs


def test_keep_bitmaps(spark):
    docs = line_docs()
    frame = spark.createDataFrame([(*x, "k", 7) for x in docs], "doc_id long, text string, keep string, n_lines int").repartition(5)
    out = lines.keep_bitmaps(frame)
    assert out.columns == ["doc_id", "text", "keep", "n_lines", "n_lines_", "n_dropped", "keep_"]
    got = out.select("doc_id", "n_lines_", "n_dropped", lines.kept_text(F.col("text"), F.col("keep_"))).collect()
    order = lambda rows: sorted((tuple(x) for x in rows), key=repr)
    assert order(got) == order(kept_lines(docs))
    runs = {r.doc_id: [tuple(x) for x in r.keep_] for r in out.where("doc_id in (100, 159, 202, 204)").collect()}
    assert runs[100] == [(2, 1)] and runs[202] == [(0, 3)] and runs[159] == [(2, 1)] and runs[204] == [(0, 50_003)]
    texts = lines.deduplicate_lines(frame)
    assert texts.columns == frame.columns and order(texts.select("doc_id", "text").collect()) == order((x[0], x[3]) for x in kept_lines(docs))
    assert lines.keep_bitmaps(frame.limit(0)).count() == 0


def test_lines_without_heavy_keys(spark, monkeypatch):
    """The ranges alone give what the aggregated keys give."""
    monkeypatch.setattr(lines, "heavy_keys", lambda rows: rows.select("key").limit(0))
    docs = line_docs()
    out = lines.deduplicate_lines(spark.createDataFrame(docs, "doc_id long, text string"), 15, 2)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr((x[0], x[3])) for x in kept_lines(docs, 15, 2))


def test_ranges_are_not_shuffled_twice(spark):
    rows = spark.range(100).select(F.col("id").cast("string").cast("binary").alias("key"), F.struct("id").alias("doc"), F.lit(1).alias("row"), F.lit(0).alias("pos"))
    plan = lines.repeated_lines(rows, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "Python" not in plan and "Arrow" not in plan
    assert plan.split("rangepartitioning")[0].count("hashpartitioning") == 0  # no exchange above the ranges in their branch


# -- records ---------------------------------------------------------------------------------

CLIENT = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"


def records():
    r = random.Random(5)
    day = dt.datetime(2024, 5, 1)
    rows = []
    for i in range(400):
        at = r.choice([None, day - dt.timedelta(days=r.randrange(0, 130)), day - dt.timedelta(days=60), day - dt.timedelta(days=60, microseconds=1)])
        master = r.choice([None, 1, 1, 1, r.randrange(0, 60)])
        text = lambda *x: r.choice([None, "", " \t", *x])
        rows.append((i, master, text("crm", "web", "store", "partner", "fax"), at, text("Al", "Bo", "Çé", " Bo"), text("a@x", "b@x"), text("Rome", "Oslo"), r.choice([None, 1, 2]), text("retail", "public"), r.choice([None, 1.005, -2.5, 0.125, float("nan"), r.random() * 100])))
    rows += [(1000, None, "crm", day, "One", None, None, None, None, 5.0)] * 3 + [(None, None, "web", None, "No id", "n@x", None, 3, None, None), (None, None, None, None, None, None, None, None, None, None), (2000, None, None, None, None, None, None, None, None, float("inf"))]
    return rows


def golden(rows):
    """The same by sorting each cluster's list."""
    blank = lambda x: x if x is not None and x.strip(SPACE) else None
    clusters = defaultdict(list)
    for c, m, s, at, name, email, city, nation, segment, balance in rows:
        t = {"crm": 4, "web": 3, "store": 2, "partner": 1}.get(s, 0)
        clusters[c if m is None else m].append(dict(id=c, at=at, trust=t, name=blank(name), email=blank(email), city=blank(city), nation=nation, segment=blank(segment), balance=None if balance is None or balance != balance or abs(balance) == float("inf") else balance))
    out = {}
    for key, own in clusters.items():
        latest = max((x["at"] for x in own if x["at"]), default=None)
        for x in own:
            x["fresh"] = x["at"] is not None and x["at"] >= latest - dt.timedelta(days=60)
            x["recent"] = (x["at"] or dt.datetime.min, x["trust"], -(x["id"] if x["id"] is not None else 10**9))
            x["trusted"] = (x["fresh"], x["trust"], x["recent"])

        def first(field, order):
            some = [x for x in own if x[field] is not None]
            best = max(some, key=lambda x: (order(x), x[field]), default=None)
            return (best[field], best["id"]) if best else (None, None)

        name, email, segment = first("name", lambda x: (len(x["name"]), x["trusted"])), first("email", lambda x: x["trusted"]), first("segment", lambda x: x["recent"])
        balance = first("balance", lambda x: (x["segment"] == segment[0], x["recent"]))
        place = max(own, key=lambda x: ((x["city"] is not None) + (x["nation"] is not None), x["recent"], x["city"] or "", x["nation"] or -1))
        at = (place["city"], place["nation"])
        out[key] = (len(own), sum(not x["fresh"] for x in own), name[0], email[0], segment[0], *at, balance[0], name[1], email[1], segment[1], balance[1], place["id"] if at != (None, None) else None)
    return out


@pytest.mark.parametrize("share", [1024, 3, 0])
def test_golden_records(spark, monkeypatch, share):
    """With all clusters broadcast, with the largest only, and with none."""
    monkeypatch.setattr(survivors, "SHARE", share)
    rows = records()
    frame = spark.createDataFrame([(*x, "clash", 1) for x in rows], CLIENT + ", latest string, n_records int").repartition(4)
    got = {r.cluster_id: tuple(r)[1:] for r in survivors.golden_records(frame).collect()}
    assert got == golden(rows)
    assert survivors.golden_records(frame.limit(0)).count() == 0


# -- tries -----------------------------------------------------------------------------------


def nodes_of(sequences):
    """The contract's rows from {conv_id: [(role, text)]}, by looking at every prefix."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(sequences[c]) == len(p))))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            turns[c].append((t is not None, t or 0, digest, (role, text)))
    own = {c: [x[3] for x in sorted(t)] for c, t in turns.items()}
    head = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: own.get(c - c % 5, [])[:head(c)] + t[head(c):] for c, t in own.items()}


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in range(150):
        if c % 25 != 5:
            rows += [(c, t, r.choice(["user", "bot"]), r.choice(["a", "ü", "bb", "ccc"])) for t in range(r.randrange(1, 12))]
    long = [("user", f"turn {t}") for t in range(60)]
    rows += [(c, t, *x) for c in (500, 505, 510, 515) for t, x in enumerate(long[: 60 - c % 7] + [("user", str(c % 10))])]
    rows += [(c, t, "user", "the same") for c in range(700, 760) for t in range(3)]
    rows += [(900, None, None, None), (900, None, "user", "first"), (900, 1, "user", None), (900, 1, "user", None), (901, 3, "", ""), (None, 0, "user", "no id"), (902, 0, "a:b", "c"), (903, 0, "a", ":bc"), (904, 0, "user", "z" * 200_000)]
    return rows


@pytest.mark.parametrize("limit", [200_000, 40, 3])
def test_prefix_nodes(spark, tmp_path, limit, monkeypatch):
    """Whole, with the hot subtries split, and with nearly all split."""
    monkeypatch.setattr(queries, "prefix_nodes", lambda s: trie.prefix_nodes(s, limit))
    rows = conversations(1)
    spark.createDataFrame([(*x, "clash") for x in rows], "conv_id long, turn long, role string, text string, turns string").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_prefixes(spark, str(tmp_path)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == nodes_of(rebuilt(rows))


def test_prefix_nodes_without_turns(spark):
    schema = "conv_id long, turns array<struct<key: string, size: long>>"
    assert trie.prefix_nodes(spark.createDataFrame([], schema)).count() == 0
    row = trie.prefix_nodes(spark.createDataFrame([(3, []), (12, [])], schema)).first()
    assert (row.conv_id, row.depth, row.parent_conv_id, row.n_convs, row.n_children, row.n_leaves, row.saved_tokens) == (3, 0, None, 2, 0, 1, 0)
    assert row.ends_sha256 == hashlib.sha256(b"3,12").hexdigest()


def test_ends_over_many_batches(spark):
    """One sequence of more ids than a batch and a partition hold."""
    rows = spark.range(0, 30_000, 3).select(F.lit("hot").alias("seq_id"), F.col("id").alias("conv_id")).union(spark.range(5).select(F.col("id").cast("string"), "id"))
    got = {r.seq_id: r.ends_sha256 for r in trie.ends_digests(rows.repartition(7)).collect()}
    assert got["hot"] == hashlib.sha256(",".join(map(str, range(0, 30_000, 3))).encode()).hexdigest()
    assert got["4"] == hashlib.sha256(b"4").hexdigest() and len(got) == 6
