"""Prefix tries of conversations: which openings they share, and what a cache of them would save.

Conversations are told apart by their sequences of turn digests; copies become one sequence with a count before anything
is grouped.  Sequences are dealt out by hash partitions of their first turn, and each partition builds its tries of
dictionaries inside ``applyInPandas``, children after parents, and folds them from the last node to the first.  First-turn
subtries of more than ``limit`` turns are not built in one task: all that their sequences share becomes
a chain of nodes outside of the tries, and what follows is dealt out anew by the next turn, until no subtrie is too large.  So a task
holds about ``limit`` turns, plus one conversation.

A conversation's own turns (36 bytes each) are held by one task, as a document's text is elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .runtime import prepare, stored

#: Turns of a subtrie that one task builds.
LIMIT = 200_000
#: Parts into which the sequences below one large node are dealt for a join.
SALTS = 64
DIGITS = 32

NODES = T.StructType([T.StructField(n, T.StringType()) for n in ("node", "seq_id")] + [T.StructField(n, T.LongType()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")])


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of the SHA-256 of both, in hex; the role's length comes first, so that no two turns read alike."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, DIGITS)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (key, size) in the order of ``turn``; ``size`` is the text's UTF-8 bytes.

    A missing turn number comes first, equal ones are ordered by key; a null role or text is empty.  Rows
    without a conv_id are left out.  Other columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", turn_digest(role, text).alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("turns"))


def with_heads(sequences: DataFrame, donor: Column, n: Column, most: int) -> DataFrame:
    """Sequences whose first ``n`` (at most ``most``) turns are those of the conversation ``donor``: all if it has fewer, none if there is no such conversation."""
    heads = sequences.select(F.col("conv_id").alias("_donor"), F.slice("turns", 1, most).alias("_head"))
    own = sequences.select("conv_id", "turns", donor.alias("_donor"), n.cast("int").alias("_n"))
    head = F.coalesce(F.slice("_head", 1, F.col("_n")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("_n") + 1, F.size("turns"))
    return own.join(heads, "_donor", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _folded(pdf: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of one hash partition."""
    tops: dict = {}
    kids, parent, depth, conv, members, size, end, node, up = [], [], [], [], [], [], [], [], []
    columns = [pdf[c].tolist() for c in ("keys", "sizes", "n", "conv_id", "seq_id", "at", "node", "up")]
    for keys, sizes, n, c, seq, at, above, above_conv in zip(*columns):
        here, table, key = -1, tops, (above, keys[at])
        for i in range(at, len(keys)):
            to = table.get(key)
            if to is None:
                to = table[key] = len(parent)
                kids.append({}), parent.append(here), depth.append(i + 1), conv.append(c), members.append(0), size.append(int(sizes[i])), end.append(None)
                node.append(above if here < 0 else None), up.append(above_conv)
            members[to] += n
            if c < conv[to]:
                conv[to] = c
            here, table, key = to, kids[to], keys[i + 1] if i + 1 < len(keys) else None
        end[here] = seq
    leaves, saved = [0] * len(parent), [0] * len(parent)
    for i in range(len(parent) - 1, -1, -1):  # a node is made after its parent
        leaves[i] = leaves[i] or 1
        saved[i] += (members[i] - 1) * size[i]
        if parent[i] >= 0:
            leaves[parent[i]] += leaves[i]
            saved[parent[i]] += saved[i]
    above = [conv[p] if p >= 0 else u for p, u in zip(parent, up)]
    return pd.DataFrame({"node": node, "seq_id": end, "conv_id": conv, "depth": depth, "parent_conv_id": above, "n_convs": members, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved}, columns=NODES.names)


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (seq_id, conv_id) as rows of many ids: (seq_id, first, ids)."""
    for b in batches:
        ids = b["conv_id"].astype(str)
        by = b.assign(ids=ids).groupby("seq_id", sort=False)
        yield pd.DataFrame({"seq_id": by["seq_id"].first().to_numpy(), "first": by["conv_id"].first().to_numpy(), "ids": by["ids"].agg(",".join).to_numpy()})


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each sequence's ids, whose chunks come one after another."""
    now, state = None, None
    for b in batches:
        done = []
        for seq, ids in zip(b["seq_id"], b["ids"]):
            if seq == now:
                state.update(b",")
            else:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = seq, hashlib.sha256()
            state.update(ids.encode())
        yield pd.DataFrame(done, columns=["seq_id", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["seq_id", "ends_sha256"])


def ends_digests(members: DataFrame) -> DataFrame:
    """(seq_id, ends_sha256) of rows (seq_id, conv_id): ids ascending, joined by commas.

    Ids are joined in chunks by ranges, so that the task which hashes a large group reads few rows, one batch at a time.
    """
    prepare(members.sparkSession)
    ranged = members.select("seq_id", "conv_id").repartitionByRange("seq_id", "conv_id").sortWithinPartitions("seq_id", "conv_id")
    chunks = ranged.mapInPandas(_chunks, "seq_id string, first long, ids string")
    return chunks.repartition("seq_id").sortWithinPartitions("seq_id", "first").mapInPandas(_hashed, "seq_id string, ends_sha256 string")


def _split(active: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """One round: (sequences below small subtries, those below large ones, the large ones' shared chains)."""
    rest = active.where(F.size("keys") > F.col("at")).withColumn("next", F.get("keys", F.col("at")))
    groups = rest.groupBy("node", "next", "at", "up").agg(
        F.sum(F.size("keys") - F.col("at")).alias("weight"), F.sum("n").alias("members"), F.min("conv_id").alias("conv"), F.min(F.struct("keys", "sizes")).alias("low"), F.max("keys").alias("high"))
    # what the least and the greatest sequence share, all share
    differ = F.array_position(F.zip_with("low.keys", "high", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(differ > 0, differ - 1).otherwise(F.size("low.keys")).cast("int")
    chains = stored(
        groups.where(F.col("weight") > limit).withColumn("hi", shared)
        .select("node", "next", F.substring(F.sha2(F.concat("node", "next"), 256), 1, DIGITS).alias("id"), (F.col("at") + 1).alias("lo"), "hi", "conv", "members", F.col("up").alias("above"), F.slice("low.sizes", F.col("at") + 1, F.col("hi") - F.col("at")).alias("sizes")), "trie")
    if chains.isEmpty():
        return rest, None, None
    salted = chains.select("node", "next", "id", "hi", "conv", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    marked = stored(rest.withColumn("salt", F.pmod(F.xxhash64("seq_id"), F.lit(SALTS)).cast("int")).join(salted, ["node", "next", "salt"], "left"), "trie")
    light = marked.where("id is null").select(rest.columns)
    large = marked.where("id is not null").select("seq_id", "keys", "sizes", "n", "conv_id", F.col("hi").alias("at"), F.col("id").alias("node"), F.col("conv").alias("up"))
    return light, large, chains.withColumnRenamed("node", "parent").withColumnRenamed("id", "node").drop("next")


def prefix_nodes(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The trie of rows (conv_id, turns: array of (key, size)), one row a conv_id: a row a node.

    A node is a distinct sequence of first turns, from the root of depth 0, which has none; its members are the conversations that start
    with it.  conv_id is the smallest member, parent_conv_id the parent's (null for the root); n_convs members; n_children; n_leaves,
    the nodes without children in its subtree, itself included; saved_tokens, over its subtree, the sum of (n_convs - 1) times the size of a
    node's last turn; ends_sha256, the hex SHA-256 of the conv_ids that end at the node, ascending and joined by commas.
    No sequence gives no row; sequences without a turn end at the root.
    """
    named = stored(sequences.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes")).withColumn("seq_id", F.substring(F.sha2(F.array_join("keys", ""), 256), 1, DIGITS)), "trie")
    distinct = stored(named.groupBy("seq_id").agg(F.first("keys").alias("keys"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "trie")
    root = distinct.agg(F.min("conv_id").alias("conv"), F.sum("n").alias("members"), F.coalesce(F.sum(F.size("keys")), F.lit(0)).alias("turns")).where("members > 0")
    size = root.first()
    if size is None:
        return root.sparkSession.createDataFrame([], T.StructType([*NODES.fields[2:], T.StructField("ends_sha256", T.StringType())]))
    none = F.lit(None).cast("string")
    levels = [root.select(F.lit("").alias("node"), none.alias("parent"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), "conv", "members", F.lit(None).cast("long").alias("above"), F.array(F.lit(0).cast("long")).alias("sizes"))]
    active, units, ended = distinct.withColumns({"at": F.lit(0), "node": F.lit(""), "up": F.lit(size["conv"]).cast("long")}), [], []
    while active is not None:
        ended.append(active.where(F.size("keys") == F.col("at")).select("node", F.col("seq_id").alias("end")))
        light, active, chains = _split(active, limit)
        units.append(light)
        if chains is not None:
            levels.append(chains)
    parts = max(1, -(-size["turns"] // limit))
    below = _union(units).withColumn("bucket", F.pmod(F.xxhash64("node", "next"), F.lit(parts)))
    nodes = stored(below.groupBy("bucket").applyInPandas(lambda pdf: _folded(pdf), NODES), "trie")
    tops = nodes.where("node is not null").select(F.col("node").alias("parent"), "n_leaves", "saved_tokens")
    upper, deeper, ends = [], None, _union(ended)
    for level in reversed(levels):
        kids = tops if deeper is None else tops.unionByName(deeper)
        sums = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"))
        own = level.join(sums, "node", "left").join(ends, "node", "left").select("*", F.posexplode("sizes").alias("i", "size"))
        upward = Window.partitionBy("node").orderBy(F.col("i").desc())
        last = F.col("lo") + F.col("i") == F.col("hi")
        own = stored(own.select(
            "node", "parent", "i", F.when(last, F.col("end")).alias("seq_id"), F.col("conv").alias("conv_id"), (F.col("lo") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") == 0, F.col("above")).otherwise(F.col("conv")).alias("parent_conv_id"),
            F.col("members").alias("n_convs"), F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + F.sum((F.col("members") - 1) * F.col("size")).over(upward)).alias("saved_tokens")), "trie")
        deeper = own.where("i = 0 and parent is not null").select("parent", "n_leaves", "saved_tokens")
        upper.append(own.select([c for c in NODES.names]))
    every = _union([nodes, *upper]).drop("node")
    digests = ends_digests(named)
    with_ends = every.where("seq_id is not null").join(digests, "seq_id").drop("seq_id")
    return with_ends.unionByName(every.where("seq_id is null").drop("seq_id").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
