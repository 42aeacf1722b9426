"""Lines that many documents share: found by ranges of their hashes, dropped by keep bitmaps of one row a document.

Only DataFrame functions run here.  A line's *key* is the line without ``[\\x20\\x09-\\x0D]`` at
both ends and with A-Z in lower case; keys are told apart by 128 bits of their SHA-256.

Lines are dealt out by ranges of their hashes and sorted there by key, then by document from the largest
id down, then by position; a ranking that streams over this order finds each key's first document and whether there
are enough.  Keys that hold over 1/1024 of all lines (at most 1023) would make a range too heavy: they
are aggregated before they are shuffled, and what is known of them is broadcast to their lines.

What is dropped goes back to its document as a compressed bitmap: the runs of lines that stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import fresh, stored

#: What is stripped from the ends of a line: fixed values.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key with more than one of so many lines is aggregated before the shuffle.
SHARE = 1024
BINS = 1 << 16


def split_lines(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def heavy_keys(lines: DataFrame) -> DataFrame:
    """(key): those of over 1/SHARE of the rows, so fewer than SHARE.

    Rows are counted in bins of keys first, as bins are few; then by key, in the bins that are full enough.
    """
    total = lines.count()
    full = F.col("n") * SHARE > total
    bins = lines.groupBy(F.pmod(F.xxhash64("key"), F.lit(BINS)).alias("bin")).agg(F.count("*").alias("n")).where(full).select("bin")
    some = lines.withColumn("bin", F.pmod(F.xxhash64("key"), F.lit(BINS))).join(F.broadcast(bins), "bin", "left_semi")
    return some.groupBy("key").agg(F.count("*").alias("n")).where(full).select("key")


def repeated_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """The rows (key, doc, row, pos) whose key is in ``least_docs`` documents or more, without those of the key's largest document.

    ``doc`` is a struct, so that a missing id is an id like others, and the smallest.
    """
    heavy = stored(heavy_keys(lines), "lines")
    light = lines.join(F.broadcast(heavy), "key", "left_anti").repartitionByRange("key")
    by_key = Window.partitionBy("key")
    ranked = light.withColumn("_nth", F.dense_rank().over(by_key.orderBy(F.col("doc").desc())))
    ranked = ranked.withColumn("_docs", F.max("_nth").over(by_key)).where((F.col("_nth") > 1) & (F.col("_docs") >= least_docs))
    some = lines.join(F.broadcast(heavy), "key", "left_semi")
    known = some.select("key", "doc").distinct().groupBy("key").agg(F.count("*").alias("_docs"), F.max("doc").alias("_last"))
    known = known.where(F.col("_docs") >= least_docs)  # one row a heavy key
    again = lines.join(F.broadcast(known), "key").where(F.col("doc") != F.col("_last"))
    return ranked.select("doc", "row", "pos").unionByName(again.select("doc", "row", "pos"))


def kept_runs(gone: Column, n: Column) -> Column:
    """The bitmap of n lines without the sorted positions ``gone``, as runs (start, count) of those that stay."""
    starts = F.concat(F.array(F.lit(-1)), gone)
    ends = F.concat(gone, F.array(n))
    runs = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.struct((x["a"] + 1).alias("start"), (x["b"] - x["a"] - 1).alias("count")))
    return F.filter(runs, lambda x: x["count"] > 0)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of the bitmap's runs, joined by \\n."""
    lines = split_lines(text)
    return F.array_join(F.flatten(F.transform(keep, lambda run: F.slice(lines, run["start"] + 1, run["count"]))), "\n")


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` (doc_id, text and any others) with ``n_lines``, ``n_dropped`` and ``keep``: the runs (start, count) of lines that stay.

    Keys of ``least_chars`` code points or more that ``least_docs`` documents or more hold lose all their lines but those
    in the largest doc_id.  A null text is one empty line.  Rows of one doc_id are one document when
    documents are counted, also rows without an id, whose id is below all others; each row has its own bitmap.
    An empty table gives no rows.  A name that ``docs`` has already gets an underscore.
    """
    n_lines, n_dropped, keep, row, own, places = fresh(docs.columns, "n_lines", "n_dropped", "keep", "_row", "_doc", "_gone")
    every = docs.withColumns({own: F.struct(F.col("doc_id").alias("id")), row: F.xxhash64(F.col("text"))})
    parts = every.select(F.col(own).alias("doc"), F.col(row).alias("row"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = parts.select("doc", "row", "pos", line_key(F.col("line")).alias("k")).where(F.length("k") >= least_chars)
    # a row that the table has twice counts once: both get the same bitmap
    lines = stored(keyed.select(F.substring(F.unhex(F.sha2("k", 256)), 1, 16).alias("key"), "doc", "row", "pos"), "lines")
    gone = repeated_lines(lines, least_docs).groupBy(F.col("doc").alias(own), F.col("row").alias(row)).agg(F.sort_array(F.collect_set("pos")).alias(places))
    out = every.join(gone, [own, row], "left").withColumn(n_lines, F.size(split_lines(F.col("text"))).cast("long"))
    out = out.withColumn(places, F.coalesce(places, F.array().cast("array<int>")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], n_lines, F.size(places).cast("long").alias(n_dropped), kept_runs(F.col(places), F.col(n_lines).cast("int")).alias(keep))


def deduplicate_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` with their texts cut to the lines that stay; null texts become empty.  See ``keep_bitmaps``."""
    out = keep_bitmaps(docs, least_chars, least_docs)
    keep = out.columns[-1]
    return out.select(*[kept_text(F.col("text"), F.col(keep)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
