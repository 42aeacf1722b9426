"""Main text of web pages: nearest-URL page differencing, checked by the pages' own marks.

A page is parsed into text blocks; what stands in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or reader comments is dropped.  Every page is paired with the page of the
nearest URL path on the same host, both pages' lines are aligned by longest common subsequence, and the shared lines are
deleted.  Where a page marks its article (``article``, ``main``, or the matching roles), an exact check follows: lines
inside that were deleted come back, as pages of one host can hold the same article or passage, and
lines outside that were not go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import prepare, stored
from .textkit import Words, signed
from .urls import host_of, path_of

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_ROLE = re.compile(r"""\brole\s*=\s*["']?(?:main|article)\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)
#: Elements whose text is never content, raw-text elements, blocks, and void elements.
_DROP = frozenset("head nav footer aside form button select textarea noscript template iframe object svg canvas menu dialog datalist map audio video".split())
_RAW = frozenset("script style title".split())
_BLOCK = frozenset("p div article main section h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption header footer nav aside form fieldset legend address details summary hr br body html hgroup search center".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark furniture, and words of place beside them.  A name counts if
#: all of its words are of these and one is of the first: "cookie-banner" and "site-nav", not "no-sidebar" or "banner-title".
_FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription signup login paywall "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer comment comments reply replies respond disqus share sharing social related recommended widget popup modal overlay search contentinfo complementary".split())
_PLACE = frozenset("site page main global primary secondary top bottom left right header box bar list area section wrapper container".split())
#: Dropped elements whose article is never the page's; in the next three, only a ``main`` is.
_HIDDEN, _ASIDE = _DROP - {"form", "nav", "footer", "aside"}, frozenset(("nav", "footer", "aside"))


def is_furniture(names: str) -> bool:
    for name in names.lower().split():
        words = {x for x in re.split(r"[-_]+", name) if x and not x.isdigit()}
        if words & _FURNITURE and words <= _FURNITURE | _PLACE:
            return True
    return False


def page_lines(html: str) -> tuple[bool, list[str]]:
    """Whether the page marks its article, and the lines of the article, or else of the page.

    Where all marks are in dropped elements, those around the page's ``main``, or around its only article if that is
    longer than the rest, are not dropped.
    """
    marked, lines, inside = page_blocks(html)
    return marked, [x for x, own in zip(lines, inside) if own] if marked else lines


def page_blocks(html: str) -> tuple[bool, list[str], list[bool]]:
    """``page_lines`` with all lines of the page, and whether each is of the article; of a page without a mark, none is."""
    marked, lines, inside, held = _lines(html, frozenset())
    if not marked and held:
        mains = [x for x in held if x[0]]
        if mains or len(held) == 1:
            again, more, own, _ = _lines(html, (mains or held)[0][1])
            if again and (mains or sum(len(x) for x, i in zip(more, own) if i) > sum(map(len, lines))):
                return again, more, own
    return marked, lines, inside


def _lines(html: str, kept: frozenset[int]) -> tuple[bool, list[str], list[bool], list[tuple[bool, frozenset[int]]]]:
    """``page_blocks`` with the elements that open at ``kept`` not dropped; and of each mark in a dropped element, whether it is a main, and where the elements around it open."""
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped, inside the article, where it opens
    places: dict[str, list[int]] = {}  # of each name, where it stands on the stack
    held: list[tuple[bool, frozenset[int]]] = []
    lines: list[str] = []
    inside: list[bool] = []
    part: list[str] = []
    marked = False

    def flush() -> None:
        if part:
            line = " ".join(unescape("".join(part)).split())
            part.clear()
            if line:
                lines.append(line)
                inside.append(bool(stack and stack[-1][2]))

    at, raw = 0, ""
    while m := _TOKEN.match(html, at):
        at = m.end()
        close, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            if m[0][0] != "<" or len(m[0]) == 1:
                if not (stack and stack[-1][1]):
                    part.append(m[0])
            continue
        name = name.lower()
        dropped, article = stack[-1][1:3] if stack else (False, False)
        if close:
            if places.get(name):
                k = places[name][-1]
                if name in _BLOCK or any(x[0] in _BLOCK or x[1] for x in stack[k:]):
                    flush()
                for x in stack[k:]:
                    places[x[0]].pop()
                del stack[k:]
            continue
        if name in _RAW:  # up to its own end tag
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name in _BLOCK:
            flush()
        elif name in ("td", "th"):
            part.append(" ")
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        names = " ".join(x for g in _NAMES.findall(attributes) for x in g) if "=" in attributes else ""
        starts = name in ("article", "main") or bool(names and _ROLE.search(attributes)) or "articleBody" in attributes
        furniture = name in _DROP or name == "header" and not article or bool(names and name not in ("body", "html", "article", "main") and is_furniture(names))
        furniture = furniture and m.start() not in kept
        if furniture and not dropped:
            flush()
        if starts and not dropped and not furniture:
            flush()
            marked = True
        if starts and (dropped or furniture):
            around = {x[0] for x in stack} | {name}
            is_main = name == "main" or "main" in names.lower().split()
            if not around & _HIDDEN and (is_main or not around & _ASIDE):
                held.append((is_main, frozenset(x[3] for x in stack) | {m.start()}))
        places.setdefault(name, []).append(len(stack))
        stack.append((name, dropped or furniture, article or starts, m.start()))
    flush()
    return marked and any(inside), lines, inside, held


def common_lines(a: list[int], b: list[int]) -> np.ndarray:
    """Which lines of ``a`` belong to a longest common subsequence with ``b``.

    Bit-parallel row lengths inside Hirschberg's division: exact, in memory linear in the lines.
    """
    keep = np.zeros(len(a), bool)

    def lengths(x: list[int], y: list[int]) -> np.ndarray:
        """LCS lengths of x with every prefix of y."""
        where: dict[int, int] = {}
        for j, line in enumerate(y):
            where[line] = where.get(line, 0) | 1 << j
        full = (1 << len(y)) - 1
        v = full
        for line in x:
            u = v & where.get(line, 0)
            v = ((v + u) | (v - u)) & full
        bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
        return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))

    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, bl, bh = todo.pop()
        while lo < hi and bl < bh and a[lo] == b[bl]:
            keep[lo] = True
            lo, bl = lo + 1, bl + 1
        while lo < hi and bl < bh and a[hi - 1] == b[bh - 1]:
            keep[hi - 1] = True
            hi, bh = hi - 1, bh - 1
        if lo >= hi or bl >= bh:
            continue
        if hi - lo == 1:
            keep[lo] = a[lo] in b[bl:bh]
            continue
        mid = (lo + hi) // 2
        split = lengths(a[lo:mid], b[bl:bh]) + lengths(a[mid:hi][::-1], b[bl:bh][::-1])[::-1]
        cut = bl + int(split.argmax())
        todo += [(lo, mid, bl, cut), (mid, hi, cut, bh)]
    return keep


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, html, as lines, and which of them a marked article holds (null without a mark)."""
    for batch in batches:
        lines, article = [], []
        for html in batch.column(batch.num_columns - 1).to_pylist():
            marked, own, inside = page_blocks(html or "")
            lines.append(own)
            article.append(inside if marked else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.list_(pa.string())), pa.array(article, pa.list_(pa.bool_()))], [*batch.schema.names[:-1], "lines", "article"])


def _parse_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, html, as the hashes of its lines."""
    for batch in batches:
        hashes = [signed(_line_hashes(page_blocks(html or "")[1])).tolist() for html in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hashes, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "hashes"])


def _line_hashes(lines: list[str]) -> np.ndarray:
    """One hash a line: each is a single word once its spaces are taken for another sign."""
    if not lines:
        return np.empty(0, np.uint64)
    return Words([x.replace(" ", "\x1f").encode("utf-8", "surrogatepass") for x in lines]).h


def nearest_pages(keys: DataFrame) -> DataFrame:
    """(row_key, partner) for each open page that shares its host with another: the neighbour in path order with the longer common path prefix.

    ``keys`` (row_key, host, path, open) is sorted over all partitions; the two pages on either side
    of a partition's end are paired from the first and last rows of the partitions.
    """
    order = ["host", "path", "row_key"]

    def adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            out = []
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(5)]))
            for row in rows:
                if last is None:
                    out.append((None, None, None, "first", *row))
                else:
                    out += _pairs(last, row)
                last = row
            yield _adjacent_batch(out)
        if last is not None:
            yield _adjacent_batch([(None, None, None, "last", *last)])

    both = stored(
        keys.where(F.col("host") != "").repartitionByRange(*order).sortWithinPartitions(*order)
        .select("row_key", "host", "path", "open", F.spark_partition_id().alias("part"))
        .mapInArrow(adjacent, "page bigint, partner bigint, shared int, edge string, row_key bigint, host string, path string, open boolean, part int"),
        "page-order",
    )
    ends = both.where(F.col("edge").isNotNull())  # two rows a partition
    follow = Window.orderBy("part", F.col("edge") == "last")
    this = F.struct("row_key", "host", "path", "open", "edge")
    met = ends.select(this.alias("b"), F.lag(this).over(follow).alias("a")).where((F.col("b.edge") == "first") & (F.col("a.host") == F.col("b.host")))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [x[:3] for x in _pairs(tuple(a[k] for k in ("row_key", "host", "path", "open")), tuple(b[k] for k in ("row_key", "host", "path", "open")))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int32())], ["page", "partner", "shared"])

    pairs = both.where(F.col("page").isNotNull()).select("page", "partner", "shared").unionByName(met.select("a", "b").mapInArrow(across, "page bigint, partner bigint, shared int"))
    best = pairs.groupBy("page").agg(F.max_by("partner", F.struct("shared", -F.col("partner"))).alias("partner"))
    return best.select(F.col("page").alias("row_key"), "partner")


def _pairs(a: tuple, b: tuple) -> list[tuple]:
    """Both directions of two neighbours (row_key, host, path, open, ...) on one host, for open pages."""
    if a[1] != b[1] or not (a[3] or b[3]) or a[0] == b[0]:
        return []
    shared = next((i for i, (x, y) in enumerate(zip(a[2], b[2])) if x != y), min(len(a[2]), len(b[2])))
    return [(x[0], y[0], shared, *[None] * 6) for x, y in ((a, b), (b, a)) if x[3]]


def _adjacent_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["page", "partner", "shared", "edge", "row_key", "host", "path", "open", "part"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_shared, n_restored) of each page, one row for each row.

    Null or empty html gives an empty text.  A null url has no host and is not paired, nor is a
    page alone on its host; differencing leaves their lines as they are.  Copies of a page, which share all lines,
    are not differenced either.  ``n_shared`` is the number of lines that differencing deletes, ``n_restored`` that of those that the page's
    marks give back.  Other columns of ``pages`` are ignored.
    """
    prepare(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    own = pages.select(F.xxhash64("page_id", "url", "html").alias("row_key"), "page_id", "url", "html")
    # lines are parsed twice and moved once: kept besides, they would take more disk than the pages
    hashed = stored(own.select("row_key", "url", "html").mapInArrow(_parse_hashes, "row_key bigint, url string, hashes array<bigint>"), "page-lines")
    partners = nearest_pages(hashed.select("row_key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.lit(True).alias("open")))
    hashes = hashed.groupBy("row_key").agg(F.first("hashes").alias("hashes"))
    theirs = hashes.select(F.col("row_key").alias("partner"), F.col("hashes").alias("theirs"))
    paired = hashes.join(partners, "row_key").join(theirs, "partner").where("hashes != theirs").select("row_key", "hashes", "theirs")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [np.flatnonzero(common_lines(a, b)).tolist() for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared, pa.list_(pa.int32()))], ["row_key", "shared"])

    parsed = own.mapInArrow(_parse, f"row_key bigint, page_id {kind}, url string, lines array<string>, article array<boolean>")
    shared = paired.mapInArrow(difference, "row_key bigint, shared array<int>")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, n_shared, n_restored = [], [], []
            for lines, article, gone in zip(*[batch.column(i).to_pylist() for i in (2, 3, 4)]):
                left = np.ones(len(lines), bool)
                left[gone or []] = False
                sure = left if article is None else np.array(article, bool)  # the check
                text.append("\n".join(x for x, on in zip(lines, sure) if on))
                n_shared.append(int((~left).sum()))
                n_restored.append(int((sure & ~left).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(n_shared, pa.int64()), pa.array(n_restored, pa.int64())], ["page_id", "url", "text", "n_shared", "n_restored"])

    every = parsed.join(shared, "row_key", "left").select("page_id", "url", "lines", "article", "shared")
    out = every.mapInArrow(settle, f"page_id {kind}, url string, text string, n_shared bigint, n_restored bigint")
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared", "n_restored")
