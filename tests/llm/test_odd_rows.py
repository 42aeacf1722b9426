"""Every operator and every pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import audio, decontaminate, html, language, mixing, neardup, quality, substring, toxicity, urls

PASSAGE = " ".join(f"p{i}" for i in range(70))
LONG = " ".join(f"long{i % 5000}" for i in range(300_000)) + " " + "x" * 2_000_000  # 5 MB, one word of 2 MB
#: Columns whose names operators might use for themselves.
CLASHES = ("_k", "_key", "cut_text", "row_key", "row_key_", "_repeats", "_source", "repeats", "n_words", "n_removed", "lang_pred", "score", "predicted", "component_id", "media", "c0", "_result")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def rows():
    base = [
        (1, f"The calm garden is here. {PASSAGE}", "en", "a"), (2, f"Der Garten ist da. {PASSAGE}", "de", "b"), (3, None, "en", "a"), (4, "", None, None), (5, " \n\t ", "en", "a"), (6, "12 !?", "en", "b"),
        (7, LONG, "en", "a"), (8, "tie tie tie", "en", "c"), (9, "tie tie tie", "en", "c"), (10, "a", "de", "b"), (10, "a", "de", "b"), (11, "same id", "en", "a"), (11, "same id", "en", "b"),
        (None, "no id at all", "en", "a"), (None, None, None, None), (12, "the house with the garden and the thing", "en", "a"), (13, "das haus und der garten nicht schön", "de", "b"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *[f"{c}!" for c in CLASHES]) for r in base]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(None, 1, 1), (1, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE), (2, None), (3, ""), (4, "tie"), (5, LONG)], "item_id long, text string")
    page = "<html><body><article><p>A &amp; b</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://h.com/a/1", page, "x"), (1, "http://h.com/a/1", page, "x"), (2, None, None, "x"), (3, "no url", "", "x"), (None, "http://h.com/a/2", "<p>" * 20_000 + "</b>" * 20_000, "x"), (4, "http://h.com/a/3", "<p>one<p>two", "x")], "page_id long, url string, html string, lines string")
    folder = str(tmp_path_factory.mktemp("odd"))
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return docs.persist(), labels, bench, pages, folder


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect()), key=str)


ALL = sorted((r[0] for r in rows()), key=str)


def carried(out, docs, replaced=()):
    """All rows' other columns are as they were."""
    for r in out.select(*[c for c in CLASHES if c not in replaced]).distinct().collect():
        assert tuple(r) == tuple(f"{c}!" for c in CLASHES if c not in replaced)


def test_toxicity(spark, tables):
    docs, labels, *_ = tables
    out = toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert sorted((r.doc_id for r in out), key=str) == ALL and all(0 <= r.score <= 1 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert by[8] == by[9] and len(by[10]) == 1 and by[3] == by[4] == by[5]
    assert toxicity.toxicity_scores(docs.limit(0), toxicity.fit_toxicity(docs.limit(0), labels)).count() == 0


def test_media(spark, tables):
    docs = tables[0]
    out = audio.media_digests(docs).collect()
    assert sorted((r.doc_id for r in out), key=str) == ALL
    one = {r.doc_id: r for r in out if r.doc_id is not None}
    assert one[3].payload_bytes == one[4].payload_bytes == 64 and one[8].feature == one[9].feature and one[7].n_bytes == len(LONG)
    assert audio.media_digests(docs.limit(0)).count() == 0 and audio.audio_features(audio.store_media(docs.limit(0))).count() == 0


def test_near_duplicates(spark, tables):
    docs = tables[0]
    out = neardup.near_duplicates(docs, 3, 85)
    assert ids(out) == ALL
    by = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert by[9].component_id == 8 and by[10].component_id == 10 and by[11].component_id == 11 and by[3].n_shingles == by[5].n_shingles == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and ids(kept) == sorted([1, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, None, None], key=str)  # 2 is a near copy of 1
    carried(kept, docs)
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_language(spark, tables):
    docs = tables[0]
    out = language.identify(docs, language.fit_language(docs))
    assert ids(out) == ALL
    by = {r.doc_id: r.lang_pred for r in out.where("doc_id is not null").collect()}
    assert by[3] == by[4] == by[5] == by[6] == "und" and by[8] == by[9]
    carried(out, docs, ("lang_pred",))
    assert language.identify(docs.limit(0), language.fit_language(docs)).count() == 0


def test_mixing(spark, tables):
    docs = tables[0]
    assert ids(mixing.mix_documents(docs)) == ALL
    taken = mixing.take_mix(docs)
    carried(taken, docs, ("repeats",))
    rows_ = taken.collect()
    assert all(1 <= r.repeats <= 2 for r in rows_) and taken.columns.count("repeats") == 1
    whole = mixing.take_mix(docs, weights=(1.0,), share=1.0, epochs=1.0).select("doc_id", "source", "text", "repeats").collect()
    words = lambda t: len((t or "").split())
    for s in ("a", "b", "c"):  # each source's own rows, ids that it shares with another source too
        assert sum(words(r.text) * r.repeats for r in whole if r.source == s) <= sum(words(r[1]) for r in rows() if r[3] == s)
    assert mixing.take_mix(docs.limit(0)).count() == 0 and mixing.mix_documents(docs.where("source = 'c'")).where("repeats > 0").count() in (0, 2)


def test_equal_rows_are_taken_equally(spark):
    docs = spark.createDataFrame([(1, "a b c d", "s"), (1, "a b c d", "t"), (2, "e f", "t")], "doc_id long, text string, source string")
    got = mixing.take_mix(docs, weights=(1.0, 1.0), share=1.0, epochs=2.0).collect()
    assert sorted({(r.doc_id, r.source) for r in got}) in ([(1, "s"), (1, "t"), (2, "t")], [(1, "s"), (1, "t")], [(1, "s"), (2, "t")])


def test_urls(spark, tables):
    _, labels, _, pages, _ = tables
    out = urls.filter_urls(pages, urls.page_outcomes(pages, labels)).collect()
    assert len(out) == 6 and {r.verdict for r in out if not r.host} == {"allow"}
    tied = (("h.com", "/a/", "block"), ("com", "/a/1/x/", "allow"), ("com", "/", "allow"))
    assert {r.rule for r in urls.filter_urls(pages, urls.page_outcomes(pages, labels), tied).where("host = 'h.com'").collect()} == {"h.com/a/"}
    assert urls.filter_urls(pages.limit(0), urls.page_outcomes(pages.limit(0), labels.limit(0))).count() == 0


def test_substrings(spark, tables):
    docs = tables[0]
    out = substring.remove_repeats(docs)
    assert ids(out) == ALL
    by = {r.doc_id: r for r in out.where("doc_id is not null").collect()}
    assert by[1].n_removed == by[2].n_removed == 70 and by[3].n_words == by[4].n_words == by[5].n_words == 0 and by[7].n_words == 300_001 and by[7].n_removed == 300_000
    cut = substring.remove_repeats(docs, window=50, with_text=True)
    carried(cut, docs, ("n_words", "n_removed"))
    texts = {r.doc_id: r.text for r in cut.where("doc_id is not null").collect()}
    assert texts[1] == "The calm garden is here." and texts[3] is None and texts[4] == "" and texts[5] == " \n\t "
    assert substring.remove_repeats(docs.limit(0), with_text=True).count() == 0


def test_html(spark, tables):
    pages = tables[3]
    out = html.extract_pages(pages).collect()
    assert len(out) == 6
    assert [r.text for r in out if r.page_id == 1] == ["A & b", "A & b"] and {r.text for r in out if r.page_id in (2, 3)} == {""}
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_quality(spark, tables):
    docs, labels, *_ = tables
    out = quality.quality_scores(docs, quality.fit_quality(docs, labels)).collect()
    assert sorted((r.doc_id for r in out), key=str) == ALL and all(0 <= r.score <= 1 for r in out)
    one = {r.doc_id: r.score for r in out if r.doc_id is not None}
    assert one[8] == pytest.approx(one[9]) and one[3] == pytest.approx(one[5])
    assert quality.quality_scores(docs.limit(0), quality.fit_quality(docs.limit(0), labels)).count() == 0


def test_decontamination(spark, tables):
    docs, _, bench, *_ = tables
    found = sorted({(r.doc_id, r.item_id) for r in decontaminate.containment_search(docs, bench).collect()})
    assert found == [(1, 1), (2, 1), (7, 5), (8, 4), (9, 4)]
    kept = decontaminate.drop_contaminated(docs, bench)
    carried(kept, docs)
    assert ids(kept) == sorted((i for i in ALL if i not in (1, 2, 7, 8, 9)), key=str)
    assert ids(decontaminate.drop_contaminated(docs, bench.limit(0))) == ALL and decontaminate.containment_search(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, tables, name, stage):
    docs, _, _, _, folder = tables
    out = stage(spark, docs, folder)
    assert set(out.columns) >= set(docs.columns) and out.count() <= docs.count()
    carried(out, docs, ("repeats",))
    assert stage(spark, docs.limit(0), folder).count() == 0
