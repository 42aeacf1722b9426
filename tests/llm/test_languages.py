from tidegraph.llm.language import TEXT_BYTES, fit_language, identify, training_rows


def test_every_language_is_learned(spark):
    """Seventy languages of one syllable each; the last has long texts only."""
    name = lambda k: f"l{k:02}"
    word = lambda k: "bcdfghklmn"[k // 10] + "aeiouyrstz"[k % 10] + "bcdfghklmn"[k // 10]
    rows = [(5 * (3 * k + i) + 1, " ".join([word(k)] * (20 + i if k < 69 else TEXT_BYTES)), name(k)) for k in range(70) for i in range(3 if k else 40)]
    rows += [(10_000 + i, "ordinary", "l00") for i in range(4)] + [(9_001, "x" * (TEXT_BYTES + 1), "l00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    texts, langs = training_rows(docs)
    assert set(langs) == {name(k) for k in range(70)}
    assert {x for t, x in zip(texts, langs) if len(t) > TEXT_BYTES} == {"l69"}
    asked = spark.createDataFrame([(k, " ".join([word(k)] * 9), name(k)) for k in (1, 40, 68, 69)], docs.schema)
    assert all(r.lang_pred == r.lang for r in identify(asked, fit_language(docs)).collect())
