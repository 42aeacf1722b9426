import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_text_operators import DOC, components, shingles, words


def test_pipeline(spark, tmp_path):
    r = random.Random(12)
    vocabulary = [f"word{i}" for i in range(400)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, item = make(70), " ".join(f"secret{i}" for i in range(20))
    texts = [" ".join(make(r.randrange(80, 200))) for _ in range(40)]
    texts[5] = texts[4]
    texts[6] = texts[4] + " more"
    for i in (10, 11):
        texts[i] = texts[i] + " " + " ".join(passage) + f" end{i}"
    texts[20] += " " + item
    texts += [None, "", "123 456"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {x.doc_id: x for x in docs.collect()}
        assert docs.columns == [f.split()[0] for f in DOC.split(", ")] + (["repeats"] if name == "mixing" else [])
    assert set(kept["language"]) == set(range(40))
    want = components([shingles(t, 5) for t in texts[:40]], 80)
    assert set(kept["neardup"]) == {i for i in range(40) if want[i] == i} == set(range(40)) - {5, 6}
    cut = kept["substrings"]
    assert set(cut) == set(kept["neardup"])
    for i in cut:
        if i in (10, 11):
            assert words(cut[i].text) == words(texts[i])[: -len(passage) - 1] + [f"end{i}"] and cut[i].n_chars == len(cut[i].text)
        else:
            assert cut[i].text == texts[i]
    assert set(kept["decontamination"]) == set(cut) - {20}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and all(x.repeats in (1, 2) for x in kept["mixing"].values())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((x.doc_id, x.repeats) for x in again.select("doc_id", "repeats").collect()) == sorted((x.doc_id, x.repeats) for x in kept["mixing"].values())
    assert again.where(F.col("repeats") < 1).count() == 0
