import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegraph.llm import audio, decontaminate, html, language, mixing, neardup, quality, substring, textkit, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def fold(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, k):
    w = words(fold(text))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, odd spaces, nulls and empties."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ünder", "naïve", "the", "The"]
    make = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, texts = make(60), []
    for i in range(n):
        own = make(r.randrange(1, 160))
        if i % 4 == 1 and texts:
            own = words(texts[-1]) or own
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
        if i % 7 == 3:
            at = r.randrange(len(own))
            own[at:at] = passage[r.randrange(10):]
        texts.append(r.choice([" ", "\n", " \t"]).join(own))
    texts += [None, "", " \n\t ", "one", "one two", "one two", "a " * 120, "a " * 80]
    return texts


def frame(spark, texts, langs=None):
    rows = [(i, t, (langs or ["en"] * len(texts))[i], [None, "s1", "s2", "s3"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC).repartition(3)


def components(sets, percent):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def test_word_hashes_match_words():
    texts = [(t or "").encode() for t in corpus()]
    w = textkit.Words(texts, fold=True)
    seen = {}
    for i, t in enumerate(corpus()):
        own = words(fold(t))
        got = w.h[w.off[i]:w.off[i + 1]].tolist()
        assert len(own) == len(got)
        for x, h in zip(own, got):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    long = b"x" * (textkit.PIECE + 5)
    a, b = textkit.Words([long + b" y " + long]), textkit.Words([b"y", long])
    assert a.h[0] == a.h[2] == b.h[1] and a.h[1] == b.h[0]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    texts = corpus()
    out = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, texts), k, percent).collect()}
    sets = [shingles(t, k) for t in texts]
    want = components(sets, percent)
    assert [out[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [out[i].component_id for i in range(len(texts))] == want
    assert all(out[i].kept == (want[i] == i) for i in out)
    assert len(set(want)) < len(texts) - 5


def test_near_duplicates_odd_rows(spark):
    rows = [(5, "a b c d", "en"), (5, "a b c d", "en"), (None, "a b c d", "fr"), (7, "e f g h", None), (5, "e f g h", "en"), (9, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True), (None, None, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0), 3, 85).count() == 0
    kept = neardup.drop_near_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns and sorted([r.doc_id for r in kept.collect()], key=str) == [5, 9, None]


def near_group(seed, n=60):
    """Members of a large near group whose similarity to each other is around the threshold."""
    r = random.Random(seed)
    texts = []
    for i in range(n):
        own = [f"b{j}" for j in range(120)]
        for _ in range(r.randrange(0, 9)):
            own[r.randrange(len(own))] = f"x{i}_{r.randrange(1000)}"
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("postings,hubs", [(64, 256), (2, 5)])
def test_missing_links_need_no_hub(spark, monkeypatch, postings, hubs):
    monkeypatch.setattr(neardup, "POSTINGS", postings)
    monkeypatch.setattr(neardup, "HUBS", hubs)
    texts = near_group(3)
    out = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert [out[i] for i in range(len(texts))] == components([shingles(t, 3) for t in texts], 85)


@pytest.mark.parametrize("postings", [64, 8, 0])
@pytest.mark.parametrize("parts", [60, 7])
def test_missing_links_are_all_links_across_components(spark, monkeypatch, postings, parts):
    """Whatever the length of posting lists, all pairs of one key that reach the threshold are found, and no others."""
    monkeypatch.setattr(neardup, "POSTINGS", postings)
    monkeypatch.setattr(neardup, "HUBS", 5)
    texts = near_group(4)
    sets = [shingles(t, 3) for t in texts]
    rows = spark.createDataFrame([(i, len(sets[i]), t) for i, t in enumerate(texts)], "set long, n long, text string")
    bits = [neardup.Sketcher(3, 11, 3)([t.encode()])[4].tolist() for t in texts]
    nodes = spark.createDataFrame([(i, len(sets[i]), b) for i, b in enumerate(bits)], "set long, n long, bits array<long>")
    labels = rows.select("set", (F.col("set") % parts).alias("component"))
    found = neardup._missing_links(rows.select(F.lit(1).alias("key"), "set"), labels, nodes, rows, 3, 85).collect()
    want = {(i, j) for i in range(60) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    found = {(max(x), min(x)) for x in found}
    assert len(found) > 10 and found <= want
    # with the given components, the links found connect what all links connect
    given = [(i, i % parts) for i in range(60)]
    assert _connected(60, [*found, *given]) == _connected(60, [*want, *given])


def test_long_lists_lose_no_pair(spark, monkeypatch):
    """Every pair across components that reaches the threshold is a candidate."""
    monkeypatch.setattr(neardup, "HUBS", 5)
    texts = near_group(4)
    sets = [shingles(t, 3) for t in texts]
    count = Counter(x for s in sets for x in s)
    rows = []
    for i, s in enumerate(sets):
        order = sorted(s, key=lambda x: (count[x], x))
        bits = neardup.Sketcher(3, 11, 3)([texts[i].encode()])[4].tolist()
        rows += [(i, len(s), i % 7, place, " ".join(x), bits) for place, x in enumerate(order[: len(s) - -(-len(s) * 85 // 100) + 1]) if count[x] > 1]
    long = spark.createDataFrame(rows, "set long, n int, component long, place int, shingle string, bits array<long>")
    got = {(max(x), min(x)) for pairs in neardup._long_list_pairs(long, 85) for x in pairs.collect()}
    assert got >= {(i, j) for i in range(60) for j in range(i) if i % 7 != j % 7 and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}


def _connected(n, pairs):
    least = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def brute_cut(texts, window):
    count = Counter(tuple(words(t)[i:i + window]) for t in texts for i in range(len(words(t)) - window + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window,k", [(35, 12), (20, 5)])
def test_substrings(spark, window, k):
    texts = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(frame(spark, texts), window, k).collect()}
    assert [got[i] for i in range(len(texts))] == brute_cut(texts, window)
    cut = {r.doc_id: r for r in substring.remove_repeats(frame(spark, texts), window, k, with_text=True).collect()}
    assert all(cut[i].n_removed == got[i][1] and (cut[i].text == texts[i] or got[i][1]) for i in got)


def test_substring_repeated_row(spark):
    text = " ".join(f"v{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "x")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring.remove_repeats(docs).collect()) == [0, 40, 40]
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_decontamination(spark):
    texts, r = corpus(), random.Random(2)
    items = [" ".join(f"q{r.randrange(400)}" for _ in range(n)) for n in (30, 15, 5, 3, 1, 60)] + [None, "", "W1 w2"]
    for i, item in enumerate(items[:6]):
        texts[i * 5] = (texts[i * 5] or "") + " " + item.upper().replace("Q", "Q") + " tail"
    half = words(items[0])[:15]
    texts[7] = " ".join(half)
    docs, bench = frame(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.n_item, x.n_shared) for x in decontaminate.containment_search(docs, bench).collect()}
    want = {}
    for j, item in enumerate(items):
        n = len(words(item))
        if n:
            s = shingles(item, 5)
            for i, t in enumerate(texts):
                w = words(fold(t))
                own = {tuple(w[a:a + min(5, n)]) for a in range(len(w) - min(5, n) + 1)}
                if len(s & own) >= 0.8 * len(s) - 1e-9:
                    want[i, j] = (len(s), len(s & own))
    assert got == want and (0, 0) in got and (7, 0) not in got
    many = {(x.doc_id, x.item_id) for x in decontaminate.containment_search(docs, bench, block_words=20).collect()}
    assert many == set(want)
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_mixing(spark):
    texts = corpus(n=200)
    docs = frame(spark, texts)
    rows = mixing.mix_documents(docs).collect()
    assert sorted(rows) == sorted(mixing.mix_documents(docs.repartition(5)).collect())
    size = Counter()
    for i, t in enumerate(texts):
        size[[None, "s1", "s2", "s3"][i % 4]] += len(words(t))
    weight = {"s1": 5, "s2": 2, "s3": 1, None: 5}
    target, capped = {}, set()
    while True:
        level = (1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        target = {s: 2 * size[s] if s in capped else level * weight[s] for s in size}
        over = {s for s in size if target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in size:
        own = [r for r in rows if r.source == s]
        assert own[0].target == pytest.approx(target[s])
        assert abs(sum(r["size"] * r.repeats for r in own) - target[s]) <= max(r["size"] for r in own)
        assert all(0 <= r.repeats <= 2 for r in own)
    given = spark.createDataFrame([("s1", 1.0), (None, 0.0)], "source string, weight double")
    only = mixing.mix_documents(docs, given).where("repeats > 0").select("source").distinct().collect()
    assert [r.source for r in only] == ["s1"]
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_language(spark):
    r = random.Random(4)
    make = {"en": ["the", "thing", "with", "house", "and"], "de": ["der", "schön", "und", "straße", "nicht"], "es": ["el", "niño", "que", "año", "calle"]}
    texts, langs = [], []
    for i in range(150):
        lang = ["en", "de", "es"][i % 3]
        texts.append(" ".join(r.choice(make[lang]) for _ in range(r.randrange(5, 60))))
        langs.append(lang)
    texts += [None, "", "123 !?", "der Straße"]
    langs += ["en", "en", "en", None]
    docs = frame(spark, texts, langs)
    model = language.fit_language(docs)
    rows = {x.doc_id: x for x in language.identify(docs, model).collect()}
    assert [rows[i].lang_pred for i in range(150)] == langs[:150]
    assert [rows[i].lang_pred for i in range(150, 154)] == ["und", "und", "und", "de"] and rows[151].lang_score == 0
    assert rows[3].lang == "en" and all(0 <= x.lang_score <= 1 for x in rows.values())
    x, y = texts[0].encode(), texts[1].encode()
    own = lambda t, n: {t.lower()[i:i + n] for i in range(len(t) - n + 1)}
    small = language.LanguageModel(landmarks=2).fit([x, y], ["a", "b"])
    want = np.mean([len(own(x, n) & own(y, n)) / np.sqrt(len(own(x, n)) * len(own(y, n))) for n in (1, 2, 3)])
    assert small._kernel([x])[0, 1] == pytest.approx(want, rel=1e-5)
    none = language.identify(docs, language.fit_language(docs.limit(0)))
    assert {x.lang_pred for x in none.collect()} == {"und"}


def test_quality(spark):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["Some", "plain", "words", "here,", "and", "there."]) + str(r.randrange(3)) for _ in range(r.randrange(20, 200)))
    bad = lambda: " ".join(r.choice(["BUY", "NOW!!", "$$$", "|", "CLICK"]) for _ in range(r.randrange(20, 200)))
    texts = [good() if i % 3 else bad() for i in range(240)] + [None, "", good() + " " + good()]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, 0) for i in range(200)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    rows = {x.doc_id: x for x in quality.quality_scores(docs, model).collect()}
    assert np.mean([(rows[i].score > 0.5) == bool(i % 3) for i in range(200, 240)]) > 0.95
    assert rows[240].score == rows[241].score and 0 <= rows[240].score <= 1
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in rows.values())
    numeric = quality.AttentionModel(epochs=1).fit([np.random.default_rng(0).normal(size=(3, quality.FEATURES)) for _ in range(4)], np.array([0, 1, 1, 0.0]))
    x, off, y = np.random.default_rng(1).normal(size=(9, quality.FEATURES)), np.array([0, 2, 5, 9]), np.array([1.0, 0, 1])
    loss = lambda: -np.mean(y * np.log(p := numeric.scores(x, off)) + (1 - y) * np.log(1 - p)) + quality.DECAY / 2 * sum((w**2).sum() for w in numeric.w[:6])
    grads = numeric._gradients(x, off, y)
    for i, w in enumerate(numeric.w):
        at = tuple(0 for _ in w.shape)
        keep = w[at] if w.shape else float(w)
        step = 1e-5
        both = []
        for s in (step, -step):
            if w.shape:
                w[at] = keep + s
            else:
                numeric.w[i] = np.array(keep + s)
            both.append(loss())
        if w.shape:
            w[at] = keep
        else:
            numeric.w[i] = np.array(keep)
        assert (both[0] - both[1]) / (2 * step) == pytest.approx(float(grads[i][at]), abs=1e-6)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = _next(row, x, b, i)
    return row[-1]


def _next(old, x, b, i):
    row = [i + 1]
    for j, y in enumerate(b):
        row.append(min(old[j] + (x != y), old[j + 1] + 1, row[-1] + 1))
    return row


def test_levenshtein_trie():
    terms = ["scum", "moron", "idiot", "worthless", "abominable"]
    trie, r = toxicity.LevenshteinTrie(terms), random.Random(8)
    for _ in range(2000):
        w = list(r.choice(terms))
        for _ in range(r.randrange(4)):
            kind, at = r.randrange(3), r.randrange(len(w) + 1)
            w[at:at + (kind > 0)] = [r.choice("abcdeimnorstuwz")] if kind < 2 else []
        word = "".join(w)
        fits = [(edits(word, t), i) for i, t in enumerate(terms) if edits(word, t) <= toxicity.allowed(t)]
        assert trie.find(word) == (min(fits)[::-1] if fits else None), word
        begun = [min(edits(word[:n], t) for n in range(len(word) + 1)) for t in terms]
        stems = frozenset(range(len(terms)))
        fit = any(e <= toxicity.allowed(t) for e, t in zip(begun, terms))
        assert (trie.find(word, stems) is not None) == fit, word


def test_toxicity(spark):
    r = random.Random(9)
    clean = lambda: [r.choice(["some", "calm", "words", "about", "gardens"]) for _ in range(r.randrange(5, 60))]
    texts = []
    for i in range(300):
        w = clean()
        if i % 5 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["moron!", "Worthless", "idiot"]))
        texts.append(" ".join(w))
    texts += [None, "", "you are a mroron and a worthles idiiot", 'the word "moron" is calm', "calm words"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert {"moron", "worthless", "idiot"} <= set(model.terms) and "calm" not in model.terms
    rows = {x.doc_id: x for x in toxicity.toxicity_scores(docs, model).collect()}
    assert [rows[i].predicted for i in range(300)] == [int(i % 5 == 0) for i in range(300)]
    assert rows[300].score == rows[301].score == rows[304].score and rows[300].predicted == 0
    assert rows[303].score < rows[5].score
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in rows.values())
    assert rows[302].predicted == 1 and rows[303].predicted == 0  # misspelled insults only; a quoted one
    quoted, plain, wrong = model.counts([b'he "moron" said', b"he moron went", b"he mroron went"])
    assert quoted.tolist() == [toxicity.QUOTED_WEIGHT, 0, 3] and plain.tolist() == [1, 0, 3] and wrong.tolist() == [0, 1, 3]
    bad = "you moron are a worthless and idiot thing"
    wrong, cited = model.planted(bad.encode())
    assert [p >= 0.7 for p in model.scores([bad.encode(), wrong, cited, b"a calm garden"])] == [True, True, False, False]
    assert wrong.split()[1] not in (b"moron", b"morons") and cited.split()[1] == b'"moron"' and model.planted(b"calm") is None
    assert toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels.limit(0))).where("predicted = 1").count() == 0


def thue_morse(k, a="a", b="b"):
    """Two different words of 2**k letters that polynomials modulo 2**64 do not tell apart, whatever the odd base."""
    bits = [bin(i).count("1") % 2 for i in range(1 << k)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_words_that_polynomials_do_not_tell_apart(spark):
    one, two = thue_morse(11)
    w = textkit.Words([one.encode(), two.encode(), one.upper().encode(), b"x" * 40, b"x" * 41], fold=True)
    assert w.h[0] != w.h[1] and w.h[0] == w.h[2] and len(set(w.h.tolist())) == 4
    assert textkit.Words([one.encode(), one.upper().encode()]).h[0] != textkit.Words([one.upper().encode()]).h[0]
    tail = " ".join(f"t{i}" for i in range(40))
    docs = frame(spark, [one, two, f"{one} {tail}", f"{two} {tail}", f"{one} {tail}"])
    rows = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, k=3, percent=85).collect()}
    assert rows[0] == 0 and rows[1] == 1 and rows[2] == rows[4]
    bench = spark.createDataFrame([(7, one)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.containment_search(docs.where("doc_id < 2"), bench).collect()} == {0}
    gone = {r.doc_id: r.n_removed for r in substring.remove_repeats(docs).collect()}
    assert gone == {0: 0, 1: 0, 2: 41, 3: 40, 4: 41}


def test_common_near_words_are_no_misspellings(spark):
    """The near word "clawn" is common among clean documents, so it is no insult; other misspellings of the term stay."""
    rows = [(i, f"what a clown text{i} of words{i}", 1) for i in range(60)] + [(100 + i, f"the clawn is a calm bird{i} here{i}", 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], DOC)
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int"))
    model.counts([b"makes the automata"])
    assert "clawn" in model.clean and "clown" not in model.strict
    assert model.find("clawn") is None and model.find("clownn")[1] == 1 and model.find("clown")[1] == 0


def test_audio(spark):
    texts = corpus(n=12)
    rows = {x.doc_id: x for x in audio.media_digests(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        x = rows[i]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        media = audio.to_wav(payload)
        assert (x.media_bytes, x.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and audio.from_wav(media)[0] == payload
    assert rows[len(texts) - 4].feature == rows[len(texts) - 3].feature
    t = np.arange(16_000) / 16_000
    tone = np.where((t > 0.3) & (t < 0.6), np.sin(2 * np.pi * 1000 * t), 0.02 * np.sin(2 * np.pi * 1000 * t))
    spans, tensors, mel = audio.analyse(audio.to_wav((128 + 100 * tone).astype(np.uint8).tobytes()))
    assert len(spans) == 1 and abs(spans[0][0] - 0.3) < 0.03 and abs(spans[0][1] - 0.6) < 0.03
    assert tensors.shape == (1, audio.PATCH, audio.MELS) and mel.shape[1] == audio.MELS
    peak = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 60 / 700), 2595 * np.log10(1 + 4000 / 700), audio.MELS + 2)[1:-1] / 2595) - 1)
    assert abs(peak[tensors[0][3].argmax()] - 1000) < 150
    media = audio.store_media(frame(spark, texts))
    features = {x.doc_id: x for x in audio.audio_features(media).collect()}
    for x in media.collect():
        spans, tensors = audio.from_ipc(bytes(features[x.doc_id].tensors))
        want = audio.analyse(bytes(x.media))
        assert audio.digest(spans, tensors, len(want[2]), float(want[2].mean())) == rows[x.doc_id].feature
        assert features[x.doc_id].segments == len(spans) and np.array_equal(spans, want[0]) and np.allclose(tensors, want[1], rtol=1e-3, atol=1e-3) and tensors.shape[1:] == (audio.PATCH, audio.MELS)


def test_every_sample_is_in_a_frame():
    for n in (1, 150, 200, 201, 299, 300, 301, 1234):
        x = np.zeros(n, "f4")
        x[-1] = 1.0
        assert audio.log_mel(x, 8000)[1].max() > -85  # silence is -90
        assert len(audio.log_mel(x, 8000)[0]) == max(1, -(-(n - audio.FRAME) // audio.HOP) + 1)


def test_log_mel_equals_a_direct_transform():
    r = np.random.default_rng(3)
    x = r.normal(size=900).astype("f4")
    mel, energy = audio.log_mel(x, 8000)
    filters = audio._mel(8000)
    for i in range(len(mel)):
        own = x[i * audio.HOP:i * audio.HOP + audio.FRAME] * np.hanning(audio.FRAME + 2)[1:-1]
        k = np.arange(audio.FFT // 2 + 1)[:, None]
        wave = (own * np.exp(-2j * np.pi * k * np.arange(audio.FRAME) / audio.FFT)).sum(1)
        assert np.allclose(mel[i], np.log(np.abs(wave) ** 2 @ filters + 1e-6), atol=1e-3)
        assert np.isclose(energy[i], 10 * np.log10((own**2).sum() + 1e-9), atol=1e-3)


def test_segments_by_a_plain_loop():
    r = np.random.default_rng(4)
    for _ in range(50):
        energy = r.normal(size=80).cumsum()
        level, on, first, want = np.median(energy), False, 0, []
        for i, e in enumerate(energy):
            if not on and e > level + audio.HIGH_DB:
                on, first = True, i
            elif on and e < level + audio.LOW_DB:
                on = False
                want.append((first, i))
        if on:
            want.append((first, len(energy)))
        assert [tuple(x) for x in audio.segments(energy).tolist()] == want


@pytest.mark.parametrize("up,down", [(1, 2), (5, 8), (3, 2)])
def test_polyphase_equals_direct_filter(up, down):
    x = np.random.default_rng(0).normal(size=1003).astype("f4")
    branches, delay = audio._phases(up, down)
    h = np.zeros(sum(map(len, branches)), "f4")
    for p in range(up):
        h[p::up] = branches[p]
    z = np.zeros(len(x) * up, "f4")
    z[::up] = x
    assert np.abs(audio.resample(x, up, down) - np.convolve(z, h)[delay:delay + len(z)][::down]).max() < 1e-5


def test_urls(spark):
    cases = [
        (1, "https://www.example.com/en/1?x=1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "http://Shop.EXAMPLE.com/en/2#t", "shop.example.com", "/en/2", "example.com/en/", "block"),
        (3, "http://a.example.com/de/3", "a.example.com", "/de/3", "com/", "allow"), (4, "http://b.example.net/es/4", "b.example.net", "/es/4", "net/es/", "block"),
        (5, "http://b.example.net?q=/es/", "b.example.net", "", None, "allow"), (6, None, "", "", None, "allow"), (7, "no url", "", "", None, "allow"), (8, "http://notexample.com", "notexample.com", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "x") for c in cases] + [(100 + i, f"http://bad.example.org/en/{1000 + i}", "x") for i in range(40)] + [(200 + i, f"http://ok.example.org/en/{1040 + i}.html", "x") for i in range(40)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(1000 + i, int(i >= 40), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in urls.filter_urls(pages, urls.page_outcomes(pages, labels)).collect()}
    for c in cases:
        assert tuple(rows[c[0]][1:5]) == c[2:], c
    assert rows[100].verdict == "block" and rows[200].verdict == "allow"
    empty = urls.filter_urls(pages, urls.page_outcomes(pages, labels.limit(0)))
    assert empty.where("verdict = 'block'").count() == 2 and urls.filter_urls(pages.limit(0), urls.page_outcomes(pages, labels)).count() == 0


def test_html(spark):
    article = '<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><div class="ad">buy</div><article><h1>T &amp; x</h1><p>one<br>two&nbsp; 2<p>three<script>"</p>"</script></article><div id="comments">c</div><footer>f</footer>'
    shared = "<p>About us</p><p>{}</p><p>All rights reserved</p>"
    rows = [(1, "http://h/a/1", article), (2, "http://h/a/2", article), (3, None, None), (4, "http://g/x/10", shared.format("first")), (5, "http://g/x/11", shared.format("second")), (6, "http://g/y/1", "<p>lone"), (7, "http://z/", shared.format("kept")), (8, "http://z/", shared.format("kept"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract_pages(pages).collect()}
    assert got[1].text == got[2].text == "T & x\none\ntwo 2\nthree" and got[1].n_chars == len(got[1].text)
    assert got[3].text == "" and got[3].n_chars == 0
    assert got[4].text == "first" and got[5].text == "second" and got[6].text == "lone"
    assert got[7].text == got[8].text == "About us\nkept\nAll rights reserved"
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_nearest_pages_do_not_depend_on_partitions(spark):
    r = random.Random(11)
    keys = [(i, f"h{i % 3}", f"/{r.choice('abc')}/{r.randrange(40)}", r.random() < 0.5) for i in range(200)]
    order = sorted(keys, key=lambda k: (k[1], k[2], k[0]))
    want = {}
    for i, k in enumerate(order):
        near = [order[j] for j in (i - 1, i + 1) if 0 <= j < len(order) and order[j][1] == k[1]]
        common = lambda o: next((n for n, (x, y) in enumerate(zip(k[2], o[2])) if x != y), min(len(k[2]), len(o[2])))  # noqa: E731,B023
        if k[3] and near:
            want[k[0]] = min(near, key=lambda o: (-common(o), o[0]))[0]
    frame_ = spark.createDataFrame(keys, "row_key long, host string, path string, open boolean")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert {x.row_key: x.partner for x in html.nearest_pages(frame_).collect()} == want
    spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_lcs():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _lcs_row(row, x, b)
        return row[-1]

    def _lcs_row(old, x, b):
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
        return row

    for seed in range(150):
        r = random.Random(seed)
        a, b = ([r.randrange(6) for _ in range(r.randrange(30))] for _ in range(2))
        keep = html.common_lines(a, b)
        assert keep.sum() == length(a, b) == length([x for x, k in zip(a, keep) if k], b)
