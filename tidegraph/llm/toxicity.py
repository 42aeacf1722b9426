"""Toxicity: a learned lexicon matched with Levenshtein automata, weighed by context.

The lexicon holds terms that training documents labelled toxic have far more often than the
others: whole words, and stems, which stand for all words that begin with them.  A trie of the terms is
intersected with Levenshtein automata: the states of the product (trie node, term position, edits) are
determinised as texts need them, so a word costs one table step a character.  A hit counts less where its
context window quotes or reports it.  A logistic model, fitted on labelled documents, weighs the hits.

Labelled documents hold few misspelled or quoted insults, so what these count is learned from planted ones: each toxic
training document comes again with its insults misspelled, as toxic, and with its insults quoted, as clean.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import discard, prepare, remainder, sampled_labels, stored
from .textkit import Words, as_bytes, blocks

#: Bounds: labelled training rows; words remembered by a worker.
TRAIN_ROWS, MEMORY = 10_000, 500_000
#: A term is learned from at least SUPPORT different toxic training documents, if its contexts are over RATIO times as
#: common in toxic documents, and the log-likelihood ratio of that is over EVIDENCE.  Stems have STEM to LONGEST letters.
SUPPORT, RATIO, EVIDENCE, STEM, LONGEST = 5, 20.0, 30.0, 5, 24
#: A word of two clean training documents or more is no misspelling of a term.  If a term's other near words still hit over one
#: clean training document in CLEAN, edits are allowed in whole words only, not before free endings; if that does too, not at all.
CLEAN = 1000
#: What a quoted hit counts, and what a misspelled one may count, of a plain exact one.
WINDOW, QUOTED_WEIGHT, DISCOUNTS = 8, 0.1, (0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
_EDGES = "\"'`.,;:!?()[]{}<>*_~-‘’‚“”„«»‹›¿¡"
_OPENING, _CLOSING = tuple("\"'‘“„‚«‹`"), tuple("\"'’”“»›`")
#: Words that report or mention another's words.
REPORTING = frozenset("said says called calls quote quoted quotes quoting wrote writes term word phrase slur sagte nannte schrieb zitat wort dijo llamó escribió cita palabra dit appelé écrit mot citation".split())


def plain(word: str) -> str:
    return word.lower().strip(_EDGES)


def allowed(term: str) -> int:
    """Edits allowed for a term of this length."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class LevenshteinTrie:
    """Lazily determinised product of a trie and the Levenshtein automata of its terms.

    A state is a set of (node, edits) pairs, closed under deletions of term characters; ``find``
    returns (term index, edits) of the best match of a whole word, or None.  Terms differ in
    the edits they allow (``strict`` ones none), so a node knows the most that any term below it allows.
    """

    def __init__(self, terms: list[str], strict: frozenset[str] = frozenset()):
        self.terms = terms
        self.edits = [0 if t in strict else allowed(t) for t in terms]
        self.next: list[dict[str, int]] = [{}]
        self.most, self.term = [0], [-1]
        for i, term in enumerate(terms):
            at, k = 0, self.edits[i]
            self.most[0] = max(self.most[0], k)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.most.append(0)
                    self.term.append(-1)
                at = self.next[at][c]
                self.most[at] = max(self.most[at], k)
            self.term[at] = i
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.moves: list[dict[str, int]] = []
        self.best: list[tuple[int, int] | None] = []
        self.root = self._state({0: 0})

    def _state(self, least: dict[int, int]) -> int:
        """The state with these nodes and fewest edits, closed; -1 if it is dead."""
        todo = list(least.items())
        while todo:
            node, e = todo.pop()
            if least.get(node, 99) < e:
                continue
            for child in self.next[node].values():  # a term character left out
                if e < self.most[child] and e + 1 < least.get(child, 99):
                    least[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted((n, e) for n, e in least.items() if e <= self.most[n]))
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= self.edits[self.term[n]]]
            self.best.append(min(ends)[::-1] if ends else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.sets[state]:
            child = self.next[node].get(c)
            if child is not None and e < least.get(child, 99):
                least[child] = e
            if e < self.most[node]:
                least[node] = min(e + 1, least.get(node, 99))  # a word character too many
                for other in self.next[node].values():  # one for another
                    if e + 1 < least.get(other, 99):
                        least[other] = e + 1
        return self._state(least)

    def find(self, word: str, stems: frozenset[int] = frozenset()) -> tuple[int, int] | None:
        """The best match of the whole word, or of its beginning with one of the terms ``stems``."""
        state, begun = self.root, None
        for c in word:
            moves = self.moves[state]
            if c not in moves:
                if len(self.sets) > 200_000:  # bounded memory: start over
                    self.states, self.sets, self.moves, self.best = {}, [], [], []
                    self.root = self._state({0: 0})
                    return self.find(word, stems)
                moves[c] = self._step(state, c)
            state = moves[c]
            if state < 0:
                return begun
            hit = self.best[state]
            if stems and hit is not None and hit[0] in stems and (begun is None or hit[1] < begun[1]):
                begun = hit
        return self.best[state] or begun


def quoted(words: list[str], at: int, lo: int) -> bool:
    """Whether the word at ``at`` stands between quotation marks, or after a reporting word, within the window; ``words[0]`` is word ``lo``."""
    i = at - lo
    opened = next((w for w in reversed(words[: i + 1]) if w.startswith(_OPENING) or w.endswith(_CLOSING) and w is not words[i]), "")
    closed = next((w for w in words[i:] if w.rstrip(".,;:!?").endswith(_CLOSING) or w.startswith(_OPENING) and w is not words[i]), "")
    if opened.startswith(_OPENING) and closed.rstrip(".,;:!?").endswith(_CLOSING):
        return True
    return any(plain(w) in REPORTING for w in words[max(0, i - 4): i])


def misspelled(word: str, at: int) -> str:
    """The word with one edit behind its first letter: a letter twice, left out, or exchanged with the next."""
    i = 1 + zlib.crc32(word.encode()) % max(1, at - 2)
    return (word[:i] + word[i] + word[i:], word[:i] + word[i + 1:], word[:i] + word[i + 1:i + 2] + word[i] + word[i + 2:])[zlib.crc32(word.encode()) // 7 % 3]


#: What is learned of a text: its exact hits, its misspelled ones, and its words.
COUNTS = 3


class ToxicityModel:
    """``terms`` are whole words; those in ``stems`` also stand for every word that begins with them; ``strict`` ones are not matched with
    edits, ``closed`` stems with edits only as whole words, and words in ``clean`` are no misspellings.

    ``weights`` are of the hits' strength, of its share of the words, and constant; a misspelled hit counts ``discount``.
    """

    def __init__(self, terms: list[str], weights: np.ndarray | None = None, stems: frozenset[str] = frozenset(), strict: frozenset[str] = frozenset(), clean: frozenset[str] = frozenset(), closed: frozenset[str] = frozenset(), discount: float = 1.0):
        self.terms, self.weights, self.stems, self.strict, self.clean, self.closed, self.discount = terms, weights, stems, strict, clean, closed, discount
        self.shortest, self.longest = (min(map(len, stems)), max(map(len, stems))) if stems else (1, 0)
        self._trie: LevenshteinTrie | None = None
        self._known: dict[int, tuple[int, int] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": None, "_known": {}}

    def _prepare(self) -> None:
        self._trie, self._at = LevenshteinTrie(self.terms, self.strict), {t: i for i, t in enumerate(self.terms)}
        self._open = frozenset(self._at[t] for t in self.stems - self.closed)

    def near_words(self, text: bytes) -> set[tuple[int, str]]:
        """(term, word) of the words of a text that are a term with edits."""
        if self._trie is None:
            self._prepare()
        words = {plain(w) for w in text.decode("utf-8", "replace").split()}
        return {(hit[0], w) for w in words if (hit := self.find(w)) is not None and hit[1] > 0}

    def planted(self, text: bytes) -> tuple[bytes, bytes] | None:
        """The text with its exact hits misspelled, and with them quoted; None if it has none that edits could match."""
        if self._trie is None:
            self._prepare()
        wrong, cited, found = [], [], False
        for w in text.decode("utf-8", "replace").split():
            hit = self.find(plain(w))
            if hit is None or hit[1]:
                wrong.append(w)
                cited.append(w)
                continue
            term = self.terms[hit[0]]
            if self._trie.edits[hit[0]]:
                found = True
                wrong.append(misspelled(plain(w), len(term)))
            cited.append(f'"{plain(w)}"')
        return (" ".join(wrong).encode(), " ".join(cited).encode()) if found else None

    def find(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of a word: a stem at its beginning, or else the best whole term within the edits that its length allows."""
        for n in range(self.shortest, min(self.longest, len(word)) + 1):
            if word[:n] in self.stems:
                return self._at[word[:n]], 0
        hit = self._trie.find(word, self._open)
        return None if hit is not None and hit[1] and word in self.clean else hit

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """By text: exact hits, misspelled hits (quoted ones of both count QUOTED_WEIGHT), and words."""
        if self._trie is None:
            self._prepare()
        out = np.zeros((len(texts), COUNTS))
        w = Words(texts, fold=True)
        fresh, first, index = np.unique(w.h, return_index=True, return_inverse=True)
        kinds = np.zeros(len(fresh), np.int8)
        raw = w.buf.tobytes() if len(fresh) else b""
        if len(self._known) > MEMORY:
            self._known = {}
        for j, (h, i) in enumerate(zip(fresh.tolist(), first.tolist())):
            hit = self._known.get(h, 0)
            if hit == 0:
                hit = self.find(plain(raw[w.start[i]:w.end[i]].decode("utf-8", "replace")))
                self._known[h] = hit
            if hit is not None:
                kinds[j] = 1 if hit[1] == 0 else 2
        if len(fresh) and kinds.any():
            kind = kinds[index]
            for i in np.flatnonzero(kind):
                row = int(np.searchsorted(w.off, i, "right")) - 1
                lo, hi = max(int(w.off[row]), i - WINDOW), min(int(w.off[row + 1]), i + WINDOW + 1)
                near = [raw[w.start[x]:w.end[x]].decode("utf-8", "replace") for x in range(lo, hi)]
                out[row, kind[i] - 1] += QUOTED_WEIGHT if quoted(near, i, lo) else 1.0
        out[:, 2] = w.counts()
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(strengths(self.counts(texts), self.discount) @ self.weights[:-1] + self.weights[-1])))


def strengths(counts: np.ndarray, discount: float) -> np.ndarray:
    """The hits of texts, and their share per 100 words, each as log(1 + x)."""
    hits = counts[:, 0] + discount * counts[:, 1]
    return np.log1p(np.column_stack([hits, hits * 100 / np.maximum(counts[:, 2], 20)]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients and, last, the constant; and the loss.  A hit never speaks against toxicity."""
    form = ridge * np.diag([1.0] * x.shape[1] + [0.0])
    prior = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.1
    w = np.append(np.full(x.shape[1], 0.1), math.log(prior / (1 - prior)))
    z = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(400 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = p * (1 - p) + 1e-4
        h = z.T @ (z * s[:, None]) / len(y) + form + 1e-9 * np.eye(len(w))
        g = z.T @ (p - y) / len(y) + form @ w
        new = w - 0.5 * np.linalg.solve(h, g)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    t = np.clip(z @ w, -30, 30)
    return w, float(np.mean(np.logaddexp(0, t) - y * t)) if len(y) else 0.0


def _copy_mark(words: list[str]) -> int:
    """The least hash of a text's word pairs: near copies of a text mostly have the same."""
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])), default=zlib.crc32(" ".join(words).encode()))


def _evidence(a: Column, b: Column, bad: float, good: float) -> Column:
    """Log-likelihood ratio of a and b events in bad and good documents against one common rate."""
    rate = (a + b) / F.lit(bad + good)
    part = lambda x, n: F.when(x > 0, x * F.log(x / (rate * n))).otherwise(0.0)
    return 2 * (part(a, F.lit(bad)) + part(b, F.lit(good)))


def learned_terms(rows: DataFrame, support: int = SUPPORT, ratio: float = RATIO, evidence: float = EVIDENCE) -> tuple[list[str], list[str]]:
    """Whole words and stems from training rows (doc_id, text, label).

    An occurrence is counted by its context, the word with the words beside it, and a document by the least hash of its word pairs, so
    copies of one text count once.  A stem is taken at its longest form that has nearly all of its occurrences, and only
    if two different words with it are; it then stands for all words that begin with it.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, context, toxic, mark = [], [], [], []
            for t, y in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                own = [x for x in (plain(x) for x in re.split(r"[\x20\x09-\x0D]+", t.decode("utf-8", "replace"))) if x]
                found = {(w, zlib.crc32(f"{a} {b}".encode())) for a, w, b in zip(["", *own], own, [*own[1:], ""])}
                word += [x[0] for x in found]
                context += [x[1] for x in found]
                toxic += [y > 0.5] * len(found)
                mark += [_copy_mark(own)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(context, pa.int64()), pa.array(toxic, pa.bool_()), pa.array(mark, pa.int64())], ["word", "context", "toxic", "mark"])

    sizes = {bool(r[0]): r[1] for r in rows.groupBy((F.col("label") > 0.5).alias("toxic")).count().collect()}
    bad, good = float(sizes.get(True, 0)), float(sizes.get(False, 0))
    if not bad or not good:
        return [], []
    seen = stored(rows.mapInArrow(contexts, "word string, context bigint, toxic boolean, mark bigint").groupBy("word", "context", "toxic").agg(F.min("mark").alias("mark")), "toxicity-contexts")
    count = lambda c: F.sum(c.cast("long"))
    counted = seen.groupBy("word").agg(count(F.col("toxic")).alias("a"), count(~F.col("toxic")).alias("b"))
    stem = F.explode(F.transform(F.sequence(F.lit(STEM), F.least(F.length("word"), F.lit(LONGEST))), lambda n: F.substring("word", F.lit(1), n)))
    long = F.length("word") >= STEM
    # documents by term, of toxic rows only; (term, whole): a word by itself, or as a stem
    ill = seen.where("toxic").select("word", "mark").distinct()
    docs = ill.select(F.col("word").alias("term"), F.lit(True).alias("whole"), "mark").unionByName(ill.where(long).select(stem.alias("term"), F.lit(False).alias("whole"), "mark"))
    docs = docs.groupBy("term", "whole").agg(F.count_distinct("mark").alias("docs")).where(F.col("docs") >= support)
    terms = counted.select(F.col("word").alias("term"), F.lit(True).alias("whole"), "a", "b").unionByName(counted.where(long).select(stem.alias("term"), F.lit(False).alias("whole"), "a", "b"))
    terms = terms.groupBy("term", "whole").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("words"))
    share = (F.col("a") + 0.5) / (bad + 1), (F.col("b") + 0.5) / (good + 1)
    passing = terms.join(docs, ["term", "whole"]).where((share[0] > ratio * share[1]) & (_evidence(F.col("a"), F.col("b"), bad, good) > evidence))
    got = passing.collect()  # at most the words and prefixes that some training documents share
    discard(seen)
    words = sorted(r.term for r in got if r.whole)
    found = {r.term: r.a for r in got if not r.whole and r.words > 1}
    best: dict[str, int] = {}  # of each stem, the largest count of a longer one
    for t, a in found.items():
        for n in range(STEM, len(t)):
            best[t[:n]] = max(best.get(t[:n], 0), a)
    stems: set[str] = set()
    for t in sorted((t for t, a in found.items() if best.get(t, 0) < 0.95 * a), key=lambda t: (len(t), t)):
        if not any(t[:n] in stems for n in range(STEM, len(t))):
            stems.add(t)
    words = [w for w in words if not any(w[:n] in stems for n in range(STEM, len(w)))]
    return words, sorted(stems)


def _ambiguous(rows: DataFrame, model: ToxicityModel) -> tuple[frozenset[str], frozenset[str]]:
    """(terms, words) by the clean training documents: words of two of them or more that are near a term are words of their own; terms
    are ambiguous if other near words hit over one document in CLEAN, and more than one.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for t in as_bytes(batch.column(0)) for x in model.near_words(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["term", "word"])

    clean = rows.where("label <= 0.5")
    most = max(1, clean.count() / CLEAN)
    got = stored(clean.select("text").mapInArrow(near, "term bigint, word string").groupBy("term", "word").count(), "toxicity-near")
    words = frozenset(r.word for r in got.where("count > 1").select("word").distinct().collect())  # words of the training rows near a term
    strict = got.where("count = 1").groupBy("term").count().where(F.col("count") > most).collect()  # a row a term at most
    discard(got)
    return frozenset(model.terms[r.term] for r in strict), words


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, lexicon: list[str] | None = None, **settings: float) -> ToxicityModel:
    """Learns from at most about ``most`` labelled documents whose crc32 remainder modulo 3 is not 1.

    Of rows that repeat a doc_id, the least text counts.  ``lexicon`` gives further whole terms; ``settings`` are
    those of ``learned_terms``.  Without toxic or without clean training rows, no term is learned.
    """
    prepare(docs.sparkSession)
    sample = sampled_labels(labels, "toxic", 3, 1, most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    rows = stored(rows, "toxicity-training")
    words, stems = learned_terms(rows, **settings)
    terms = sorted({*words, *stems} | {plain(x) for x in lexicon or [] if plain(x)})
    stems = frozenset(stems)
    closed, clean = _ambiguous(rows, ToxicityModel(terms, stems=stems))
    strict, more = _ambiguous(rows, ToxicityModel(terms, stems=stems, clean=clean, closed=closed))
    model = ToxicityModel(terms, stems=stems, strict=strict, clean=clean | more, closed=closed)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of training texts and, of toxic ones, of their planted forms."""
        for batch in batches:
            texts, labels = as_bytes(batch.column(1)), batch.column(2).to_pylist()
            for t, y in zip(list(texts), list(labels)):
                forms = model.planted(t) if y > 0.5 else None
                texts += forms or ()
                labels += (1.0, 0.0) if forms else ()
            x = np.vstack([np.empty((0, COUNTS)), *[model.counts(texts[lo:hi]) for lo, hi in blocks(texts)]])
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.float64()), *[pa.array(x[:, i]) for i in range(COUNTS)]], ["label", *[f"x{i}" for i in range(COUNTS)]])

    got = sorted(map(tuple, rows.mapInArrow(counts, "label double, " + ", ".join(f"x{i} double" for i in range(COUNTS))).collect()))  # three rows a training row at most
    discard(rows)
    x, y = np.array([r[1:] for r in got]).reshape(-1, COUNTS), np.array([r[0] for r in got])
    fits = [(loss, d, w) for d in DISCOUNTS for w, loss in [logistic(strengths(x, d), y)]]
    _, model.discount, model.weights = min(fits, key=lambda f: f[:2])
    return model


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Null and empty texts have no hits and get the model's lowest score.  Repeated rows get equal
    values; other columns of ``docs`` are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            p = np.concatenate([np.empty(0), *[model.scores(texts[lo:hi]) for lo, hi in blocks(texts)]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
