"""Operator 5: toxicity from a learned lexicon, Levenshtein automata and context windows.

*Lexicon.* On the labelled training rows (at most ``max_labelled``, the ones of smallest
hash; a documented bound; of rows with one label whose texts differ in case and white space only, one)
words and word stems are kept whose documents are toxic far more
often than the rest, by a likelihood-ratio test. Terms have three letters at least and any length; how
many there are is bounded by what ``max_labelled`` rows can hold. They form a trie; a stem
accepts any ending.

*Automata.* Each distinct document word becomes a Levenshtein automaton (bit-parallel, with
one edit from five letters on, two from nine) that is intersected with the trie: the walk follows only trie
edges on which the automaton is alive, so misspelled terms are found without comparing the
word with every term; of the trie only the terms are walked that have a part intact in the
word (halves for one edit, thirds for two), most words have none.
Results are memoised per word, in a bounded memo.

*Context.* Every hit gets a window score from the words and marks around it: quotation marks
that enclose it and reporting words make it quotation; address to a reader, exclamation
and further hits nearby make it abuse. Per document, abuse, quotation and misspelled
weight, density and variety of terms feed a logistic model fitted on the same rows.

Labels, lang, source and doc_id are never inputs of a score. Defined results: null and
empty texts have no hits and get the model's score for that; without labelled rows of both
kinds the lexicon is empty and every score is the share of toxic labels (0 without any).
Rows that repeat an id are scored alike; null ids are not learned from.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunked import forget
from .common import read, stage, text_of
from .textkernel import blocks

MAX_LABELLED = 40_000
#: Stem lengths tried, least documents of a term, least likelihood ratio.
STEMS, LEAST_DOCS, LEAST_RATIO = (4, 5, 6, 7, 8), 5, 30.0
WINDOW = 12
_WORD = re.compile(r"[^\W\d_]+")
# Words that report speech, and words that address someone (en, fr, de, es).
REPORTING = frozenset("said says called calls word words term quote quoted quotes wrote writes insult insults reported mot mots terme citation dit disait appelle wort worte begriff zitat sagte sagt nannte palabra palabras termino cita dijo dice llamó".split())
ADDRESS = frozenset("you your yours youre u ur are shut go tu toi vous votre ton ta du dich dir dein ihr euch sie tú te ti vosotros usted eres".split())
_OPENING, _CLOSING = "\"“«„'‘‹", "\"”»“'’›"
FEATURES = 6


def errors_allowed(n: int) -> int:
    """Edits tolerated in a term of n letters."""
    return 0 if n < 5 else 1 if n < 9 else 2


class LexiconTrie:
    """Terms with weights in a trie; a stem (``open_end``) accepts any ending."""

    def __init__(self, terms: dict[str, tuple[float, bool]]):
        #: With two edits, no term can reach further into a word.
        self.reach = max(map(len, terms), default=0) + 2
        self.children: list[dict[str, int]] = [{}]
        self.entry: list[tuple[float, bool, int] | None] = [None]
        #: The terms below each node, as bits.
        self.below: list[int] = [0]
        for bit, (term, (weight, open_end)) in enumerate(sorted(terms.items())):
            at = 0
            for c in term:
                nxt = self.children[at].get(c)
                if nxt is None:
                    nxt = self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.entry.append(None)
                    self.below.append(0)
                at = nxt
                self.below[at] |= 1 << bit
            self.entry[at] = (weight, open_end, len(term))
        self._parts(terms)

    def _parts(self, terms: dict[str, tuple[float, bool]]) -> None:
        """Parts of the terms, one more than their edits: one of them is intact in the word.

        A part is moved by the edits before it at most; the last of a closed term is looked
        for from the word's end.
        """
        parts: dict[tuple[int, int], dict[str, int]] = {}
        tails: dict[int, dict[str, int]] = {}
        for bit, (term, (_, open_end)) in enumerate(sorted(terms.items())):
            edits = errors_allowed(len(term) - 1 if open_end else len(term))
            cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
            for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if i == edits and i and not open_end:
                    places = [tails.setdefault(hi - lo, {})]
                else:
                    moved = edits if i else 0
                    places = [parts.setdefault((at, at + hi - lo), {}) for at in range(max(0, lo - moved), lo + moved + 1)]
                for found in places:
                    found[term[lo:hi]] = found.get(term[lo:hi], 0) | 1 << bit
        self.parts = [(lo, hi, found.get) for (lo, hi), found in parts.items()]
        self.tails = [(-n, found.get) for n, found in tails.items()]

    def possible(self, word: str) -> int:
        """The terms, as bits, that have a part intact in the word; no other can match it."""
        out = 0
        for lo, hi, get in self.parts:
            out |= get(word[lo:hi], 0)
        for lo, get in self.tails:
            out |= get(word[lo:], 0)
        return out

    def match(self, word: str, among: int = -1) -> tuple[float, int] | None:
        """(weight, edits) of the best entry the word's automaton accepts; fewest edits win.
        Only the trie over the terms ``among`` (bits) is walked.

        State after a trie path: for each number of errors e the set of word positions
        (as bits) reachable with e edits. Closed terms need the last position; stems any.
        """
        limit = errors_allowed(len(word))
        word = word[: self.reach + 1]  # only a stem can match a longer word, within its own reach
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        full, last = (1 << (n + 1)) - 1, 1 << n
        start = [1]
        for _ in range(limit):  # skipping letters of the word
            start.append((start[-1] << 1 | start[-1]) & full)
        best: tuple[int, float] | None = None
        stack = [(0, start)]
        while stack:
            node, state = stack.pop()
            entry = self.entry[node]
            if entry is not None:
                weight, open_end, size = entry
                for e, s in enumerate(state):
                    if e <= errors_allowed(size - 1 if open_end else size) and (s and open_end or s & last):
                        if best is None or (e, -weight) < best:
                            best = (e, -weight)
                        break
            branches = self.children[node]
            if not any(state[:-1]):  # no edit is left: only the word's own next letters go on
                left, nexts = state[-1], {}
                while left:
                    low = left & -left
                    left ^= low
                    c = word[low.bit_length() - 1 : low.bit_length()]
                    if c in branches:
                        nexts[c] = branches[c]
                branches = nexts
            for c, child in branches.items():
                if not self.below[child] & among:
                    continue
                mask, after, below = masks.get(c, 0), [], 0
                for e, s in enumerate(state):
                    t = (s & mask) << 1
                    if e:
                        p = state[e - 1]
                        t |= p | p << 1 | below << 1  # term letter added, replaced; word letter skipped
                    below = t & full
                    after.append(below)
                if after[-1]:
                    stack.append((child, after))
        return None if best is None else (-best[1], best[0])


@dataclass
class Model:
    """What scoring needs; small whatever the corpus: a bounded lexicon and a few weights."""

    terms: dict[str, tuple[float, bool]]
    weights: list[float]
    _trie: LexiconTrie | None = field(default=None, repr=False, compare=False)
    _memo: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "_trie": None, "_memo": {}}

    def hits(self, distinct: set[str]) -> dict[str, tuple[float, int]]:
        """The words that match an entry."""
        if not self.terms:
            return {}
        if self._trie is None:
            self._trie = LexiconTrie(self.terms)
        memo = self._memo
        if len(memo) > 300_000:
            memo.clear()
        for word in distinct.difference(memo):
            memo[word] = self._trie.match(word, among) if len(word) >= 3 and (among := self._trie.possible(word)) else None
        return {w: m for w in distinct if (m := memo[w]) is not None}

    def features(self, text: str) -> list[float]:
        low = text.lower()
        found = self.hits(set(_WORD.findall(low)))
        return context_features(low, found) if found else [0.0] * FEATURES

    def score(self, x: np.ndarray) -> np.ndarray:
        w = np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(x @ w[1:] + w[0], -30, 30)))


def quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks enclose the span within its line, a few words away at most."""
    left, right = text[max(0, start - 80) : start], text[end : end + 80]
    left, right = left[left.rfind("\n") + 1 :], right.split("\n", 1)[0]
    for a, b in zip(_OPENING, _CLOSING, strict=True):
        if a == b:
            if left.count(a) % 2 and b in right and (a == '"' or left[-1:] == a):
                return True
        elif a in left and left.rfind(a) > left.rfind(b) and b in right:
            return True
    return False


def context_features(low: str, found: dict[str, tuple[float, int]]) -> list[float]:
    """Abuse, quotation and misspelled weight, density, variety, strongest window."""
    spans = [(m.start(), m.end(), m.group()) for m in _WORD.finditer(low)]
    at = [i for i, s in enumerate(spans) if s[2] in found]
    abuse = quote = bent = strongest = 0.0
    for k, i in enumerate(at):
        start, end, word = spans[i]
        weight, edits = found[word]
        near = [s[2] for s in spans[max(0, i - WINDOW) : i] + spans[i + 1 : i + 1 + WINDOW]]
        q = 2.0 * quoted(low, start, end) + 1.0 * any(w in REPORTING for w in near)
        a = 1.0 + 0.5 * any(w in ADDRESS for w in near) + 0.5 * ("!" in low[end : end + 3])
        a += 0.5 * (k > 0 and i - at[k - 1] <= WINDOW) + 0.5 * (k + 1 < len(at) and at[k + 1] - i <= WINDOW)
        share = a / (a + q * a) if q else 1.0
        if edits:
            bent += weight * share
        else:
            abuse += weight * share
            quote += weight * (1 - share)
        strongest = max(strongest, weight * share * (0.5 if edits else 1.0))
    return [math.log1p(abuse), math.log1p(quote), math.log1p(bent), math.log1p(100 * len(at) / max(1, len(spans))), math.log1p(len({spans[i][2] for i in at})), math.log1p(strongest)]


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fifth, at most ``max_labelled``."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id").select("text", "toxic")  # max_labelled small rows at most

    # Copies would pass off the words of one text as frequent: of each text and label one row counts.
    same = F.sha2(F.encode(F.lower(F.regexp_replace("text", r"\s+", " ")), "UTF-8"), 256)
    return rows.groupBy(same.alias("key"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: Words and stems that a task counts at once; more are sent on in parts.
HELD_TERMS = 50_000


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, open_end, toxic, clean): documents that hold each word or stem."""

    def table(sums: dict[tuple[str, bool], list[int]]) -> pa.RecordBatch:
        keys = list(sums)
        return pa.RecordBatch.from_pydict({"term": [k[0] for k in keys], "open_end": [k[1] for k in keys], "toxic": [sums[k][0] for k in keys], "clean": [sums[k][1] for k in keys]})

    def count(batches):
        forget()
        for batch in batches:
            sums: dict[tuple[str, bool], list[int]] = {}
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found = {w for w in _WORD.findall(text.as_py().lower()) if len(w) >= 3}
                terms = {(w, False) for w in found} | {(w[:n], True) for w in found for n in STEMS if len(w) >= n}
                positive = toxic.as_py()
                for t in terms:
                    sums.setdefault(t, [0, 0])[0 if positive else 1] += 1
                if len(sums) > HELD_TERMS:  # the groups below add up what is sent in parts
                    yield table(sums)
                    sums = {}
            if sums:
                yield table(sums)

    counted = rows.mapInArrow(count, "term string, open_end boolean, toxic long, clean long")
    return counted.groupBy("term", "open_end").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def likelihood_ratio(toxic: F.Column, clean: F.Column, n_toxic: int, n_clean: int) -> F.Column:
    """G^2 of a term's 2x2 table of documents."""
    n = float(n_toxic + n_clean)
    held = toxic + clean

    def part(seen: F.Column, rate: F.Column) -> F.Column:
        return F.when(seen > 0, seen * F.log(seen / rate)).otherwise(F.lit(0.0))

    return 2 * (
        part(toxic, held * n_toxic / n) + part(clean, held * n_clean / n)
        + part(n_toxic - toxic, (n - held) * n_toxic / n) + part(n_clean - clean, (n - held) * n_clean / n)
    )


def choose_terms(rows: list, most: int | None = None) -> dict[str, tuple[float, bool]]:
    """The longest form that explains a term's documents, and no term twice.

    A stem gives way to a longer stem, or to a word, that holds five sixths of its toxic
    documents; what a remaining shorter stem covers is left out. If ``most`` is given, that many
    of what remains stay, of largest likelihood ratio.
    """
    best: dict[str, int] = {}
    for r in rows:
        for n in range(4, len(r.term) + (not r.open_end)):
            best[r.term[:n]] = max(best.get(r.term[:n], 0), r.toxic)
    terms: dict[str, tuple[float, bool]] = {}
    for r in sorted(rows, key=lambda r: (len(r.term), not r.open_end, r.term)):
        covered = any(terms.get(r.term[:n], (0, False))[1] for n in range(4, len(r.term) + (not r.open_end)))
        if not covered and not (r.open_end and 6 * best.get(r.term, 0) >= 5 * r.toxic):
            terms[r.term] = (r.weight, r.open_end)
    kept = sorted((r for r in rows if terms.get(r.term) == (r.weight, r.open_end)), key=lambda r: (-r.g2, r.term, r.open_end))
    return {r.term: (r.weight, r.open_end) for r in kept[:most]}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> list[float]:
    """Ridge logistic regression by Newton's method; the first weight is the intercept."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty) + 1e-9 * np.eye(len(w)), z.T @ (p - y) + penalty * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn lexicon and weights from the training rows."""
    rows = stage(training_rows(docs, labels, max_labelled), "labelled")
    n_toxic, n_clean = rows.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)), F.lit(0))).first()
    if not n_toxic or not n_clean:
        base = min(max(n_toxic / max(1, n_toxic + n_clean), 1e-6), 1 - 1e-6)
        return Model({}, [math.log(base / (1 - base))] + [0.0] * FEATURES)
    counts = term_counts(rows).where(f"toxic + clean >= {LEAST_DOCS}")
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (n_clean + 1.0))
    rated = counts.withColumns({"g2": likelihood_ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean), "weight": odds})
    # A term counts only if most of its documents are toxic, whatever the share of toxic rows.
    rated = rated.where(f"g2 >= {LEAST_RATIO} and weight > 0 and toxic >= 4 * clean")
    # At most max_labelled rows hold these words and stems, each LEAST_DOCS of them.
    terms = choose_terms(rated.collect())
    model = Model(terms, [0.0] * (FEATURES + 1))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def featurise(batches):
        for batch in batches:
            x = [shared.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    # At most max_labelled rows of a few numbers.
    seen = rows.mapInArrow(featurise, "x array<double>, y int").collect()
    x, y = np.array([r.x for r in seen]), np.array([float(r.y == 1) for r in seen])
    model.weights = fit_logistic(x, y)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a toxicity score between 0 and 1."""
    docs = docs.drop(out_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        for batch in batches:
            for block in blocks(batch.column(at)):
                x = np.array([shared.value.features(block.text(i).decode()) for i in range(block.n_docs)])
                part = batch.slice(block.first, block.n_docs)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(x))], names=schema.names)

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go.

    The model is learned from the stage's own input. Rows are judged one by one, so null or
    repeated ids and rows change nothing; null and empty texts get the score of a text without
    hits; an empty table gives an empty result.
    """
    name = "__toxicity"
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, out_col=name).where(F.col(name) < 0.5).select(*docs.columns)
