"""Toxicity scores from a learned lexicon, matched with typing errors and weighed by context.

The lexicon is learned: words, and beginnings of words that take many endings, which labelled
toxic texts have and others lack.  Its entries form a trie.  A Levenshtein automaton for each
token of a text runs along the trie, so one walk finds every entry within one error of the
token (beginnings must match exactly, or they would match too much).  Walks are remembered
per worker, so a frequent token costs one look-up.

A match counts by its weight, less if it has an error, and less if its context quotes it:
quotation marks around it, or words of reporting or of speaking about words within
``WINDOW`` tokens.  A small logistic model over the document's sums, fitted on the same
labelled sample, turns them into a score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sealtrail.llm.sampling import remainder, smallest_hashes

#: Bounds of the fit: labelled documents of each class, and entries of the lexicon.
SAMPLE = 3_000
ENTRIES = 2_000
#: A candidate entry needs so many toxic documents, at least, and this log-likelihood ratio
#: (which chance alone exceeds in one of a thousand terms).
LEAST_DOCS, LEAST_SURPRISE = 5, 10.83
#: and must be so many times as frequent in them as in others.
LEAST_RATIO = 5
STEMS = (4, 5, 6, 7)
#: Entries at least this long match with one error.
FUZZY_FROM = 5
#: Tokens on either side that are a match's context, and what a quoted match counts.
WINDOW = 6
QUOTED = 0.35
THRESHOLD = 0.7
#: Tokens and automaton states that a worker remembers.
REMEMBERED = 300_000
MOST_STATES = 100_000

_MARKS = "\"'«»„“”‚‘’‹›"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Scripts written without blanks between words; their terms are pairs of neighbouring letters.
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_TOKEN = rf"[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+"
_PAIR = rf"(?=([{_UNSPACED}][{_UNSPACED}]))"
_RUNS = re.compile(rf"[^\W_{_UNSPACED}]+|[{_UNSPACED}]")
_UNSPACED_LETTER = re.compile(rf"[{_UNSPACED}]")
#: Words around a match that speak of it as a word or as someone else's.
REPORTING = frozenset(
    "said says say wrote writes quote quoted quotes called calls word words term terms slur insult insults means "
    "meaning reported alleged sagte schrieb zitat wort begriff dit écrit citation mot mots dijo escribió cita palabra".split()
)


class Automaton:
    """The lexicon's trie intersected with the Levenshtein automaton of any token.

    A state is a set of (trie node, errors so far).  Tokens share states, so transitions are
    made once and remembered; most tokens die after a few letters.  An entry that ends in
    ``*`` matches beginnings, without errors.
    """

    def __init__(self, entries: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.words: dict[int, int] = {}
        self.stems: dict[int, int] = {}
        for i, entry in enumerate(entries):
            node = 0
            for c in entry.rstrip("*"):
                if c not in self.children[node]:
                    self.children.append({})
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
            (self.stems if entry.endswith("*") else self.words)[node] = i
        self.fuzzy = {i for i, entry in enumerate(entries) if len(entry) >= FUZZY_FROM}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, items: set[tuple[int, int]]) -> int:
        """The state of these items and of what a missing letter leads to; -1 if it is dead."""
        if not items:
            return -1
        closed = frozenset(items | {(child, 1) for node, errors in items if not errors for child in self.children[node].values()})
        if closed not in self.ids:
            self.ids[closed] = len(self.states)
            self.states.append(closed)
            self.steps.append({})
        return self.ids[closed]

    def _step(self, state: int, letter: str) -> int:
        reached = set()
        for node, errors in self.states[state]:
            if letter in self.children[node]:
                reached.add((self.children[node][letter], errors))
            if not errors:
                reached.add((node, 1))  # a letter too many
                reached.update((child, 1) for child in self.children[node].values())  # another letter
        self.steps[state][letter] = nxt = self._state(reached)
        return nxt

    def best(self, token: str) -> tuple[int, int] | None:
        """(entry, errors) nearest to ``token``; of equally near ones whole words win."""
        if len(self.states) > MOST_STATES:
            self.reset()
        state, node, stem = self.start, 0, None
        for letter in token:
            node = self.children[node].get(letter) if node is not None else None
            if node is None and stem is None and state < 0:
                return None
            stem = self.stems.get(node, stem)
            if state >= 0:
                nxt = self.steps[state].get(letter)
                state = self._step(state, letter) if nxt is None else nxt
        ends = [
            (errors, self.words[at])
            for at, errors in (self.states[state] if state >= 0 else ())
            if at in self.words and (not errors or self.words[at] in self.fuzzy)
        ]
        nearest = min(ends, default=None)
        if stem is not None and (nearest is None or nearest[0]):
            return stem, 0
        return (nearest[1], nearest[0]) if nearest else None


@dataclass
class ToxicityModel:
    entries: list[str]
    weights: list[float]
    coefficients: list[float] = field(default_factory=lambda: [0.0] * 5)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """Finds the lexicon in texts; remembers what tokens matched."""

    def __init__(self, model: ToxicityModel):
        self.model, self.automaton, self.known = model, Automaton(model.entries), {}

    def _match(self, token: str) -> tuple[int, int] | None:
        return self.automaton.best(token)

    def features(self, text: str | None) -> list[float]:
        """[1, sum of exact matches, of inexact ones, different entries, share of tokens]."""
        tokens, words = _tokens(text)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for token in set(tokens):
            if token not in known:
                known[token] = self._match(token)
        plain = erring = 0.0
        kinds, matches = set(), 0
        for i, match in enumerate(map(known.__getitem__, tokens)):
            if match is None:
                continue
            entry, errors = match
            weight = self.model.weights[entry]
            kinds.add(entry)
            matches += 1
            if _quotation(*words, i):
                weight *= QUOTED
            if errors:
                erring += weight
            else:
                plain += weight
        return [
            1.0,
            math.log1p(plain),
            math.log1p(erring),
            math.log1p(len(kinds)),
            math.log1p(100.0 * matches / max(len(tokens), 1)),
        ]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.model.coefficients, self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def _tokens(text: str | None) -> tuple[list[str], tuple[list[str], list[int]]]:
    """Tokens as in learning, and the blank-separated words with the number of each token's."""
    words = text.lower().split() if text else []
    tokens, at = [], []
    for i, word in enumerate(words):
        if word.isascii() and word.isalnum():
            tokens.append(word)
            at.append(i)
            continue
        end, last = -1, ""
        for run in _RUNS.finditer(word):
            core = run[0]
            if not _UNSPACED_LETTER.match(core):
                tokens.append(core)
                at.append(i)
            elif end == run.start() and _UNSPACED_LETTER.match(last):
                tokens.append(last + core)
                at.append(i)
            end, last = run.end(), core
    return tokens, (words, at)


def _quotation(words: list[str], at: list[int], token: int) -> bool:
    """Whether a token's word stands between quotation marks or is spoken about."""
    i = at[token]
    near = range(max(0, i - WINDOW), min(len(words), i + WINDOW + 1))
    opened = any(words[j][0] in _MARKS for j in near if j <= i)
    closed = any(words[j].rstrip(".,;:!?")[-1:] in _MARKS and words[j].rstrip(".,;:!?") for j in near if j >= i)
    return (opened and closed) or any(_EDGES.sub("", words[j]) in REPORTING for j in near if j != i)


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, fold: int) -> DataFrame:
    """(id, text, toxic) of the training sample: at most ``SAMPLE`` documents of each class."""
    known = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).alias("toxic"))
        .where((remainder(F.col("id"), fold) != 1) & F.col("toxic").isin(0, 1))
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    samples = []
    for value in (0, 1):
        ids = smallest_hashes(known.where(F.col("toxic") == value), "id", SAMPLE)
        samples.append(texts.join(F.broadcast(ids), "id").withColumn("toxic", F.lit(value)))
    return samples[0].unionByName(samples[1])


def _beginnings(k: int):
    return F.transform(F.filter("w", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))


def _surprise(bad: int, good: int):
    """Log-likelihood ratio (G) of a term's documents against an even share of both classes."""
    def part(seen, of):
        return F.when(seen > 0, seen * F.log(seen * float(bad + good) / ((F.col("bad") + F.col("good")) * float(max(of, 1))))).otherwise(0.0)

    return 2 * (part(F.col("bad"), bad) + part(F.col("good"), good))


def learn_lexicon(sample: DataFrame) -> ToxicityModel:
    """Words and beginnings of words that toxic documents of the sample have and others lack.

    Weights are smoothed log odds of document frequencies.  Entries are taken by weight times
    toxic documents, beginnings at a discount; one that a beginning taken before covers, or
    that is a beginning of one taken before, is left out.  Copies of a text count once.
    """
    of = sample.groupBy().agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    ).first()
    bad, good = of["bad"] or 0, of["good"] or 0
    runs = F.regexp_extract_all(F.lower("text"), F.lit(_TOKEN), F.lit(0))
    words = F.array_distinct(F.concat(runs, F.regexp_extract_all(F.lower("text"), F.lit(_PAIR), F.lit(1))))
    stems = [_beginnings(k) for k in STEMS]
    counts = (
        sample.select("toxic", words.alias("w"))
        .select("toxic", F.explode(F.array_distinct(F.concat("w", *stems))).alias("term"))
        .groupBy("term")
        .agg(F.sum("toxic").cast("long").alias("bad"), F.sum(1 - F.col("toxic")).cast("long").alias("good"))
        .where((F.col("bad") >= LEAST_DOCS) & (_surprise(bad, good) >= LEAST_SURPRISE))
        .where(F.col("good") * max(bad, 1) * LEAST_RATIO <= F.col("bad") * max(good, 1))
    )
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    gain = F.col("bad") * F.col("odds") * F.when(F.col("term").endswith("*"), 0.9).otherwise(1.0)
    ranked = counts.withColumn("odds", odds).orderBy(gain.desc(), F.length("term").desc(), "term")
    kept: dict[str, float] = {}
    for row in ranked.limit(ENTRIES).collect():
        term = row["term"]
        covered = any(k.endswith("*") and term.startswith(k[:-1]) for k in kept)
        covers = term.endswith("*") and any(k.startswith(term[:-1]) for k in kept)
        if not covered and not covers:
            kept[term] = row["odds"]
    return ToxicityModel(list(kept), list(kept.values()))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fold: int = 3) -> ToxicityModel:
    """A model from labelled rows whose ``crc32(id) mod fold`` is not 1.

    Rows without id, text or a label of 0 or 1 teach nothing; of several labels of one id the
    highest counts.  Without examples of both classes every score is one half.
    """
    sample = _labelled(docs, labels, doc_id, text, label, fold).dropDuplicates(["text"])
    model = learn_lexicon(sample)
    shipped = sample.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = shipped.value.matcher()
        for texts in batches:
            yield texts.map(matcher.features)

    rows = sample.select("toxic", features("text").alias("x")).limit(4 * SAMPLE).collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    if len(set(y)) == 2:
        model.coefficients = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression with balanced classes, by Newton steps."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    beta, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.3] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - ridge @ beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta.tolist()


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``out`` from 0 to 1; null and empty texts have no match.

    Every row and column stays; a column named ``out`` is replaced.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = shipped.value.matcher()
        for texts in batches:
            yield pd.Series([matcher.score(t) for t in texts], dtype="float64")

    return docs.withColumn(out, scored(F.col(f"`{text}`")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"),
    )
