"""Language identification with interpolated Kneser-Ney character models.

A model per language gives the probability of each letter of a word (and of its end) after
the letters before it in the word.  N-grams and contexts are kept as sorted arrays of 64-bit
hashes with values beside them, so a lookup is a binary search and a batch of words is scored
with a few vector operations.  A text gets the language with the lowest cross-entropy per
letter.  Since no context crosses a word, the cost of a word depends on the word alone and is
computed once per distinct word and worker.

Training takes a sample of at most ``SAMPLE`` documents of each language; scoring takes the
whole text of every row and shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sealtrail.llm.batches import at_most, give_back
from sealtrail.llm.sampling import remainder, smallest_hashes

#: Bounds of the fit: training documents of each language, and the letters taken of long ones,
#: which teach only where a language has too few short ones.
SAMPLE = 400
SAMPLE_CHARS = 20_000
#: Rows of an Arrow batch.
BATCH_ROWS = 4_000
#: Most languages a model may have.
LANGUAGES = 200
ORDER = 4
#: Words that a worker remembers the costs of.
REMEMBERED = 300_000
#: Characters of the texts of a batch whose words are held as strings at once, or one text.
PART_CHARS = 500_000

_LETTERS = re.compile(r"[^\W\d_]+")
_END, _START = 1, 2  # code points that no letter has
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xBF58476D1CE4E5B9)


def _encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each between start and end marks, and the words' offsets."""
    joined = "".join(chr(_START) * (ORDER - 1) + w + chr(_END) for w in words)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.array([len(w) + ORDER for w in words], dtype=np.int64)
    return codes, np.concatenate([[0], np.cumsum(lengths)])


def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position (positions below n - 1 are meaningless)."""
    h = np.full(len(codes), n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n - 1, -1, -1):
            moved = np.zeros_like(codes)
            moved[k:] = codes[: len(codes) - k]
            h = (h ^ moved) * _P
            h ^= h >> np.uint64(29)
            h *= _Q
    return h


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), dtype=bool)


@dataclass
class CharModel:
    """Sorted hash arrays by order: discounted n-gram shares, and back-off weights of contexts."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float

    @staticmethod
    def fit(words: list[str], counts: np.ndarray) -> CharModel:
        codes, offsets = _encode(words)
        inside = np.ones(len(codes), dtype=bool)
        for k in range(ORDER - 1):
            inside[offsets[:-1] + k] = False  # start marks are never predicted
        weight = np.repeat(counts.astype(np.float64), np.diff(offsets))[inside]
        grams, contexts, longer = [None] * ORDER, [None] * ORDER, None
        for n in range(ORDER, 0, -1):
            hashed = _hashes(codes, n)[inside]
            before = _hashes(codes[:-1], n - 1) if n > 1 else np.zeros(len(codes) - 1, dtype=np.uint64)
            context = np.concatenate([[np.uint64(0)], before])[inside]
            if longer is None:
                keys, first, inverse = np.unique(hashed, return_index=True, return_inverse=True)
                count = np.bincount(inverse, weight)
            else:  # continuation counts: in how many longer n-grams each occurs
                one = longer
                keys, first, inverse = np.unique(hashed[one], return_index=True, return_inverse=True)
                first = one[first]
                count = np.bincount(inverse).astype(np.float64)
            longer = first
            ones, twos = np.sum(count == 1), np.sum(count == 2)
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            of, member = np.unique(context[first], return_inverse=True)
            total, kinds = np.bincount(member, count), np.bincount(member)
            grams[n - 1] = (keys, np.maximum(count - discount, 0) / total[member])
            contexts[n - 1] = (of, discount * kinds / total)
        return CharModel(grams, contexts, 1.0 / (len(grams[0][0]) + 1000))

    def costs(self, words: list[str]) -> np.ndarray:
        """Negative log probability (nats) of each word with its end."""
        codes, offsets = _encode(words)
        p = np.full(len(codes), self.floor)
        for n in range(1, ORDER + 1):
            keys, shares = self.grams[n - 1]
            at, found = _find(keys, _hashes(codes, n))
            share = np.where(found, shares[at], 0.0)
            if n == 1:
                p = share + self.contexts[0][1][0] * p
                continue
            before = np.concatenate([[np.uint64(0)], _hashes(codes[:-1], n - 1)])
            keys, weights = self.contexts[n - 1]
            at, known = _find(keys, before)
            p = share + np.where(known, weights[at], 1.0) * p
        cost = -np.log(p)
        for k in range(ORDER - 1):
            cost[offsets[:-1] + k] = 0.0
        return np.add.reduceat(cost, offsets[:-1]) if len(words) else np.zeros(0)


@dataclass
class LanguageModels:
    names: list[str]
    models: list[CharModel]
    limits: np.ndarray  # highest believable cross-entropy per letter, by language

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer:
    """Scores texts; remembers words' costs up to a bound."""

    def __init__(self, fitted: LanguageModels):
        self.fitted, self.known, self.table = fitted, {}, np.zeros((0, len(fitted.names)))

    def _costs(self, words: list[str]) -> np.ndarray:
        return np.stack([m.costs(words) for m in self.fitted.models], axis=1)

    def batch(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, cross-entropy, score, rejected) of each text; words are held for ``PART_CHARS`` at once."""
        out, part, chars = [], [], 0
        for text in texts:
            size = len(text) if text else 0
            if part and chars + size > PART_CHARS:
                out += self._part(part)
                part, chars = [], 0
            part.append(text)
            chars += size
        return out + self._part(part)

    def _part(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        split = [_LETTERS.findall(t.lower()) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.table = {}, self.table[:0]
        new = sorted(w for w in set().union(*split) if w not in self.known)
        if new:
            start = len(self.known)
            self.known.update(zip(new, range(start, start + len(new))))
            self.table = np.concatenate([self.table, *(self._costs(new[i : i + 20_000]) for i in range(0, len(new), 20_000))])
        return [self._one(words) for words in split]

    def _one(self, words: list[str]) -> tuple[str, float, float, bool]:
        if not any(c.isalpha() for w in words for c in w):
            return "und", 0.0, 0.0, True
        places = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        letters = sum(map(len, words)) + len(words)
        entropies = self.table[places].sum(axis=0) / letters
        best = int(np.argmin(entropies))
        # how far the others are behind, sharper for longer texts
        score = 1.0 / np.exp((entropies[best] - entropies) * min(letters, 200) ** 0.75).sum()
        # a short text's cross-entropy may lie further from its mean
        rejected = entropies[best] > self.fitted.limits[best] * (1.0 + 6.0 / letters**0.5)
        return self.fitted.names[best], float(entropies[best]), float(score), bool(rejected)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 5) -> LanguageModels | None:
    """Models of the languages in ``docs``, from rows whose ``crc32(id) mod fold`` is not 0.

    Rows without id, text, or language teach nothing.  Of each language at most ``SAMPLE``
    documents are fetched, those with the smallest hashes; documents of over ``SAMPLE_CHARS``
    characters fill up what shorter ones leave open, by their first ``SAMPLE_CHARS``
    characters without what is no letter.  None if nothing is left.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        (remainder(F.col("id"), fold) != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull()
    )
    names = sorted(r[0] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    fitted = {}
    for name in names:
        own = rows.where(F.col("lang") == name)
        short = F.length("text") <= SAMPLE_CHARS
        texts = _sampled(own.where(short), SAMPLE)
        if len(texts) < SAMPLE:
            letters = F.substring(F.regexp_replace("text", r"[^\p{L}]+", " "), 1, SAMPLE_CHARS)
            texts += _sampled(own.where(~short).withColumn("text", letters), SAMPLE - len(texts))
        if model := _fitted(sorted(texts)):
            fitted[name] = model
    if not fitted:
        return None
    return LanguageModels(list(fitted), [m for m, _ in fitted.values()], np.array([x for _, x in fitted.values()]))


def _sampled(own: DataFrame, limit: int) -> list[str]:
    ids = F.broadcast(smallest_hashes(own, "id", limit))
    return [r[0] for r in own.join(ids, "id", "left_semi").select("text").limit(limit).collect()]


def _fitted(texts: list[str]) -> tuple[CharModel, float] | None:
    """A model of all texts, and the cross-entropy above which a text is not of this language.

    The limit comes from texts that a first model has not seen: six standard deviations
    above their mean, 30 % above the worst of them at least.
    """
    def model(of: list[str]) -> CharModel | None:
        counts = Counter(w for t in of for w in _LETTERS.findall(t.lower()))
        return CharModel.fit(list(counts), np.array(list(counts.values()))) if counts else None

    whole, part, rest = model(texts), model(texts[1::4] + texts[2::4] + texts[3::4]), texts[::4]
    if whole is None:
        return None
    seen = []
    for text in rest if part else []:
        words = _LETTERS.findall(text.lower())
        if letters := sum(map(len, words)) + len(words):
            seen.append(part.costs(words).sum() / letters)
    limit = max(np.mean(seen) + 6 * np.std(seen), 1.3 * np.max(seen)) if len(seen) >= 5 else np.inf
    return whole, float(limit)


def identify(
    docs: DataFrame, models: LanguageModels | None, text: str = "text", out: str = "language"
) -> DataFrame:
    """``docs`` with a struct column ``out``: ``lang, cross_entropy, score, rejected``.

    ``lang`` is ``und`` (rejected, score 0) for null texts, texts without a letter, and if
    there are no models.  Of equally cheap languages the first by name wins.  Every row and
    column stays; a column named ``out`` is replaced.
    """
    at_most(docs.sparkSession, BATCH_ROWS)
    shipped = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("lang string, cross_entropy double, score double, rejected boolean")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = shipped.value
        scorer = fitted.scorer() if fitted else None
        for texts in batches:
            rows = scorer.batch(texts.tolist()) if scorer else [("und", 0.0, 0.0, True)] * len(texts)
            yield pd.DataFrame(rows, columns=["lang", "cross_entropy", "score", "rejected"])
        scorer = texts = rows = None
        give_back()

    return docs.withColumn(out, judged(F.col(f"`{text}`")))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.cross_entropy").alias("cross_entropy"),
        F.col("language.rejected").alias("rejected"),
    )
