"""Substring dedup: repeated runs of words found by compacting a De Bruijn graph.

The graph's edges are the windows of ``K`` words, its nodes the ``K - 1`` words two windows
share.  Edges are dealt out by the smallest hash among a window's short runs, so that
neighbouring edges mostly meet in the same bucket.  A bucket finds the edges that several
documents have, and compacts neighbours to paths at once: as long as the document and the
edges' first source both go on by one word, no branch lies between.  The paths of a document
from all buckets are then joined, and each is verified: the words at its source coordinates
must be those at its place, so hashes decide nothing.

What is sent: documents with equal words are one class, of which only the smallest id is
looked at.  Each batch of documents resolves its own repetitions and sends an edge with its
smallest document only, so an edge that very many documents have is a few rows per
batch, not one per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sealtrail.llm.batches import at_most
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.sources.scratch import stored

#: Words in a window, and in the short runs that choose its bucket.
K = 13
SHORT = 3
#: Edges in a bucket (on average), and words of a batch that is resolved at once.
BUCKET = 500_000
BATCH = 800_000
REMEMBERED = 200_000
#: Rows of an Arrow batch: texts, their words and what is kept of them are held at once.
BATCH_ROWS = 2_000
#: Ids (8 bytes each) up to which a selection of documents is broadcast.
MOST_IDS = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_FACT = "doc long, n_words long, seq binary, kept_sha256 string"
_PATH = "doc long, start long, n long, src long, src_start long"


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII blanks, as UTF-8."""
    return text.encode().split() if text else []


def _runs_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` numbers from each place on."""
    out = np.full(len(h) - width + 1, width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ h[k : len(h) - width + 1 + k]) * _ODD
            out = (out ^ (out >> np.uint64(31))) * _MIX
    return out


class _Edges:
    """Windows of a batch of documents; remembers words' hashes up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(edge, bucket hash) of each window of one text."""
        h = self.hashes(words)
        short = _runs_hash(h, SHORT)
        least = short[: len(h) - K + 1].copy()
        for k in range(1, K - SHORT + 1):
            np.minimum(least, short[k : len(h) - K + 1 + k], out=least)
        return _runs_hash(h, K), least


def _paths(doc: np.ndarray, pos: np.ndarray, src: np.ndarray, src_pos: np.ndarray) -> np.ndarray:
    """Rows (doc, start, n, src, src_start): occurrences of edges compacted to paths."""
    if not len(doc):
        return np.zeros((0, 5), dtype=np.int64)
    order = np.lexsort((pos, doc))
    doc, pos, src, src_pos = doc[order], pos[order], src[order], src_pos[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (src[1:] != src[:-1]) | (src_pos[1:] != src_pos[:-1] + 1)
    start = np.flatnonzero(new)
    n = np.diff(np.append(start, len(doc)))
    return np.stack([doc[start], pos[start], n, src[start], src_pos[start]], axis=1)


def _first_sources(edge: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by edge, document and place; for each row in that order the row of its first source."""
    order = np.lexsort((pos, doc, edge))
    e = edge[order]
    new = np.append(True, e[1:] != e[:-1]) if len(e) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, order[first]


def _sent(batch: list[tuple[int, np.ndarray, np.ndarray]], buckets: int) -> pd.DataFrame:
    """One row per bucket: edges of the batch with their first source, and paths known already."""
    edge = np.concatenate([e for _, e, _ in batch])
    least = np.concatenate([b for _, _, b in batch])
    doc = np.repeat(np.array([d for d, _, _ in batch], dtype=np.int64), [len(e) for _, e, _ in batch])
    pos = np.concatenate([np.arange(len(e), dtype=np.int64) for _, e, _ in batch])
    order, source = _first_sources(edge, doc, pos)
    again = doc[order] > doc[source]
    known = _paths(doc[order][again], pos[order][again], doc[source][again], pos[source][again])
    own = np.sort(order[~again])  # every place of the edge in its smallest document
    bucket = (least[own] % np.uint64(buckets)).astype(np.int64)
    own = own[np.argsort(bucket, kind="stable")]
    bucket = np.sort(bucket)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rows = []
    for begin, end in zip(starts, np.append(starts[1:], len(own))):
        part = own[begin:end]
        # differences, which compress to nearly nothing
        docs, places = np.diff(doc[part], prepend=0), np.diff(pos[part], prepend=0)
        paths = known.tobytes() if begin == 0 else b""
        rows.append((int(bucket[begin]), edge[part].tobytes(), docs.tobytes(), places.astype(np.int32).tobytes(), paths))
    return pd.DataFrame(rows, columns=["bucket", "edge", "doc", "pos", "paths"])


def _repeated(rows: pd.DataFrame) -> pd.DataFrame:
    """Paths of one bucket: its edges' occurrences behind their first source, compacted."""
    edge = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in rows["edge"]])
    doc = np.concatenate([np.cumsum(np.frombuffer(x, dtype=np.int64)) for x in rows["doc"]])
    pos = np.concatenate([np.cumsum(np.frombuffer(x, dtype=np.int32).astype(np.int64)) for x in rows["pos"]])
    order, source = _first_sources(edge, doc, pos)
    again = doc[order] > doc[source]
    found = _paths(doc[order][again], pos[order][again], doc[source][again], pos[source][again])
    known = np.frombuffer(b"".join(rows["paths"]), dtype=np.int64).reshape(-1, 5)
    return pd.DataFrame(np.concatenate([found, known]), columns=["doc", "start", "n", "src", "src_start"])


def _facts(docs: DataFrame) -> DataFrame:
    """(doc, n_words, seq, kept_sha256) of each row: the hash of its words, and their digest."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            joined = [b" ".join(words_of(t)) for t in batch["text"]]
            yield pd.DataFrame({
                "doc": batch["doc"].astype("Int64"),
                "n_words": [j.count(b" ") + 1 if j else 0 for j in joined],
                "seq": [xxhash.xxh128_digest(j) for j in joined],
                "kept_sha256": [hashlib.sha256(j).hexdigest() for j in joined],
            })

    return docs.mapInPandas(told, _FACT)


def repeated_paths(docs: DataFrame, n_edges: int) -> DataFrame:
    """(doc, start, n, src, src_start): ``n`` windows from word ``start`` on that ``src`` has, too.

    ``docs`` has ``doc, text``; ``src`` is always smaller than ``doc``.
    """
    buckets = max(1, n_edges // BUCKET)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges, held, size = _Edges(), [], 0
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                words = words_of(text)
                if len(words) >= K:
                    held.append((int(doc), *edges.of(words)))
                    size += len(words)
                if size >= BATCH:
                    yield _sent(held, buckets)
                    held, size = [], 0
        if held:
            yield _sent(held, buckets)

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            for _, part in batch.groupby("bucket"):
                if held and held[-1]["bucket"].iloc[0] != part["bucket"].iloc[0]:
                    yield _repeated(pd.concat(held))
                    held = []
                held.append(part)
        if held:
            yield _repeated(pd.concat(held))

    rows = docs.mapInPandas(sent, "bucket long, edge binary, doc binary, pos binary, paths binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(met, _PATH)


def _digests(words: list[bytes], spans) -> list[bytes]:
    return [xxhash.xxh128_digest(b"\n".join(words[s : s + n + K - 1])) for s, n in spans]


def _some_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(broadcast_if_small(ids.distinct(), MOST_IDS), "doc", "left_semi")


def _with_source_digests(paths: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, start, n, digest): paths with the digest of the words at their source."""
    at = paths.select(F.col("src").alias("doc"), F.col("src_start").alias("start"), "n").distinct()
    asked = at.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, text, spans in zip(batch["doc"], batch["text"], batch["spans"]):
                spans = [(s["start"], s["n"]) for s in spans]
                yield pd.DataFrame({
                    "src": doc, "src_start": [s for s, _ in spans], "n": [n for _, n in spans],
                    "digest": _digests(words_of(text), spans),
                })

    texts = _some_texts(docs, at.select("doc")).join(asked, "doc")
    told_ = texts.select("doc", "text", "spans").mapInPandas(told, "src long, src_start long, n long, digest binary")
    return paths.join(told_.distinct(), ["src", "src_start", "n"]).select("doc", "start", "n", "digest").distinct()


def _without(verified: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, seq, n_removed, kept, kept_sha256) of the documents that have paths."""
    asked = verified.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "digest")).alias("spans"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch["doc"], batch["text"], batch["spans"]):
                words = words_of(text)
                own = _digests(words, [(s["start"], s["n"]) for s in spans])
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for s, digest in zip(spans, own):
                    if digest == bytes(s["digest"]):
                        edge[s["start"]] += 1
                        edge[min(s["start"] + s["n"] + K - 1, len(words))] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, g in zip(words, gone) if not g])
                out.append((
                    doc, xxhash.xxh128_digest(b" ".join(words)), int(gone.sum()), kept.decode(),
                    hashlib.sha256(kept).hexdigest(),
                ))
            yield pd.DataFrame(out, columns=["doc", "seq", "n_removed", "kept", "sha"])

    texts = _some_texts(docs, verified.select("doc")).join(asked, "doc")
    return texts.select("doc", "text", "spans").mapInPandas(
        cut, "doc long, seq binary, n_removed long, kept string, sha string"
    ).dropDuplicates(["doc", "seq"])


def _marked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    at_most(docs.sparkSession, BATCH_ROWS)
    facts = stored(_facts(docs), "facts")
    long_ = facts.where((F.col("n_words") >= K) & F.col("doc").isNotNull())
    first = stored(long_.groupBy("seq").agg(F.min("doc").alias("first"), F.max("n_words").alias("n")), "firsts")
    edges = first.agg(F.sum(F.col("n") - (K - 1))).first()[0] or 0
    originals = _some_texts(docs.where("doc is not null"), first.select(F.col("first").alias("doc")))
    paths = stored(repeated_paths(originals, edges), "paths")
    cut = _without(_with_source_digests(paths, docs), docs)
    marked = facts.join(first.select("seq", "first"), "seq", "left").withColumn(
        "copy", F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    )
    return marked, cut


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of every row of ``docs``.

    A word is removed if a window of 13 consecutive words that covers it also starts in a
    document with a smaller id; windows are those of the input.  ``kept`` holds the words left,
    joined by one blank; it is null for documents from which nothing is removed (their text
    holds it).  ``doc_id`` is an integer.  Null and empty texts have no words; rows without id
    lose nothing and take nothing away; rows that share an id do not touch each other.  An
    empty table gives an empty result; other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    marked, cut = _marked(rows)
    joined = marked.join(cut, ["doc", "seq"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    return joined.select(
        F.col("doc").alias(doc_id),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copy"), "").otherwise(F.col("kept")).alias("kept"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("sha", "kept_sha256")).alias("kept_sha256"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).drop("kept")
