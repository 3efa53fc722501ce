"""Hard negatives by exact scores: Strassen products of integer tiles, then mergeable heaps.

Components become whole numbers and vectors are packed into tiles of bounded size.  A tile of
anchors meets a tile of candidates as one 64-bit integer product, computed by Strassen's seven
recursive products (odd sides are padded with zeros; integer additions keep it exact).

Two rounds of tiles follow.  In the first, anchors meet the tiles that may hold their label;
each product gives the best few of every anchor, a heap that merges with those of other tiles.
In the second, anchors carry their positives and meet all tiles; each product gives the best few
negatives of every window below a positive's score, heaps again.  Merging is a row number with a
limit, which Spark applies before and after its shuffle.

Tiles meet in a grid: candidates' tiles are dealt to groups and so are the anchors', and a join on
the pair of groups copies each tile to the groups of the other side.  Groups are of bounded size,
so no key holds more than one square of the grid, however the labels are distributed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealtrail.llm.batches import stored_in_batches
from sealtrail.sources.scratch import stored

#: Products are split in halves down to sides of this.
LEAF = 32
#: Rows and numbers of a tile, and rows of a group of tiles.
TILE_ROWS, TILE_CELLS = 1_024, 1 << 18
GROUP_ROWS = 1 << 17
#: Arrow batches of tile pairs.
PAIR_BYTES = 16_000_000

SCALE = 256
#: Sums of products must stay below this: a hundred times as much still fits 64 bits.
LARGEST = 2**56
POSITIVES = NEGATIVES = 5
#: Negatives score between this share (of a hundred) of the positive's score and the whole of it.
LEAST = 80


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, by seven products of half the size."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), dtype=np.int64)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; the shorter vectors count as padded with zeros."""
    common = min(a.shape[1], b.shape[1])
    return strassen(np.ascontiguousarray(a[:, :common]), np.ascontiguousarray(b[:, :common].T))


def _heads(row: np.ndarray, score: np.ndarray, key: np.ndarray, few: int) -> np.ndarray:
    """Places of the first ``few`` of each row by falling score, then rising key."""
    order = np.lexsort((key, -score, row))
    ranked = row[order]
    first = np.searchsorted(ranked, ranked, side="left")
    return order[np.arange(len(order)) - first < few]


# -- tiles ----------------------------------------------------------------------------------

def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v): usable rows with components floor(256 x), one for each id."""
    whole = F.transform(F.col(f"`{embedding}`"), lambda x: x.cast("double"))
    told = rows.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), whole.alias("x"))
    bound = F.sqrt(F.lit(float(LARGEST)) / F.greatest(F.size("x"), F.lit(1)))  # then no inner product exceeds LARGEST
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE + 1 < bound))
    fit = told.where("id is not null and label is not null").where(F.coalesce(usable, F.lit(False)))
    numbers = fit.select("id", "label", F.transform("x", lambda x: F.floor(x * SCALE)).alias("v"))
    least = F.min(F.struct("label", "v")).alias("s")
    return stored(numbers.groupBy("id").agg(least).select("id", "s.label", "s.v"), "integers")


def _tiles(vectors: DataFrame, bucket: Column, also: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, dims, tile, ids, labels, cells, *also): rows of a bucket and a length in tiles, by id.

    Buckets are cut by the ids' hashes into tiles of at most ``TILE_ROWS`` rows and ``TILE_CELLS``
    numbers on average.
    """
    rows = vectors.withColumns({"bucket": bucket, "dims": F.size("v")})
    most = F.least(F.lit(TILE_ROWS), F.greatest(F.lit(1), F.floor(F.lit(TILE_CELLS) / F.greatest("dims", F.lit(1)))))
    sizes = rows.groupBy("bucket", "dims").agg(F.ceil(F.count("*") / most).cast("long").alias("cuts"))
    cut = rows.join(sizes, ["bucket", "dims"]).withColumn("cut", F.pmod(F.xxhash64("id", F.lit("tile")), "cuts"))
    packed = cut.groupBy("bucket", "dims", "cut").agg(F.sort_array(F.collect_list(F.struct("id", "label", "v", *also))).alias("r"))
    return packed.select(
        "bucket", "dims", F.xxhash64("bucket", "dims", "cut").alias("tile"), F.col("r.id").alias("ids"), F.col("r.label").alias("labels"),
        F.flatten("r.v").alias("cells"), *[F.col(f"r.{c}").alias(c) for c in also],
    )


def _groups(rows: int, tiles: int, least: int) -> int:
    return max(1, -(-rows // GROUP_ROWS), min(tiles, least))


def _pairs(candidates: DataFrame, anchors: DataFrame, across: int, down: int, on: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of tiles that agree in ``on``, by squares of a grid of ``across`` x ``down`` groups."""

    def side(tiles: DataFrame, name: str, own: tuple[str, int], other: tuple[str, int], also: tuple[str, ...] = ()) -> DataFrame:
        columns = [F.col(c).alias(f"{name}_{c}") for c in ("dims", "ids", "labels", "cells", *also)]
        mine = F.pmod(F.xxhash64("tile", F.lit("group")), F.lit(own[1])).cast("int").alias(own[0])
        copies = F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1))).alias(other[0])
        return tiles.select(*on, mine, *columns, copies)

    x, y = ("x", across), ("y", down)
    met = side(candidates, "c", x, y).join(side(anchors, "a", y, x, also), [*on, "x", "y"])
    return met.select([c for c in met.columns if c[:2] in ("a_", "c_")])


def _matrix(cells: np.ndarray, dims: int, rows: int) -> np.ndarray:
    return np.asarray(cells, dtype=np.int64).reshape(rows, dims)


def _met(pairs: DataFrame, compare: Callable, columns: str, name: str) -> DataFrame:
    """``compare(row of a pair, products)`` for all pairs of tiles."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="int64") for c in columns.split(", ")})
        for batch in batches:
            found = [compare(row, _product(_matrix(row.a_cells, row.a_dims, len(row.a_ids)), _matrix(row.c_cells, row.c_dims, len(row.c_ids))))
                     for row in batch.itertuples(index=False)]
            yield pd.concat([empty, *found], ignore_index=True)

    return stored_in_batches(pairs.mapInPandas(products, columns), name, PAIR_BYTES)


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has a row (id, label, v) for each id, whole numbers without null (see
    :func:`integer_vectors`).  Anchors are the ids divisible by ``every``.  Scores are inner
    products with the anchor, shorter vectors padded with zeros; higher ones come first, then
    smaller ids.  An anchor's positives are the first ``positives`` others of its label; for each,
    ranks from 1 count the first ``negatives`` of other labels with a score of ``least`` to 100 per
    cent of the positive's (none below a negative score).  Fewer are returned if there are fewer;
    an anchor without positives, or an empty table, has no rows.
    """
    vectors = vectors.select("id", "label", "v")
    anchors = vectors.where(F.col("id") % every == 0)
    count, n_anchors = vectors.count(), anchors.count()
    bucket = F.pmod(F.xxhash64("label"), F.lit(max(1, count // TILE_ROWS)))  # positives are in the anchor's bucket
    tiles = stored(_tiles(vectors, bucket), "tiles")
    across = _groups(count, tiles.count(), 2 * vectors.sparkSession.sparkContext.defaultParallelism)
    down = _groups(n_anchors, 1, 1)
    pairs = _pairs(tiles, _tiles(anchors, bucket), across, down, ["bucket"])

    def best(row, scores: np.ndarray) -> pd.DataFrame:
        a, c = np.asarray(row.a_ids), np.asarray(row.c_ids)
        fits = (np.asarray(row.a_labels)[:, None] == np.asarray(row.c_labels)) & (a[:, None] != c)
        at, col = np.nonzero(fits)
        score = scores[at, col]
        top = _heads(at, score, c[col], positives)
        return pd.DataFrame({"anchor_id": a[at[top]], "positive_id": c[col[top]], "score": score[top]})

    found = _met(pairs, best, "anchor_id long, positive_id long, score long", "positives")
    rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    firsts = found.withColumn("rank", rank).where(F.col("rank") <= positives).groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "positive_id", "score"))).alias("p")  # at most ``positives``
    )
    wanted = anchors.join(firsts.withColumnRenamed("anchor_id", "id"), "id").select(
        "id", "label", "v", F.col("p.positive_id").alias("positive_ids"), F.col("p.score").alias("positive_scores")
    )

    seekers = _tiles(wanted, F.lit(0), ("positive_ids", "positive_scores"))
    pairs = _pairs(tiles, seekers, across, down, [], ("positive_ids", "positive_scores"))

    def windows(row, scores: np.ndarray) -> pd.DataFrame:
        a, c = np.asarray(row.a_ids), np.asarray(row.c_ids)
        high = np.full((len(a), positives), -1, dtype=np.int64)  # an empty window
        names = np.zeros((len(a), positives), dtype=np.int64)
        for i, (p, s) in enumerate(zip(row.a_positive_ids, row.a_positive_scores)):
            names[i, : len(p)], high[i, : len(s)] = p, s
        low = np.where(high >= 0, -(-least * high // 100), 0)
        some = np.where(high >= 0, low, LARGEST * 2).min(axis=1)
        fits = (scores >= some[:, None]) & (scores <= high.max(axis=1)[:, None])
        fits &= np.asarray(row.a_labels)[:, None] != np.asarray(row.c_labels)
        at, col = np.nonzero(fits)
        score, out = scores[at, col], []
        for j in range(positives):
            inside = np.flatnonzero((score >= low[at, j]) & (score <= high[at, j]))
            top = inside[_heads(at[inside], score[inside], c[col[inside]], negatives)]
            out.append(pd.DataFrame({
                "anchor_id": a[at[top]], "positive_id": names[at[top], j], "negative_id": c[col[top]],
                "positive_score": high[at[top], j], "negative_score": score[top],
            }))
        return pd.concat(out)

    met = _met(pairs, windows, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", "negatives")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def mined(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """:func:`hard_negatives` of ``rows`` after some labels are moved.

    Labels are integers; where ``vec_id`` is divisible by 7 the label becomes (label + 1) % 10.
    Rows with a null id, label or vector, or with null or non-finite components, take no part, nor
    do those whose components are so large (about 2^28 / sqrt(length) / 256) that scores could
    exceed 64 bits.  Rows that repeat an id count once, the least label and vector.  Empty
    vectors score 0.  Other columns are not looked at.
    """
    own = F.col(f"`{label}`").cast("long")
    moved = F.when(F.col(f"`{vec_id}`") % 7 == 0, (own % 10 + 1) % 10).otherwise(own)
    told = rows.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"), moved.alias("label"))
    return hard_negatives(integer_vectors(told))


def query(spark, sf_dir: str) -> DataFrame:
    return mined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS a, c.id AS c, a.label = c.label AS same,
    coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.id <> c.id WHERE a.id % 100 = 0
), p AS (
  SELECT a, c, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, c) <= 5
), n AS (
  SELECT p.a, p.c AS p, s.c AS n, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.score DESC, s.c) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT a AS anchor_id, p AS positive_id, rank::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= 5
"""
