"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation learned on a bounded sample turns every vector into balanced bits that keep its
neighbourhood (iterative quantisation).  The bits are cut into as many parts as there are
tables; two codes become candidates if they differ by ``flips`` bits at most in some part and
by no more bits over all than similar vectors do, short of one in ten thousand.  How many bits
similar vectors differ in depends on the data (a large common mean widens angles around it),
so it is measured: sampled vectors are moved to a cosine of exactly 0.98, and width, flips and
number of tables are the cheapest that bring ``RECALL`` of these pairs together.  Candidates
are compared by the cosine of the original vectors in double precision.

What is sent: equal vectors are one class; classes with one code are a cell, and tables hold
each cell's code once.  Vectors meet only for pairs of cells, packed into matrices of at most
``PACK`` rows, so a group of very many near copies becomes many small matrix products, and
its links are counted and its components found without listing its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sealtrail.llm.components import components
from sealtrail.llm.sampling import smallest_hashes
from sealtrail.sources.scratch import stored

THRESHOLD = 0.98
#: Vectors sampled (two thirds teach the rotation, the rest measure it), and rounds of learning.
SAMPLE = 6_000
ROUNDS = 30
#: Share of the pairs at the threshold that tables must bring together, and pairs to measure it.
RECALL = 0.995
TRIALS = 8_000
#: Tables are at most so many, of at most so many bits, and differ in at most so many of them.
MOST_TABLES, MOST_WIDTH, MOST_FLIPS = 32, 30, 2
#: Bits learned at a time: a projection of fewer bits is the beginning of a longer one.
AXES = 128
#: Rows of a matrix (on average at most this many).
PACK = 1_024
#: Vectors may have this many different lengths.
MOST_LENGTHS = 16


def _iterative_quantisation(x: np.ndarray, bits: int, seed: int) -> np.ndarray:
    """A projection (columns) whose signs are balanced bits that lose little of ``x``."""
    dims = x.shape[1]
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        rng = np.random.default_rng(seed + len(parts))
        _, _, axes = np.linalg.svd(x.T @ x)
        axes = axes.T[:, : min(dims, AXES)]
        rotation, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
        projected = x @ axes
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
            rotation = v.T @ u.T
        parts.append(axes @ rotation)
    return np.concatenate(parts, axis=1)[:, :bits]


def _moved(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``TRIALS`` pairs of unit vectors with a cosine of ``THRESHOLD``.

    One half moves in any direction, the other towards (or past) other vectors of ``x``, where
    the projection separates most.
    """
    rng = np.random.default_rng(11)
    one = x[np.arange(TRIALS) % len(x)]
    side = rng.standard_normal(one.shape)
    side[TRIALS // 2 :] = x[rng.integers(0, len(x), TRIALS - TRIALS // 2)]
    side -= (side * one).sum(axis=1, keepdims=True) * one
    length = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.divide(side, length, out=np.zeros_like(side), where=length > 1e-6)
    other = THRESHOLD * one + math.sqrt(1 - THRESHOLD**2) * side
    return one, other / np.linalg.norm(other, axis=1, keepdims=True)


class Coder:
    """Codes of unit vectors: ``tables`` parts of ``width`` bits each.

    ``most_bits`` bounds the bits in which vectors at the threshold differ: none of those
    measured differs in more, nor does their mean with 4.5 standard deviations.
    """

    def __init__(self, sample: np.ndarray, width: int, tables: int, flips: int = 1):
        mean = sample.mean(axis=0)
        self._fill(mean, _iterative_quantisation(sample - mean, width * tables, seed=7), width, tables, flips)
        one, other = _moved(sample)
        self._bound(self.bits(one) != self.bits(other))

    @staticmethod
    def chosen(sample: np.ndarray, count: int, widths: Iterable[int] = range(1, MOST_WIDTH + 1)) -> Coder:
        """The cheapest coder of ``count`` vectors that reaches ``RECALL`` on moved ones.

        Looking up costs as much as meeting a candidate; of balanced bits a table of width w
        holds count / 2^w codes at each place.  Narrow tables reach any recall.
        """
        widths = sorted(widths)
        held_out = np.arange(len(sample)) % 3 == 0 if len(sample) >= 300 else np.ones(len(sample), dtype=bool)
        learned = sample if held_out.all() else sample[~held_out]  # signs fit what they were learned from better
        coder, mean = Coder.__new__(Coder), learned.mean(axis=0)
        projection = _iterative_quantisation(learned - mean, widths[-1] * MOST_TABLES, seed=7)
        coder._fill(mean, projection, widths[-1], MOST_TABLES, 1)
        one, other = _moved(sample[held_out])
        apart = coder.bits(one) != coder.bits(other)
        best = None
        for width in widths:
            wrong = apart[:, : width * MOST_TABLES].reshape(TRIALS, MOST_TABLES, width).sum(axis=2)
            for flips in range(1, min(MOST_FLIPS, width) + 1):
                met = np.logical_or.accumulate(wrong <= flips, axis=1)
                half = TRIALS // 2
                recall = np.minimum(met[:half].mean(axis=0), met[half:].mean(axis=0))
                if recall[-1] < RECALL:
                    continue
                tables = int(np.argmax(recall >= RECALL)) + 1
                probes = sum(math.comb(width, k) for k in range(flips + 1))
                cost = tables * probes * (1 + count / 2**width)
                if best is None or cost < best[0]:
                    best = cost, width, tables, flips
        if best is None:
            raise ValueError(f"no tables of {widths} bits reach a recall of {RECALL}")
        _, width, tables, flips = best
        coder._fill(mean, projection[:, : width * tables], width, tables, flips)
        coder._bound(apart[:, : width * tables])
        return coder

    def _fill(self, mean: np.ndarray, projection: np.ndarray, width: int, tables: int, flips: int) -> None:
        self.mean, self.projection, self.width, self.tables, self.flips = mean, projection, width, tables, flips

    def _bound(self, apart: np.ndarray) -> None:
        total = apart.sum(axis=1)
        self.most_bits = int(max(total.max(), math.ceil(total.mean() + 4.5 * total.std())))

    def bits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.projection >= 0

    def parts(self, x: np.ndarray) -> np.ndarray:
        bits = self.bits(x).reshape(len(x), self.tables, self.width)
        return bits.astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))

    def code(self, x: np.ndarray) -> np.ndarray:
        """All bits in as few 64-bit words as hold them."""
        packed = np.packbits(self.bits(x), axis=1)
        packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
        return np.ascontiguousarray(packed).view(np.int64)

    def masks(self) -> list[int]:
        """What to flip in a part: every choice of 1 to ``flips`` bits."""
        return [sum(1 << b for b in bs) for k in range(1, self.flips + 1) for bs in combinations(range(self.width), k)]


def _units(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(classes: DataFrame, coder: Coder) -> DataFrame:
    shipped = classes.sparkSession.sparkContext.broadcast(coder)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _units(batch["vector"])
                yield pd.DataFrame({
                    "vec": batch["vec"], "label": batch["label"], "weight": batch["weight"],
                    "parts": list(shipped.value.parts(x)), "code": list(shipped.value.code(x)), "unit": [row.tobytes() for row in x],
                })

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("vec", "label")}
    schema = f"vec {kinds['vec']}, label {kinds['label']}, weight long, parts array<long>, code array<long>, unit binary"
    return classes.select("vec", "label", "weight", "vector").mapInPandas(code, schema)


def _cell_pairs(cells: DataFrame, coder: Coder) -> DataFrame:
    """(p, q) codes of one label that some table brings together, each pair once."""
    parts = cells.select("label", "cell", "code", F.posexplode("parts").alias("table", "part"))
    masks = F.array(*[F.lit(m).cast("long") for m in coder.masks()])
    # of two parts the smaller one visits the larger
    flips = F.filter(F.transform(masks, lambda m: m.bitwiseXOR(F.col("part"))), lambda p: p > F.col("part"))
    at = F.concat(F.array(F.struct(F.col("part").alias("at"), F.lit(False).alias("guest"))),
                  F.transform(flips, lambda p: F.struct(p.alias("at"), F.lit(True).alias("guest"))))
    visits = parts.select("label", "table", F.inline(at), F.col("cell").alias("q"), F.col("code").alias("q_code"))
    homes = parts.select("label", "table", F.col("part").alias("at"), F.col("cell").alias("p"), F.col("code").alias("p_code"))
    apart = F.aggregate(
        F.zip_with("p_code", "q_code", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x
    )
    met = homes.join(visits, ["label", "table", "at"]).where(F.col("guest") | (F.col("p") < F.col("q")))
    return (
        met.where(apart <= coder.most_bits)
        .select("label", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
        .distinct()
    )


def _packs(coded: DataFrame) -> DataFrame:
    """(label, cell, pack, vecs, weights, units): the classes of a cell as matrices."""
    sizes = coded.groupBy("label", "cell").agg(F.ceil(F.count("*") / PACK).cast("int").alias("packs"))
    rows = coded.join(sizes, ["label", "cell"]).withColumn("pack", F.pmod(F.xxhash64("vec"), F.col("packs")).cast("int"))
    packed = rows.groupBy("label", "cell", "packs", "pack").agg(
        F.sort_array(F.collect_list(F.struct("vec", "weight", "unit"))).alias("r")
    )
    return packed.select(
        "label", "cell", "packs", "pack",
        F.col("r.vec").alias("vecs"), F.col("r.weight").alias("weights"), F.col("r.unit").alias("units"),
    )


def _block_components(links: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest row index reachable from each row and column of a matrix of links."""
    rows = np.arange(links.shape[0])
    if same:
        while True:
            least = np.where(links, rows, len(rows)).min(axis=1)
            least = np.minimum(least, rows)
            if (least == rows).all():
                return rows, rows
            rows = least
    cols = np.full(links.shape[1], links.shape[0])
    while True:
        least = np.where(links, rows[:, None], links.shape[0]).min(axis=0)
        back = np.minimum(rows, np.where(links, least, links.shape[0]).min(axis=1))
        if (least == cols).all() and (back == rows).all():
            return rows, cols
        rows, cols = back, least


def _compared(pairs: DataFrame) -> DataFrame:
    """(vec, n, other): links of each class within a pair of packs, and one that stands for them."""
    kind = pairs.schema["p_vecs"].dataType.elementType.simpleString()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            vec, n, other = [], [], []
            for row in batch.itertuples(index=False):
                a = np.frombuffer(b"".join(row.p_units)).reshape(len(row.p_vecs), -1)
                b = np.frombuffer(b"".join(row.q_units)).reshape(len(row.q_vecs), -1)
                links = a @ b.T >= THRESHOLD
                if row.same:
                    np.fill_diagonal(links, False)
                if not links.any():
                    continue
                here, there = _block_components(links, row.same)
                rows = np.flatnonzero(links.any(axis=1))
                vec += [row.p_vecs[i] for i in rows]
                n += (links[rows] @ np.asarray(row.q_weights, dtype=np.int64)).tolist()
                other += [row.p_vecs[here[i]] for i in rows]
                if not row.same:
                    cols = np.flatnonzero(links.any(axis=0))
                    vec += [row.q_vecs[j] for j in cols]
                    n += (links[:, cols].T @ np.asarray(row.p_weights, dtype=np.int64)).tolist()
                    other += [row.p_vecs[there[j]] for j in cols]
            yield pd.DataFrame({"vec": pd.Series(vec, dtype="int64"), "n": pd.Series(n, dtype="int64"), "other": pd.Series(other, dtype="int64")})

    return pairs.mapInPandas(compare, f"vec {kind}, n long, other {kind}")


def _linked(classes: DataFrame, dims: int) -> DataFrame:
    """(vec, n, other) over all pairs of packs of the classes with ``dims`` components."""
    own = classes.where(F.size("vector") == dims)
    count = own.count()
    ids = smallest_hashes(own, "vec", SAMPLE)
    sample = _units(own.join(F.broadcast(ids), "vec", "left_semi").orderBy("vec").limit(SAMPLE).select("vector").toPandas()["vector"])
    coder = Coder.chosen(sample, count)
    coded = stored(_coded(own, coder).withColumn("cell", F.array_join(F.transform("code", lambda p: F.hex(p)), ".")), "coded")
    cells = coded.select("label", "cell", "parts", "code").distinct()
    packs = stored(_packs(coded), "packs")
    between = _cell_pairs(cells, coder).unionByName(cells.select("label", F.col("cell").alias("p"), F.col("cell").alias("q")))

    def side(x: str) -> DataFrame:
        return packs.select("label", *[F.col(c).alias(f"{x}{c}" if c == "cell" else f"{x}_{c}") for c in ("cell", "pack", "vecs", "weights", "units")])

    one = side("p").withColumnRenamed("pcell", "p")
    two = side("q").withColumnRenamed("qcell", "q")
    met = between.join(one, ["label", "p"]).join(two, ["label", "q"])
    met = met.where((F.col("p") != F.col("q")) | (F.col("p_pack") <= F.col("q_pack")))
    same = (F.col("p") == F.col("q")) & (F.col("p_pack") == F.col("q_pack"))
    alone = same & (F.size("p_vecs") == 1)
    return _compared(met.withColumn("same", same).where(~alone).select(
        "same", "p_vecs", "p_weights", "p_units", "q_vecs", "q_weights", "q_units"
    ))


def embedding_groups(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows``.

    Two vectors are linked if their labels are equal and not null, they have equally many
    components and a cosine of 0.98 or more.  ``n_links`` counts the rows linked directly,
    ``component_id`` is the smallest id reachable, ``kept`` whether that is the row's own.
    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do rows without id (``component_id`` null, not kept).  Ids are integers and
    name one vector; rows that repeat an id count as copies.  An empty table gives none.

    Candidates come from hash tables: of links at the threshold about one in two hundred is
    missed, of closer ones fewer, whatever mean the vectors have and however many they are
    (see ``Coder.chosen``).  No link is reported below it.
    """
    whole = F.transform(F.col(embedding), lambda x: x.cast("double"))
    told = rows.select(F.col(vec_id).alias("vec"), F.col(label).alias("label"), whole.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fit = F.coalesce(finite & F.exists("vector", lambda x: x != 0.0) & F.col("vec").isNotNull() & F.col("label").isNotNull(), F.lit(False))
    keys = F.when(fit, F.struct(F.xxhash64("vector").alias("x"), F.xxhash64(F.lit("again"), "vector").alias("y")))
    keyed = told.withColumn("key", keys)
    classes = stored(
        keyed.where("key is not null").groupBy("label", "key")
        .agg(F.min("vec").alias("vec"), F.count("*").alias("weight"), F.any_value("vector").alias("vector")),
        "vectors",
    )
    lengths = [r[0] for r in classes.select(F.size("vector")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    out = keyed.select("vec", "label", "key")
    if lengths:
        linked = _linked(classes, lengths[0])
        for dims in lengths[1:]:
            linked = linked.unionByName(_linked(classes, dims))
        linked = stored(linked, "linked")
        near = components(linked, "vec", "other").withColumnRenamed("node", "vec")
        more = linked.groupBy("vec").agg(F.sum("n").alias("n"))
        facts = (
            classes.join(more, "vec", "left").join(near, "vec", "left")
            .select("label", "key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                    F.coalesce("component", "vec").alias("component_id"))
        )
        out = out.join(facts, ["label", "key"], "left")
    else:
        out = out.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.lit(None).cast("long")})
    component = F.coalesce("component_id", "vec")
    return out.select(
        F.col("vec").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("vec"), F.lit(False)).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
