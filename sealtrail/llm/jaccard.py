"""Groups of near-duplicate texts: n-gram Jaccard join over count-vector R-trees.

A text's set holds its distinct word shingles as 64-bit hashes.  The hashes fall into
``GROUPS`` groups; the counts per group are a point.  The intersection of two sets is at most
the sum of the smaller of the two counts over all groups, and what an R-tree node can
contribute is at most that sum with the largest counts below the node.  So a search for
partners of a text descends only where the bound allows the required overlap, and surviving
pairs are verified on the exact sets.  In long texts every group is full and bounds nothing, so
these have counts of more groups as well, which a pair meets before its sets do.

Trees are built per block, so that the search distributes: two sets with Jaccard similarity
of 0.8 share one of their first ``n - ceil(0.8 n) + 1`` hashes in any common order, and each
such hash is a block.  The order puts hashes that a sample shows to be frequent last, which
keeps blocks small; it decides speed, never results.  Where the block's hash is the first that
two sets share, their intersection is at most what either set has from that hash on; a pair that
no block admits by this and by its sizes is dropped before anything wide moves.

Large groups of near copies would fill a block with all pairs.  So the members of a block are
first compared with one of them alone, a center, and components are formed; then the trees
search only for pairs across components.  Blocks still large are searched as pairs of cells.
Copies (equal sets) are one class from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sealtrail.llm.batches import at_most, give_back
from sealtrail.llm.components import components
from sealtrail.plans.joins import broadcast_if_small
from sealtrail.sources.scratch import stored

SHINGLE = 5
PERCENT = 80
GROUPS = 256
#: Hashes of a set that share a group of its fine counts, at most on average.
PER_GROUP = 8
#: Documents in the sample that shows frequent shingles, and the share that makes one frequent.
SAMPLE = 4_000
FREQUENT = 0.001
#: Largest list of frequent shingles (8 bytes each) that is sent to the workers.
MOST_FREQUENT = 200_000
#: Members of one tree; larger blocks are searched as pairs of cells.
CELL = 1_024
NODE = 16
#: Neighbours of a block's member, by size, that are told one by one whether they may be its partners.
REACH = 4
REMEMBERED = 300_000
#: Rows of an Arrow batch: pairs of whole sets are compared in one.
BATCH_ROWS = 4_000
#: Pairs of ids (16 bytes each) up to which they are broadcast.
MOST_PAIRS = 1_000_000

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class Shingler:
    """Distinct shingle hashes of texts, sorted; remembers words' hashes up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII blanks only
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in words:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(len(h), SHINGLE)
        mixed = np.full(len(h) - width + 1, width, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(width):
                mixed = (mixed ^ h[k : len(h) - width + 1 + k]) * _FACTORS[k]
                mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def _least_overlap(n: np.ndarray | int) -> np.ndarray | int:
    """Smallest intersection that sets whose sizes sum up to ``n`` need."""
    return -(-PERCENT * n // (100 + PERCENT))


def _group_counts(shingles: np.ndarray, groups: int = GROUPS) -> bytes:
    """The point of a set; empty if a count is too large to be kept (then nothing is bounded)."""
    counts = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % groups, minlength=groups)
    return counts.astype(np.uint8).tobytes() if counts.max(initial=0) < 256 else b""


def _fine_counts(shingles: np.ndarray) -> bytes:
    """Counts of so many groups that few hashes share one; empty where ``GROUPS`` groups will do."""
    groups = GROUPS
    while len(shingles) > PER_GROUP * groups:
        groups *= 2
    return _group_counts(shingles, groups) if groups > GROUPS else b""


def _fine_overlap(x: bytes, y: bytes) -> int:
    """Largest possible intersection by two sets' fine counts, those of more groups folded to the others'."""
    groups = min(len(x), len(y))
    p, q = (np.frombuffer(v, dtype=np.uint8).reshape(-1, groups).sum(axis=0, dtype=np.int64) for v in (x, y))
    return int(np.minimum(p, q).sum())


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Hashes that at least a thousandth of a sample of ``doc, text`` has: a bounded list."""
    total = docs.count()
    share = min(1.0, SAMPLE / max(total, 1))
    sample = docs.where(F.pmod(F.xxhash64("doc", F.lit("frequent")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"h": shingler(text).view(np.int64)})
        shingler = batch = text = None
        give_back()

    least = max(5, int(FREQUENT * min(total, SAMPLE)))
    counts = sample.select("text").distinct().mapInPandas(sets, "h long").groupBy("h").agg(F.count("*").alias("c"))
    rows = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "h").limit(MOST_FREQUENT).select("h").toPandas()
    return np.sort(rows["h"].to_numpy(dtype=np.int64).view(np.uint64))


def _kind(df: DataFrame, column: str = "doc") -> str:
    return df.schema[column].dataType.simpleString()


def _signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc, n, class, keys, point, fine) of each document row; class is null without words."""
    shipped = docs.sparkSession.sparkContext.broadcast(frequent)

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, common = Shingler(), shipped.value
        for batch in batches:
            out = {"doc": batch["doc"], "n": [], "class": [], "keys": [], "point": [], "fine": []}
            for text in batch["text"]:
                s = shingler(text)
                n = len(s)
                at = np.searchsorted(common, s)
                late = common[np.minimum(at, len(common) - 1)] == s if len(common) else np.zeros(n, dtype=bool)
                ordered = np.concatenate([s[~late], s[late]])
                out["n"].append(n)
                out["class"].append(xxhash.xxh128_digest(s.tobytes()) if n else None)
                out["keys"].append(ordered[: n + (PERCENT * -n // 100) + 1 if n else 0].view(np.int64))
                out["point"].append(_group_counts(s))
                out["fine"].append(_fine_counts(s))
            yield pd.DataFrame(out)
        shingler = batch = out = None
        give_back()

    schema = f"doc {_kind(docs)}, n long, class binary, keys array<long>, point binary, fine binary"
    return docs.mapInPandas(signed, schema)


def _packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes (a collision within a pair is one in ten millions)."""
    return np.ascontiguousarray((shingles >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _once(held: DataFrame) -> DataFrame:
    """One row of each ``doc``: the rows of an id that copies share would all meet all of the other id's.

    Only the rows of such ids are shuffled, while the list of these is short.
    """
    repeated = held.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc")
    few = broadcast_if_small(repeated, MOST_PAIRS)
    if few is repeated:
        return stored(held.groupBy("doc").agg(F.any_value("s").alias("s")), "sets")
    if few.isEmpty():
        return held
    copied = held.join(few, "doc", "left_semi").groupBy("doc").agg(F.any_value("s").alias("s"))
    return held.join(few, "doc", "left_anti").unionByName(stored(copied, "sets"))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of class representatives whose sets are similar enough, from whole texts."""
    kind = _kind(docs)
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    wanted = classes.select("rep", "class").join(ends, "rep", "left_semi").withColumnRenamed("rep", "doc")
    texts = docs.join(broadcast_if_small(wanted), "doc")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            full = [shingler(t) for t in batch["text"]]
            own = [xxhash.xxh128_digest(s.tobytes()) == bytes(c) for s, c in zip(full, batch["class"])]
            batch["s"] = [_packed(s) for s in full]
            yield batch.loc[np.array(own, dtype=bool), ["doc", "s"]]
        shingler = batch = full = None
        give_back()

    held = _once(stored(texts.select("doc", "text", "class").mapInPandas(sets, f"doc {kind}, s binary"), "sets"))

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["x"], batch["y"]):
                p, q = _unpacked(x), _unpacked(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]
        batch = None
        give_back()

    # the pairs go to one side's sets while they are few enough; these then meet the other's
    few = broadcast_if_small(pairs, MOST_PAIRS)
    joined = held.select(F.col("doc").alias("b"), F.col("s").alias("y")).join(few, "b").join(
        held.select(F.col("doc").alias("a"), F.col("s").alias("x")), "a"
    )
    return joined.select("a", "b", "x", "y").mapInPandas(similar, f"a {kind}, b {kind}")


class CountTree:
    """An R-tree over points of group counts, packed by size and then by the widest group."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        slab = NODE * max(1, int(np.ceil(np.sqrt(len(order) / NODE))))
        widest = int(np.argmax(points.var(axis=0))) if len(points) else 0
        order = np.concatenate([
            part[np.argsort(points[part, widest], kind="stable")]
            for part in np.array_split(order, max(1, -(-len(order) // slab)))
        ]) if len(order) else order
        self.order = order
        # level 0 are the points; each level above has the largest counts and extreme sizes below
        self.levels = [(points[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > NODE:
            top, low, high = self.levels[-1]
            cut = np.arange(0, len(top), NODE)
            self.levels.append((
                np.maximum.reduceat(top, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            ))

    def partners(self, point: np.ndarray, size: int) -> np.ndarray:
        """Places of all points that may have the required overlap with ``point``."""
        at = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[level]
            least = np.maximum(low[at], -(-PERCENT * size // 100))
            fits = (100 * high[at] >= PERCENT * size) & (PERCENT * low[at] <= 100 * size)
            bound = np.minimum(top[at], point).sum(axis=1)
            at = at[fits & (bound >= _least_overlap(size + least))]
            if level:
                below = len(self.levels[level - 1][0])
                at = (at[:, None] * NODE + np.arange(NODE)).ravel()
                at = at[at < below]
        return self.order[at]


def _points(column: pd.Series) -> np.ndarray:
    """Counts of each row; where they were too large to keep, no count bounds anything."""
    free = np.full(GROUPS, 1 << 20, dtype=np.int32)
    return np.stack([np.frombuffer(p, dtype=np.uint8).astype(np.int32) if p else free for p in column])


def _searched(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs across components, and across cells if the group is of two cells."""
    points, sizes = _points(group["point"]), group["n"].to_numpy()
    reps, component = group["rep"].to_numpy(), group["component"].to_numpy()
    cell = group["cell"].to_numpy()
    two = cell.min() != cell.max()
    found = []
    tree = CountTree(points, sizes)
    for i in range(len(group)):
        near = tree.partners(points[i], int(sizes[i]))
        near = near[(reps[near] > reps[i]) & (component[near] != component[i])]
        if two:
            near = near[cell[near] != cell[i]]
        found += [(reps[i], reps[j]) for j in near]
    return pd.DataFrame(found, columns=["a", "b"])


def _fits(n: str, rest: str, m: str, other: str) -> Column:
    """Whether sets of ``n`` and ``m`` hashes, of which ``rest`` and ``other`` come from the block's on, may be similar."""
    sizes = PERCENT * F.greatest(n, m) <= 100 * F.least(n, m)
    return sizes & ((100 + PERCENT) * F.least(rest, other) >= PERCENT * (F.col(n) + F.col(m)))


def _across(members: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidate pairs of different components from blocks of (key, rep, n, rest, component).

    Blocks that would fill one tree node at most have no tree: their few pairs are made
    distinct first (a pair has many blocks in common) and bounded then.
    """
    kind = _kind(members, "rep")
    sizes = members.groupBy("key").agg(
        F.count("*").alias("size"), F.min("component").alias("least"), F.max("component").alias("most")
    )
    open_ = stored(
        members.join(sizes.where("least <> most").select("key", "size"), "key"), "open"
    )
    few = open_.where(F.col("size") <= NODE)
    other_few = few.select(
        "key", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("rest").alias("other"), F.col("component").alias("b_component")
    )
    small = few.join(other_few, "key").where(
        F.expr("rep < b and component <> b_component") & _fits("n", "rest", "m", "other")
    ).select(F.col("rep").alias("a"), "b").distinct()

    many = open_.where(F.col("size") > NODE).drop("n", "rest").withColumn("cells", F.ceil(F.col("size") / CELL).cast("int")).join(facts.drop("fine"), "rep")
    rows = many.withColumn("cell", F.pmod(F.xxhash64("rep"), F.col("cells")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other")
    spread = rows.select("*", other).withColumns({
        "low": F.least("cell", "other"), "high": F.greatest("cell", "other"),
    }).select("key", "low", "high", "rep", "n", "point", "component", "cell")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            name = batch[["key", "low", "high"]].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero((name[1:] != name[:-1]).any(axis=1)) + 1])
            for begin, end in zip(starts[:-1], starts[1:]):
                yield _searched(batch.iloc[begin:end])
            rest = batch.iloc[starts[-1]:]  # may go on in the next batch
        if rest is not None:
            yield _searched(rest)
        rest = batch = None
        give_back()

    grouped = spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    large = grouped.mapInPandas(search, f"a {kind}, b {kind}")
    return _bounded(stored(small.unionByName(large).distinct(), "near"), facts)


def _shared(classes: DataFrame, fitting: bool = False) -> DataFrame:
    """(key, rep, n, rest) of blocks with two members or more; a block is never held, only its last rows.

    ``rest`` is how many hashes the member's set of ``n`` has from the block's on.  With ``fitting``,
    members go that have no partner in their block by ``_fits``.  They come in the order of ``n``, so
    whoever has none among the next ``REACH`` on either side, and nobody of a fitting size right behind
    these, has none at all.
    """
    kind = _kind(classes, "rep")
    reach = REACH

    def partnered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, told = None, 0  # the last rows so far; of these so many are told and kept for the others
        for batch in chain(batches, [None]):
            if batch is not None:
                if not len(batch):
                    continue
                rows = batch if rows is None else pd.concat([rows, batch], ignore_index=True)
            if rows is None:
                break
            key, n, rest = rows["key"].to_numpy(), rows["n"].to_numpy(), rows["rest"].to_numpy()
            keep = np.zeros(len(rows), dtype=bool)
            for k in range(1, min(reach + 2, len(rows))):
                i = np.flatnonzero(key[k:] == key[:-k])
                near = 100 * n[i] >= PERCENT * n[i + k] if fitting else np.ones(len(i), dtype=bool)
                if fitting and k <= reach:
                    near &= (100 + PERCENT) * np.minimum(rest[i], rest[i + k]) >= PERCENT * (n[i] + n[i + k])
                keep[i[near]] = keep[i[near] + k] = True
            end = len(rows) if batch is None else max(told, len(rows) - reach - 1)
            yield rows.iloc[told:end][keep[told:end]]
            begin = max(0, end - reach - 1)
            rows, told = rows.iloc[begin:], end - begin
        rows = batch = key = n = rest = None
        give_back()

    keyed = classes.select(F.posexplode("keys").alias("place", "key"), "rep", "n").select(
        "key", "rep", "n", (F.col("n") - F.col("place")).alias("rest")
    )
    return keyed.repartition("key").sortWithinPartitions("key", "n").mapInPandas(
        partnered, f"key long, rep {kind}, n long, rest long"
    )


def _with_centers(shared: DataFrame) -> DataFrame:
    """``shared`` with center and fits: the center of a block is the member that shares most.

    A text that copies were made of shares nearly all of its hashes with them, while copies
    have hashes of their own where they were changed; so it is the likeliest to be similar to
    all of them.  ``fits`` tells whether the block admits the pair of member and center.
    """
    sizes = shared.groupBy("key").agg(F.count("*").alias("size"))
    sharing = shared.join(sizes, "key").groupBy("rep").agg(F.sum("size").alias("shares"))
    rows = shared.join(sharing, "rep")
    best = rows.groupBy("key").agg(F.max("shares").alias("shares"))
    centers = rows.join(best, ["key", "shares"]).groupBy("key").agg(F.min(F.struct("rep", "n", "rest")).alias("c")).select(
        "key", F.col("c.rep").alias("center"), F.col("c.n").alias("m"), F.col("c.rest").alias("other")
    )
    return shared.join(centers, "key").withColumn("fits", _fits("n", "rest", "m", "other")).drop("m", "other")


def _classes(named: DataFrame) -> DataFrame:
    """(class, rep, n, keys, point, fine) of each distinct set.

    Only rows of sets that come more than once are shuffled, while the list of these is short.
    """
    repeated = named.groupBy("class").agg(F.count("*").alias("rows")).where("rows > 1").select("class")
    few = broadcast_if_small(repeated, MOST_PAIRS)
    copied = named if few is repeated else named.join(few, "class", "left_semi")
    classes = stored(
        copied.groupBy("class").agg(
            F.min("doc").alias("rep"), *[F.any_value(c).alias(c) for c in named.columns if c not in ("doc", "class")]
        ),
        "classes",
    )
    if few is repeated:
        return classes
    alone = named.join(few, "class", "left_anti").withColumnRenamed("doc", "rep")
    return alone.select(*classes.columns).unionByName(classes)


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    Words are runs of non-blanks with A-Z lower-cased; a set holds the distinct runs of five
    words, or the whole sequence of fewer.  Two texts are linked if ``100 * |intersection| >=
    80 * |union|``; ``component_id`` is the smallest id reachable by links.  Texts without words
    (or null) have ``n_shingles`` 0 and only themselves.  Ids need not be unique: rows of one
    text are linked whatever their ids.  A row without id is in no component (null) and links
    nothing.  Other columns are not looked at; an empty table gives an empty result.
    """
    at_most(docs.sparkSession, BATCH_ROWS)
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    signed = stored(_signatures(rows, frequent_shingles(rows)), "signatures")
    named = signed.where(F.col("class").isNotNull() & F.col("doc").isNotNull())
    classes = _classes(named)

    members = stored(_with_centers(stored(_shared(classes, fitting=True), "shared")), "members")
    facts = classes.select("rep", "n", "point", "fine")

    # every member against one center, that of most of its blocks
    common = members.where("rep <> center").groupBy("rep", "center").agg(F.count("*").alias("c"), F.max("fits").alias("fits")).where("fits")
    star = common.groupBy("rep").agg(F.max_by("center", F.struct("c", "center")).alias("center")).select(
        F.least("center", "rep").alias("a"), F.greatest("center", "rep").alias("b")
    ).distinct()
    links = stored(_verified(stored(_bounded(star, facts), "star"), rows, classes), "links")
    first = components(links)

    # then pairs that are still apart, in blocks of more than two
    blocks = members.drop("center", "fits").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    blocks = blocks.withColumn("component", F.coalesce("component", "rep"))
    more = _verified(stored(_across(blocks, facts), "pairs"), rows, classes)
    merged = components(stored(links.union(more), "links"))

    least = classes.select("class", "rep").join(merged.withColumnRenamed("node", "rep"), "rep", "left").select(
        "class", F.coalesce("component", "rep").alias("least")
    )
    own = F.when(F.col("doc").isNotNull(), F.coalesce("least", "doc"))
    return signed.join(least, "class", "left").select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), own.alias("component_id")
    )


def _bounded(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs whose sizes and points allow the required overlap."""
    kind = _kind(pairs, "a")

    def possible(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                n, m = batch["n"].to_numpy(), batch["m"].to_numpy()
                bound = np.minimum(_points(batch["p"]), _points(batch["q"])).sum(axis=1)
                fits = (PERCENT * np.maximum(n, m) <= 100 * np.minimum(n, m)) & (bound >= _least_overlap(n + m))
                long = batch["fp"].str.len().to_numpy() * batch["fq"].str.len().to_numpy() > 0
                for i in np.flatnonzero(fits & long):
                    fits[i] = _fine_overlap(batch["fp"].iat[i], batch["fq"].iat[i]) >= _least_overlap(n[i] + m[i])
                yield batch.loc[fits, ["a", "b"]]
        batch = None
        give_back()

    one = facts.select(F.col("rep").alias("a"), "n", F.col("point").alias("p"), F.col("fine").alias("fp"))
    two = facts.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("point").alias("q"), F.col("fine").alias("fq"))
    few = broadcast_if_small(pairs, MOST_PAIRS)
    if few is not pairs:  # else all points would be shuffled for a few pairs
        two = two.join(F.broadcast(few.select("b").distinct()), "b", "left_semi")
    joined = one.join(few, "a").join(two, "b").select("a", "b", "n", "m", "p", "q", "fp", "fq")
    return joined.mapInPandas(possible, f"a {kind}, b {kind}")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that are the smallest of their group, with all their columns.

    Groups are of texts: a row goes or stays by its own id and text (a digest of it), so
    unrelated texts of one id do not share a fate.  Of rows equal in both, one stays.  Rows
    without id, and texts without words, stay (they are in no group).
    """
    digest = F.unhex(F.md5(F.encode(docs[text], "UTF-8")))
    rows = docs.where(docs[doc_id].isNotNull()).select(docs[doc_id].alias("id"), digest.alias("key"), docs[text].alias("text"))
    groups = stored(
        jaccard_groups(rows, "key").where("n_shingles > 0").select("key", "component_id").distinct(), "groups"
    )
    counted = rows.select("id", "key").groupBy("id", "key").agg(F.count("*").alias("copies"))
    told = stored(counted.join(groups, "key"), "told")
    first = told.groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    judged = told.join(first, "component_id").withColumn("stays", F.struct("id", "key") == F.col("first"))
    judged = stored(judged.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "copies", "stays"), "judged")

    def at(few: DataFrame):
        return (docs[doc_id] == few["_id"]) & (digest == few["_key"])

    # else the texts would be shuffled for a few ids
    apart = broadcast_if_small(judged.where("not stays or copies > 1").select("_id", "_key"), MOST_PAIRS)
    repeated = broadcast_if_small(judged.where("stays and copies > 1").select("_id", "_key"), MOST_PAIRS)
    once = docs.join(repeated, at(repeated), "left_semi").dropDuplicates([doc_id, text])
    return docs.join(apart, at(apart), "left_anti").unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
