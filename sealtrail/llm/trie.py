"""The trie of conversation prefixes, with totals of every subtree by parallel tree contraction.

A node is a distinct sequence of turns that some conversation begins with.  Sequences are told
apart by 128 bits: each turn's digest is mixed with its place and the results are combined by
exclusive or, which needs no order, so prefixes of a very long conversation are computed in
blocks of its turns.  A node's name is its smallest member and its depth.

Totals are found in rounds of joins.  *Rake*: all leaves of what is left of the tree add their
totals to their parents and go.  *Compress*: in chains of nodes with a single child, nodes whose
depth has a certain bit set and whose parent's has not are spliced out (never two neighbours,
half of a fresh chain); the edge that replaces a node keeps what it would have added.  The rounds
needed grow with the logarithm of the tree's size, not with its depth.  *Expand*: backwards
through the rounds, a spliced node's total follows from that of the child it was spliced onto.
Every round is written to the shared folder, so a lost executor repeats one at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from sealtrail.sources.scratch import stored

#: Turns of a conversation whose prefixes are combined at a time.
BLOCK = 4_096
#: 2^CHUNK neighbouring conversation ids are joined to one text before texts are hashed in order.
CHUNK = 12
#: Parents with over a thousandth of all nodes as children (so at most 1,000) are broadcast.
HEAVY = 1_000
WORD = r"[^\x20\x09-\x0D]+"

_NODE = ["depth", "x", "y"]


def digested(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, a, b, words, row): a narrow row for each turn, ``a`` and ``b`` 120 bits of its SHA-256.

    A null role or text counts as empty; rows without conversation take no part.
    """
    told = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    whole = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    bits = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    rows = told.select("conv", "turn", whole.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    return stored(rows.select("conv", "turn", bits(1).alias("a"), bits(16).alias("b"), "words", F.monotonically_increasing_id().alias("row")), "turns")


def _ranged(turns: DataFrame) -> DataFrame:
    """``turns`` with ``part``: consecutive ranges of their order, as many as there are shuffle partitions."""
    return stored(
        turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "a", "b", "row").withColumn("part", F.spark_partition_id()), "ranged"
    )


def _parts(ranged: DataFrame) -> DataFrame:
    """(conv, part, before): turns of the conversation in the ranges before."""
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return counts.select("conv", "part", "n", F.coalesce(before, F.lit(0)).alias("before"))


def _numbered(ranged: DataFrame, parts: DataFrame) -> DataFrame:
    """Turns with ``pos`` from 1, by turn (null first), then digest; other columns of ``parts`` come along."""
    own = F.row_number().over(W.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "a", "b", "row"))
    joined = ranged.withColumn("own", own).join(parts.drop("n"), ["conv", "part"])
    return joined.withColumn("pos", F.col("own") + F.col("before")).drop("own", "before", "part", "row", "turn")


def _members(rows: DataFrame) -> DataFrame:
    """(conv, depth, x, y, px, py, words, last): the node of each prefix of each conversation, and its parent's key."""
    mixed = rows.select(
        "conv", "depth", "words", ((F.col("depth") - 1) / BLOCK).cast("long").alias("block"),
        F.xxhash64("depth", "a", "b").alias("hx"), F.xxhash64("b", F.lit("y"), "depth", "a").alias("hy"),
    )
    order = W.partitionBy("conv").orderBy("block")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    blocks = mixed.groupBy("conv", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"), F.max("depth").alias("top")).select(
        "conv", "block", F.coalesce(F.bit_xor("bx").over(earlier), F.lit(0)).alias("bx"), F.coalesce(F.bit_xor("by").over(earlier), F.lit(0)).alias("by"),
        F.max("top").over(W.partitionBy("conv")).alias("top"),
    )
    so_far = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inner = mixed.withColumns({"x": F.bit_xor("hx").over(so_far), "y": F.bit_xor("hy").over(so_far)}).join(blocks, ["conv", "block"])
    return inner.select(
        "conv", "depth", "words", (F.col("depth") == F.col("top")).alias("last"),
        *[F.col(c).bitwiseXOR(F.col(f"b{c}")).alias(c) for c in "xy"],
        *[F.col(c).bitwiseXOR(F.col(f"b{c}")).bitwiseXOR(F.col(f"h{c}")).alias(f"p{c}") for c in "xy"],
    )


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256) of the conversations (``conv``) that end at each node, in ascending order.

    A hash over a sequence is one task's work; it reads texts of many ids each, one at a time.
    """
    chunk = ends.groupBy(*_NODE, F.shiftright("conv", CHUNK).alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")
    )
    chunks = stored(chunk, "ends")
    per_node = chunks.groupBy(*_NODE).agg(F.count("*").alias("n"), F.min("ids").alias("ids"))
    single = per_node.where("n = 1").select(*_NODE, F.sha2("ids", 256).alias("ends_sha256"))
    several = chunks.join(per_node.where("n > 1").select(*_NODE), _NODE, "left_semi")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, digest = None, None
        for batch in batches:
            done = []
            for *here, ids in zip(*(batch[c] for c in (*_NODE, "ids"))):
                if here != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = here, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=[*_NODE, "ends_sha256"])
        if node:
            yield pd.DataFrame([(*node, digest.hexdigest())], columns=[*_NODE, "ends_sha256"])

    ordered = several.repartition(*[F.col(c) for c in _NODE]).sortWithinPartitions(*_NODE, "chunk")
    return single.unionByName(ordered.mapInPandas(fold, "depth long, x long, y long, ends_sha256 string"))


def _tree(members: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with their parent's name and number of children."""
    root = conversations.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    nodes = stored(
        members.groupBy(*_NODE).agg(
            F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.min("words").alias("words"),
            F.min("px").alias("px"), F.min("py").alias("py"),
        ).unionByName(root.select(
            *[F.lit(0).cast("long").alias(c) for c in _NODE], "conv_id", "n_convs", F.lit(0).cast("long").alias("words"),
            F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"),
        )),
        "nodes",
    )
    children = stored(
        nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"))
        .agg(F.count("*").alias("n_children")), "children",
    )
    counted = stored(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long")), "counted")
    most = max(HEAVY, nodes.count() // HEAVY)  # fewer than HEAVY parents have more children
    parent = counted.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), "n_children"
    )
    key = ["depth", "px", "py"]
    heavy = F.broadcast(parent.where(F.col("n_children") > most).drop("n_children"))
    told = counted.join(heavy, key, "left")
    rest = told.where("parent_conv_id is null").drop("parent_conv_id").join(
        parent.where(F.col("n_children") <= most).drop("n_children"), key, "left"
    )
    return stored(told.where("parent_conv_id is not null").unionByName(rest), "tree")


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, depth, *values): sums over the subtree of every node, the node included.

    ``tree`` has a row per node, named by ``conv_id`` and ``depth``, with ``parent_conv_id`` (null for
    roots) at the depth before; any number of roots.
    """
    own, extra = values, [f"e_{v}" for v in values]
    deepest = tree.agg(F.max("depth")).first()[0]
    if deepest is None:
        return tree.select("conv_id", "depth", *values)
    bits = max(1, int(deepest).bit_length())
    zero = F.lit(0).cast("long")
    live = tree.select(
        F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("parent_conv_id").alias("pc"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("depth") - 1).alias("pd"), *[F.col(v).cast("long").alias(v) for v in own], *[zero.alias(e) for e in extra],
    )
    rounds: list[tuple[DataFrame, DataFrame]] = []
    number = 0
    while True:
        kids = live.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(F.count("*").alias("kids"))
        marked = stored(live.join(kids, ["c", "d"], "left"), "marked")
        leaves = marked.where("kids is null")
        raked = leaves.where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
            F.count("*").alias("raked"), *[F.sum(F.col(v) + F.col(e)).alias(f"r_{v}") for v, e in zip(own, extra)]
        )
        added = {v: F.col(v) + F.coalesce(f"r_{v}", zero) for v in own}
        single = (F.col("kids") - F.coalesce("raked", zero)) == 1
        bit = lambda depth: F.shiftright(depth, number % bits).bitwiseAND(F.lit(1)) == 1  # noqa: B023, E731
        goes = F.col("pc").isNotNull() & single & bit("d") & ~bit("pd")
        inner = marked.where("kids is not null").join(raked, ["c", "d"], "left").withColumns({**added, "goes": F.coalesce(goes, F.lit(False))})
        gone = inner.where("goes").select(
            F.col("c").alias("pc"), F.col("d").alias("pd"), F.col("pc").alias("gc"), F.col("pd").alias("gd"),
            *[F.col(v).alias(f"g_{v}") for v in own], *[F.col(e).alias(f"g_{e}") for e in extra],
        )
        kept = inner.where("not goes").join(gone, ["pc", "pd"], "left")
        # g_*: what the spliced node's total is more than the child's; its name is (vc, vd)
        spliced = F.col("gc").isNotNull()
        after = stored(kept.select(
            "c", "d", F.coalesce("gc", "pc").alias("pc"), F.coalesce("gd", "pd").alias("pd"), *own,
            *[(F.col(e) + F.coalesce(F.col(f"g_{v}") + F.col(f"g_{e}"), zero)).alias(e) for v, e in zip(own, extra)],
            F.when(spliced, F.col("pc")).alias("vc"), F.when(spliced, F.col("pd")).alias("vd"),
            *[(F.col(f"g_{v}") + F.col(e)).alias(f"more_{v}") for v, e in zip(own, extra)],
        ), "live")
        rounds.append((marked, after))
        number += 1
        left = after.agg(F.count("*").alias("n"), F.count("vc").alias("spliced")).first()
        rounds[-1] += (left["spliced"],)
        if not left["n"]:
            break
        live = after.drop("vc", "vd", *[f"more_{v}" for v in own])
    totals = None
    for marked, after, n_spliced in reversed(rounds):
        parts = [marked.where("kids is null").select("c", "d", *own)]
        if n_spliced:
            onto = after.where("vc is not null").select("c", "d", "vc", "vd", *[f"more_{v}" for v in own])
            parts.append(stored(onto.join(totals, ["c", "d"]).select(
                F.col("vc").alias("c"), F.col("vd").alias("d"), *[(F.col(v) + F.col(f"more_{v}")).alias(v) for v in own]
            ), "expanded"))
        for part in parts:
            totals = part if totals is None else totals.unionByName(part)
    return totals.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), *own)


def _trie(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The trie of numbered turns (conv, depth, a, b, words) of ``conversations`` (conv)."""
    rows = stored(rows.select("conv", "depth", "a", "b", "words"), "rows")
    members = stored(_members(rows), "members")
    turnless = conversations.join(rows.where("depth = 1"), "conv", "left_anti")
    ends = members.where("last").select(*_NODE, "conv").unionByName(
        turnless.select(*[F.lit(0).cast("long").alias(c) for c in _NODE], "conv")
    )
    tree = _tree(members, conversations)
    own = tree.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
    })
    sums = subtree_sums(own, ["n_leaves", "saved_tokens"])
    return (
        tree.join(sums, ["conv_id", "depth"])
        .join(_end_hashes(ends), _NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        )
    )


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per distinct sequence of first turns of ``conversations``, from the empty one on.

    ``conv_id`` (smallest member) and ``depth`` name a node; ``parent_conv_id`` with the depth before
    its parent (null for the root).  ``n_convs`` counts its members, ``n_children`` its children;
    over its subtree ``n_leaves`` counts childless nodes and ``saved_tokens`` adds what sharing saves:
    (members - 1) x words of the node's last text.  ``ends_sha256`` hashes the ids, ascending and
    joined by commas, of the conversations that end at the node.

    Turns are ordered by ``turn`` (null first), equal ones by the digest of role and text; repeated
    rows are turns of their own.  Null roles and texts are empty, a missing word counts 0.  Rows
    without ``conv_id`` take no part; ids are integers.  Other columns are not looked at.  An empty
    table has no nodes.
    """
    ranged = _ranged(digested(conversations, conv_id, turn, role, text))
    parts = stored(_parts(ranged), "parts")
    return _trie(_numbered(ranged, parts).withColumnRenamed("pos", "depth"), parts.select("conv").distinct())


#: The query's conversations share their first turns with the first of each ``FAMILY`` ids.
FAMILY, MOST_SHARED = 20, 4


def _family_shared(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("long")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """:func:`prefix_trie` of conversations whose first turns are replaced by those of their family's first.

    Conversation c takes the first h = crc32(c) mod 4 turns of conversation c - c % 20 (all if it
    has fewer, none if it is absent), then its own turns after its first h.
    """
    ranged = _ranged(digested(conversations))
    parts = stored(_parts(ranged), "parts")
    first = F.col("conv") % FAMILY == 0
    heads = stored(_numbered(ranged.where(first), parts.where(first)).where(F.col("pos") < MOST_SHARED), "heads")
    there = heads.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("there"))
    convs = parts.select("conv").distinct().withColumns({"h": _family_shared(F.col("conv")), "base": F.col("conv") - F.col("conv") % FAMILY})
    convs = stored(convs.join(there, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0)))).drop("there"), "convs")
    taken = convs.join(heads.withColumnRenamed("conv", "base"), "base").where("pos <= h").withColumnRenamed("pos", "depth")
    own = _numbered(ranged, parts.join(convs.select("conv", "h", "k"), "conv")).where("pos > h")
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.col("k"))
    columns = ["conv", F.col("depth").cast("long").alias("depth"), "a", "b", "words"]
    return _trie(taken.select(*columns).unionByName(own.select(*columns)), convs.select("conv"))


def query(spark, sf_dir: str) -> DataFrame:
    return rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The remainder of a conversation id's CRC-32, bit by bit.
_CRC = """
xor(4294967295, list_reduce(
  list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda r, v: xor(xor(r, v) >> 1, 3988292384 * (xor(r, v) & 1))
)) % 4
"""

ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, {_CRC} AS h FROM (SELECT DISTINCT conv_id FROM t)
), b AS (
  SELECT c.conv_id, pos AS depth, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
), k AS (SELECT c.conv_id, h, count(depth) AS k FROM c LEFT JOIN b USING (conv_id) GROUP BY ALL
), r AS (
  SELECT * FROM b UNION ALL SELECT t.conv_id, pos - h + k, role, text FROM t JOIN k USING (conv_id) WHERE pos > h
), m AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
    string_agg(sha256(length(role) || ':' || role || text), ' ') OVER (PARTITION BY conv_id ORDER BY depth) AS key,
    depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM r
  UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM r) FROM c
), n AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM m GROUP BY depth, key
), p AS (
  SELECT n.*, q.conv_id AS parent_conv_id, q.key AS parent_key
  FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1 JOIN n q ON q.depth = m.depth AND q.key = m.key
  UNION ALL SELECT *, NULL, NULL FROM n WHERE depth = 0
), l AS (
  SELECT p.*, coalesce(kids, 0) AS n_children FROM p LEFT JOIN
    (SELECT depth - 1 AS depth, parent_key AS key, count(*) AS kids FROM p WHERE depth > 0 GROUP BY ALL) USING (depth, key)
), s AS (
  SELECT depth, key, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT DISTINCT a.depth, a.key, l.conv_id AS c, l.depth AS d, l.n_children, l.n_convs, l.words
        FROM l JOIN m a ON a.conv_id = l.conv_id AND a.depth <= l.depth) GROUP BY depth, key
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM l JOIN s USING (depth, key)
"""
