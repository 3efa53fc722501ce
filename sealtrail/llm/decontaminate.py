"""Benchmark decontamination: short test items found inside long documents, all native.

The index is a MinHash sketch per item, partitioned by item size.  An item of ``n`` distinct
shingles is contained if at least ``need = ceil(0.8 n)`` of them occur in a document.  Its
sketch is its ``n - need + 1`` smallest shingle hashes: a document that has ``need`` shingles
of the item cannot miss all of these, so the search loses nothing (estimating containment
from document-side signatures would, as a document may be a thousand times an item's size).
The item's size fixes the sketch's length.  Candidates are verified by exact shingle containment.

Documents are read twice and never shuffled as texts unless candidates are too many to
broadcast; only hashes that hit the index travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from sealtrail.llm import bloom
from sealtrail.llm.grams import gram_hashes, word_hashes
from sealtrail.plans.joins import BROADCAST_ROWS, broadcast_if_small
from sealtrail.sources.scratch import stored

SHINGLE = 5
PERCENT = 80


def item_shingles(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, part, width, n, need, h, sketch): the distinct shingles of each item.

    ``width`` is 5, or the number of words of a shorter item, whose only shingle is the whole
    of it.  ``part`` is the size partition, the power of two below ``n``.
    """
    hashed = items.select(F.col(item_id).alias("item"), word_hashes(F.col(text)).alias("w")).where(F.size("w") > 0)
    shingles = F.lit(None)
    for k in range(1, SHINGLE + 1):
        width = F.size("w") >= k if k == SHINGLE else F.size("w") == k
        shingles = F.when(width, gram_hashes(F.col("w"), k)).otherwise(shingles)
    each = (
        hashed.select("item", F.least(F.size("w"), F.lit(SHINGLE)).alias("width"), F.explode(shingles).alias("h"))
        .distinct()
    )
    whole, ranked = Window.partitionBy("item"), Window.partitionBy("item").orderBy("h")
    need = F.expr(f"({PERCENT} * n + 99) div 100")
    return (
        each.withColumn("n", F.count("*").over(whole))
        .withColumn("need", need)
        .withColumn("part", F.floor(F.log2("n")).cast("int"))
        .withColumn("sketch", F.row_number().over(ranked) <= F.col("n") - F.col("need") + 1)
    )


def _document_shingles(docs: DataFrame, widths: list[int]) -> DataFrame:
    """(doc, width, h): distinct shingles of each document row."""
    hashed = docs.select(F.col("doc"), word_hashes(F.col("text")).alias("w"))
    kinds = F.array(*[
        F.struct(F.lit(k).alias("width"), F.array_distinct(gram_hashes(F.col("w"), k)).alias("hs")) for k in widths
    ])
    return hashed.select("doc", F.inline(kinds)).select("doc", "width", F.explode("hs").alias("h"))


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of which a document holds 80 % or more.

    Words are runs of non-blanks, lower-cased; a shingle is five of them.  An item of fewer
    words is one shingle, its whole sequence; items without words (or null) match nothing, nor
    do null or empty texts.  ``doc_id`` names a document: rows that share one (null included)
    count as parts of one document; rows of one ``item_id`` as parts of one item.  Other
    columns of either table are not looked at.
    """
    texts = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    index = stored(item_shingles(items, item_id, item_text), "items")
    facts = index.agg(F.collect_set("width").alias("widths"), F.count("*").alias("rows")).first()
    widths, small = sorted(facts["widths"]) or [SHINGLE], facts["rows"] <= BROADCAST_ROWS

    sketch = index.where("sketch").select("width", "h", "item")
    probes = _document_shingles(texts, widths)
    if small:
        sketch = F.broadcast(sketch)
    else:  # too large to send everywhere: a filter of bounded size thins the probes first
        probes = bloom.possible(probes, "h", bloom.build(sketch, "h"))
    # a document's size says nothing here, as it may be spread over rows
    found = probes.join(sketch, ["width", "h"])
    candidates = stored(found.select("doc", "item").distinct(), "contaminated")
    return _verified(texts, candidates, index, widths).select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "n_shared", "n_item"
    )


def _verified(texts: DataFrame, candidates: DataFrame, index: DataFrame, widths: list[int]) -> DataFrame:
    """Exact containment of the candidates, from the shingles of their documents alone."""
    few = broadcast_if_small(candidates.select("doc").distinct())
    wanted = few.select(F.col("doc").alias("wanted"))
    suspects = texts.join(wanted, texts["doc"].eqNullSafe(wanted["wanted"]), "left_semi")
    have = _document_shingles(suspects, widths).select("doc", "width", "h").distinct()
    asked = index.select(F.col("item").alias("of"), F.col("width").alias("w"), F.col("h").alias("part_of"), "n", "need")
    expected = candidates.join(asked, F.col("item").eqNullSafe(F.col("of"))).withColumnRenamed("doc", "candidate")
    shared = have.join(
        expected,
        (F.col("h") == F.col("part_of")) & (F.col("width") == F.col("w")) & F.col("doc").eqNullSafe(F.col("candidate")),
    )
    return (
        shared.groupBy("doc", "item", "n", "need")
        .agg(F.count("*").alias("n_shared"))
        .where("n_shared >= need")
        .withColumn("n_item", F.col("n"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs`` that hold no item; all columns stay.

    Each row is judged by its own text (equal texts by one digest), whatever its id: rows of
    one id, or without id, neither add up nor share a fate.
    """
    digest = F.unhex(F.md5(F.encode(docs[text], "UTF-8")))
    keyed = docs.select(digest.alias("row"), docs[text].alias("text"))
    found = contaminated(keyed, items, "row").select(F.col("row").alias("_contaminated")).distinct()
    bad = broadcast_if_small(found)
    return docs.join(bad, digest == bad["_contaminated"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Brute force: every document shingle against every item shingle.
ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+4], ' '))) AS g
  FROM w WHERE len(ws) >= 5
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM benchmark
), i AS (
  SELECT DISTINCT item_id, unnest(list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i+4], ' '))) AS g
  FROM iw WHERE len(ws) >= 5
), n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, n_item
FROM s JOIN i USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item
"""
