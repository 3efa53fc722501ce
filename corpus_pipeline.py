"""A training corpus from raw documents: language, near-duplicates, contamination, secrets, tokens.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over everything the one before
kept; ``run`` writes each result as Parquet to the shared folder and reads it again for the
next.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sealtrail.llm import decontaminate, jaccard, langid, pieces, secrets
from sealtrail.sources.scratch import stored


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those that the models reject go.

    The models are fitted on ``documents`` (a bounded sample), so that they do not depend on
    what is handed in.  Null texts and texts without letters are rejected.
    """
    models = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return langid.identify(docs, models, out="_language").where("not _language.rejected").drop("_language")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates."""
    return jaccard.keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to 80 % or more."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` counted again."""
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, and whether decoding gives its text again."""
    cut = pieces.decode(pieces.encode(docs, out="pieces"), out="_decoded")
    lossless = F.col("_decoded").eqNullSafe(F.col("text"))
    return cut.select("doc_id", "lang", "source", "pieces", F.size("pieces").cast("long").alias("n_pieces"), lossless.alias("lossless"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("SentencePiece encoding and decoding", tokenised),
]

#: SQL can express neither the language models nor sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
