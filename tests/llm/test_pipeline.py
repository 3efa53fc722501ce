"""The pipeline against each stage's brute force on a small input."""

import corpus_pipeline as C
from sealtrail.llm import langid, pieces
from test_decontaminate import shingles, words
from test_jaccard import brute

SF = "/root/testdata/sf0.001"


def test_stages_have_the_dealt_order():
    assert [name for name, _ in C.STAGES] == [
        "language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding",
    ]


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scorer = langid.fit(docs).scorer()
    rows = docs.collect()
    rows = [r for r, told in zip(rows, scorer.batch([r.text for r in rows])) if not told[3]]
    groups = brute([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    items = [shingles(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if not any(i and 100 * len(i & shingles(words(r.text))) >= 80 * len(i) for i in items)]
    out = {r.doc_id: r for r in C.run(spark, SF).collect()}
    assert set(out) == {r.doc_id for r in rows} and len(out) < docs.count()
    assert all(r.lossless and r.n_pieces == len(r.pieces) for r in out.values())
    vocabulary = pieces.Vocabulary.load()
    for row in rows:
        text = b"".join(vocabulary.decoded[i] for i in out[row.doc_id].pieces).decode()[1:]
        assert text == row.text or "[REDACTED]" in text


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
