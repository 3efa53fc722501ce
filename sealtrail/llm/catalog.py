"""Registered queries of this subpackage: name -> (run, DuckDB twin or None)."""

import corpus_pipeline
from sealtrail.llm import decontaminate, embeddings, jaccard, langid, negatives, packing, pieces, secrets, substrings, toxicity, trie, urls, warc

QUERIES = {
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op1_url_filter": (urls.query, urls.ORACLE),
    "op2_substring_dedup": (substrings.query, None),
    "op3_warc": (warc.query, warc.ORACLE),
    "op4_sentencepiece": (pieces.query, None),
    "op5_embedding_dedup": (embeddings.query, None),
    "op6_ngram_jaccard": (jaccard.query, None),
    "op7_toxicity": (toxicity.query, None),
    "op8_language_id": (langid.query, None),
    "op9_decontamination": (decontaminate.query, decontaminate.ORACLE),
    "op10_secret_scan": (secrets.query, None),
    "op11_best_fit_packing": (packing.query, None),
    "op12_prefix_trie": (trie.query, trie.ORACLE),
    "op13_hard_negatives": (negatives.query, negatives.ORACLE),
}
