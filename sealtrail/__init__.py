"""Tamper-evident event histories on Spark.

``functions``  Column-to-Column building blocks (hashing, text, envelopes)
``sources``    wire readers, append-only tables, adapters for sample tables
``operators``  ingest, redact, chain, verify, search, anchor, retain, export
``plans``      skew-safe ordering and the registered query catalogue
``streaming``  Structured Streaming ingest and anchoring
"""
