"""Bounded training samples, chosen by hash and so the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def remainder(key: Column, modulus: int) -> Column:
    """``crc32(key as text) mod modulus``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def smallest_hashes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` keys with the smallest hashes: a top-k, at most ``limit`` narrow rows."""
    hashed = rows.select(key).where(F.col(key).isNotNull()).distinct()
    return hashed.orderBy(F.xxhash64(F.col(key), F.lit("sample")), key).limit(limit)
