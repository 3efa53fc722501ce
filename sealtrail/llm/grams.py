"""Words and word n-grams as native expressions."""

from pyspark.sql import Column, functions as F

#: Words are runs of anything but these characters (blank, tab to carriage return).
BLANKS = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANKS, -1), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, n: int) -> Column:
    """Hashes of the n-grams over an array of word hashes (a column, not an expression)."""
    return F.when(
        F.size(hashes) >= n,
        F.transform(
            F.sequence(F.lit(1), F.size(hashes) - (n - 1)),
            lambda i: F.xxhash64(*[F.element_at(hashes, i + k) for k in range(n)]),
        ),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
