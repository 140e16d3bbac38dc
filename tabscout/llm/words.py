"""Words of a text as columns: shared by the native operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: ASCII white space. Same characters as ``bytes.split()`` uses.
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, unchanged; an empty array for null, empty or blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shingles(tokens: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by a space; a shorter text is one run, no words give none."""
    size = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return (
        F.when(size == 0, F.array().cast("array<string>"))
        .when(size < n, F.array(F.array_join(tokens, " ")))
        .otherwise(runs)
    )
