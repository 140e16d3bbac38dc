"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm.neighbours import with_next
from tabscout.llm.words import shingles, words

#: Words of a shingle, and the share of all hashes that a sketch retains.
SHINGLE, FRACTION = 5, 1 / 8
#: Hexadecimal digits of a hash.
_DIGITS = 16


def limit(fraction: float) -> str:
    """The hash from which on nothing is retained, as its hexadecimal digits."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    return f"{int(fraction * 16**12):012x}" if fraction < 1 else "g"


def hashes(text: Column, n: int = SHINGLE) -> Column:
    """One hash per shingle: the first digits of its MD5."""
    return F.transform(shingles(text, n), lambda s: F.substring(F.md5(s.cast("binary")), 1, _DIGITS))


def retained(all_hashes: Column, fraction: float = FRACTION) -> Column:
    """The sketch: distinct hashes below the limit, ascending.

    A text with words but no such hash keeps its smallest one, so that short
    texts have a sketch too. The rule holds for unions as well: see ``merged``.
    """
    below = F.filter(all_hashes, lambda h: h < limit(fraction))
    least = F.when(F.size(all_hashes) > 0, F.array(F.array_min(all_hashes))).otherwise(all_hashes)
    return F.when(F.size(below) > 0, F.array_sort(F.array_distinct(below))).otherwise(least)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of both texts' shingles together, from their sketches alone."""
    return retained(F.array_union(a, b), fraction)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two sketches; 1 for two empty ones, 0 for one."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(a) + F.size(b) - common
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def contained(a: Column, b: Column) -> Column:
    """Share of the first text's shingles that the second has too; 1 for no shingles."""
    size = F.size(a)
    return F.when(size == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / size)


def edited_neighbours(docs: DataFrame, n: int = SHINGLE, fraction: float = FRACTION, key: str = "doc_id") -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document.

    Returns ``<key>, text, edited, sketch, edited_sketch, next_sketch``. The
    edited text has the last quarter of the code points (rounded down) replaced
    by as many from the start of the next document in key order, or all it has.
    Null texts are empty. Other columns are not read. No documents, no rows.
    """

    def derive(rows: DataFrame) -> DataFrame:
        size = F.length("text")
        cut = F.floor(size / 4).cast("int")
        edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring("next_text", F.lit(1), cut))
        return (
            rows.withColumn("edited", F.coalesce(edited, F.col("text")))
            .withColumn("words", words(F.col("text")))
            .withColumn("edited_words", words(F.col("edited")))
            .withColumn("sketch", hashes(F.col("words"), n))
            .withColumn("edited_sketch", hashes(F.col("edited_words"), n))
            .select(
                "range",
                "halo",
                key,
                "text",
                "edited",
                retained(F.col("sketch"), fraction).alias("sketch"),
                retained(F.col("edited_sketch"), fraction).alias("edited_sketch"),
            )
        )

    plain = docs.select(F.col(f"`{key}`").alias(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return with_next(plain, key, "text", derive, "sketch")
