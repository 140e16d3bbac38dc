"""Licence scan by canonical digests: texts that differ only in layout or spelling meet in one hash join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.llm.license_texts import DIGESTS, NOTICES, TEXTS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINE_END = r"\r\n|\r|\n"
#: ASCII characters that are neither lower-case letters nor digits, once capitals are lowered.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Quotation marks and dashes outside ASCII; each counts as a space.
MARKS = "“”‘’«»‐–—"
# Spellings that count as one, written as they read after lowering.
SPELLINGS = (
    ("©", "(c)"),
    ("&", " and "),
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub-license", "sublicense"),
    ("sub license", "sublicense"),
    ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"),
    ("organis", "organiz"),
    ("authoris", "authoriz"),
    ("recognis", "recogniz"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"),
)
#: Canonical lines that name an owner or a year and nothing of the terms.
COPYRIGHT = r"^(portions )?(copyright (c|[0-9]{4}|year|yyyy|by|the regents)|c (copyright )?([0-9]{4}|year|yyyy))( .*)?$|^all rights reserved( .*)?$"


def canonical_line(line: Column) -> Column:
    """A line in lower case with one spelling and one space for all punctuation; '' for a copyright line."""
    plain = F.translate(line, UPPER, LOWER)
    for found, put in SPELLINGS:
        plain = F.replace(plain, F.lit(found), F.lit(put))
    plain = F.trim(F.regexp_replace(F.translate(plain, MARKS, " " * len(MARKS)), PUNCTUATION, " "))
    return F.regexp_replace(plain, COPYRIGHT, "")


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without those that came out empty; null texts have none."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), LINE_END), canonical_line)
    return F.array_remove(lines, "")


def canonical(lines: Column) -> Column:
    return F.array_join(lines, " ")


def digest(canonical_text: Column) -> Column:
    """MD5 of a canonical text; none for an empty one."""
    return F.when(canonical_text != "", F.md5(canonical_text.cast("binary")))


def known_licenses(spark: SparkSession) -> DataFrame:
    """``known_digest, license``: one row per known text, some thirty in all."""

    def rows(values: tuple[tuple[str, str], ...], second: str) -> DataFrame:
        pairs = [F.struct(F.lit(a).alias("license"), F.lit(b).alias(second)) for a, b in values]
        return spark.range(1).select(F.inline(F.array(*pairs)))

    texts = rows(TEXTS, "text").select(digest(canonical(canonical_lines(F.col("text")))).alias("known_digest"), "license")
    return texts.unionByName(rows(DIGESTS, "known_digest")).distinct()


def scan_licenses(
    docs: DataFrame, known: DataFrame | None = None, notices: tuple[tuple[str, str], ...] = NOTICES, key: str = "doc_id"
) -> DataFrame:
    """Per document ``<key>, canonical_digest, canonical_chars, license, notices, n_notice_lines``.

    ``license`` is the known licence whose canonical text the whole document
    is, else null; ``notices`` names, sorted and without repeats, the licences
    of single lines that are known notices. ``known`` has a row per licence
    text (``known_digest, license``), distinct digests; it is broadcast, as its
    size is that of the published list and not of the corpus. Documents never
    move. Null, empty or punctuation-only texts have no digest and no licence.
    Repeated rows each give a row; other columns are not read.
    """
    known = known_licenses(docs.sparkSession) if known is None else known
    lines = docs.select(F.col(f"`{key}`").alias(key), canonical_lines(F.col("text")).alias("lines"))
    whole = lines.select(
        key,
        canonical(F.col("lines")).alias("whole"),
        F.array_compact(F.transform("lines", lambda line: _notice(line, notices))).alias("found"),
    )
    scanned = whole.select(
        key,
        digest(F.col("whole")).alias("canonical_digest"),
        F.length("whole").cast("bigint").alias("canonical_chars"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
        F.size("found").cast("bigint").alias("n_notice_lines"),
    )
    return scanned.join(F.broadcast(known), F.col("canonical_digest") == F.col("known_digest"), "left").select(
        key, "canonical_digest", "canonical_chars", "license", "notices", "n_notice_lines"
    )


def _notice(line: Column, notices: tuple[tuple[str, str], ...]) -> Column:
    """The licence of a canonical line that is a known notice, else null."""
    forms = {plain_canonical(text): license_ for license_, text in notices}
    out = F.lit(None).cast("string")
    for form, license_ in forms.items():
        out = F.when(line == form, license_).otherwise(out)
    return F.when(F.length(line).between(min(map(len, forms)), max(map(len, forms))), out)


def plain_canonical(line: str) -> str:
    """The canonical form of one known line, to be put into a plan as a literal."""
    plain = line.translate(str.maketrans(UPPER, LOWER))
    for found, put in SPELLINGS:
        plain = plain.replace(found, put)
    plain = re.sub(PUNCTUATION, " ", plain.translate(str.maketrans(MARKS, " " * len(MARKS)))).strip(" ")
    return re.sub(COPYRIGHT, "", plain)
