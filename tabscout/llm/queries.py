"""One query per operator: the operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tabscout.llm.defaults import table, tokenizer_file
from tabscout.llm.fingerprint import contained, edited_neighbours, likeness
from tabscout.llm.lexical import search
from tabscout.llm.licenses import scan_licenses
from tabscout.llm.minhash import near_duplicates
from tabscout.llm.mixing import mix
from tabscout.llm.ordinal import fit_grades, grade, quality_grade
from tabscout.llm.packing import pack
from tabscout.llm.rules import judge
from tabscout.llm.sharding import balanced_shards, text_bytes
from tabscout.llm.substring import remove_repeats
from tabscout.llm.vantage import nearest
from tabscout.llm.warc import round_trip
from tabscout.llm.whitening import whiten
from tabscout.llm.words import words

Query = Callable[[SparkSession, str], DataFrame]


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of 13-word windows that earlier documents have."""
    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.array_join(words(F.col("text")), " "), 256).alias("kept_sha256")
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weights and sampling probabilities of all documents by source, language and topic."""
    return mix(table(spark, sf_dir, "documents")).withColumns(
        {c: F.round(c, 9) for c in ("weight", "probability")}  # sums of doubles differ in the last digits
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in power-of-two pieces of at most 2048 tokens, one sequence each."""
    return pack(table(spark, sf_dir, "documents"), tokenizer_file()).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives with revisit records, and what the archives say of each."""
    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other rows of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents that are a known licence text, and licence notices inside documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and how alike they are."""
    rows = edited_neighbours(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", ".").alias("fingerprint"),
        F.array_join("edited_sketch", ".").alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        contained(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
        contained(F.col("sketch"), F.col("next_sketch")).alias("contained_next"),
    )


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 0.8 of their pairs of words."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of the highest grade for every document."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    graded = grade(documents.select("doc_id", "text"), fit_grades(documents, labels))
    return graded.select("doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= 0.5).alias("kept"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of nearly equal bytes."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        text_bytes(F.col("text"), 16).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return balanced_shards(documents, ["doc_id", "text_crc32"], "size", 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, votes of the rules, probability of being good and verdict of all documents."""
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"),
        F.round("quality", 6).alias("quality"),  # logarithms differ in the last digits
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the four largest principal axes, at unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTRY: dict[str, Query] = {
    "op1_substring": op1_substring,
    "op2_mixing": op2_mixing,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_nearest": op5_nearest,
    "op6_licenses": op6_licenses,
    "op7_fingerprints": op7_fingerprints,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_rules": op11_rules,
    "op12_whitening": op12_whitening,
    "op13_lexical": op13_lexical,
    "pipeline": corpus_pipeline.run,
}
