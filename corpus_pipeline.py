"""A training corpus from raw documents in five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns
of ``documents``; columns that a stage does not know are passed on.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.functions.lineage import shared_folder, stored
from tabscout.llm.defaults import table, tokenizer_file
from tabscout.llm.minhash import near_duplicates
from tabscout.llm.mixing import form_topic, mix
from tabscout.llm.ordinal import fit_grades, grade, quality_grade
from tabscout.llm.packing import pack
from tabscout.llm.substring import remove_repeats

#: A document stays if its probability of the highest grade is at least this.
LEAST_TAIL = 0.5
#: The column that numbers rows while near-duplicates are sought.
ROW = "__pipeline_row"
#: Word runs of near-duplicate sets, their least similarity in percent, words of a repeated passage.
SHINGLE, PERCENT, PASSAGE = 5, 80, 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the highest grade: neither toxic nor poor."""
    labels = table(spark, sf_dir, "labels").select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    graded = grade(docs, fit_grades(docs, labels))
    return graded.where(F.col("tail_probability") >= LEAST_TAIL).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Rows are numbered in the order of their ids, ties by text, so that rows that
    share an id are documents of their own: of equal rows one stays, and a text
    is not dropped for another text under its id.
    """
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    numbered = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id())
    numbered = stored(numbered)
    groups = near_duplicates(numbered.select(F.col(ROW).alias("doc_id"), "text"), SHINGLE, PERCENT)
    dropped = groups.where(~F.col("kept")).select(F.col("doc_id").alias(ROW))
    return numbered.join(dropped, ROW, "left_anti").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words and more that an earlier document has."""
    cut = remove_repeats(docs, PASSAGE)
    counted = F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", counted).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics.

    The draw depends on the id, the source, the language and the topic, so rows
    that share an id but not all of these are drawn each for itself.
    """
    drawn = ("doc_id", "source", "lang", "topic")
    dropped = mix(docs).where(~F.col("kept")).select(*[F.col(c).alias(f"_{c}") for c in drawn]).distinct()
    own = {"topic": form_topic(F.col("text"))}
    same = reduce(lambda a, b: a & b, [own.get(c, F.col(c)).eqNullSafe(F.col(f"_{c}")) for c in drawn])
    return docs.join(dropped, same, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths, at most 2048, none across documents."""
    return pack(docs, tokenizer_file())


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fitted grades, minima and token ids have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
