"""Labelled tables with planted defects, generated on the executors.

Values depend on the row number and the seed only (a digest, or Box-Muller over
two digests), never on partitioning, so a table is the same at any parallelism.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.functions.hashing import first_by_hash

_STEPS = float(16**8)


def uniform(key: Column, stream: str, seed: int = 42) -> Column:
    """A number in [0, 1) from the row key and a stream name."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / _STEPS


def whole(key: Column, stream: str, low: int, high: int, seed: int = 42) -> Column:
    """An integer in [low, high)."""
    return (F.floor(uniform(key, stream, seed) * (high - low)) + low).cast("int")


def normal(key: Column, stream: str, seed: int = 42) -> Column:
    radius = F.sqrt(-2 * F.log(1 - uniform(key, stream + "/r", seed)))
    return radius * F.cos(2 * math.pi * uniform(key, stream + "/a", seed))


def exponential(key: Column, stream: str, scale: float, seed: int = 42) -> Column:
    return -scale * F.log(1 - uniform(key, stream, seed))


def _rows(source: SparkSession | DataFrame, n: int | None, id_column: str) -> DataFrame:
    """``n`` new row numbers, or the ids of an existing table."""
    if isinstance(source, DataFrame):
        return source.select(F.col(id_column).cast("bigint").alias("id"))
    return source.range(n)


def with_minority(df: DataFrame, name: str, count: int, seed: int = 42) -> DataFrame:
    """Adds a 0/1 column with exactly ``count`` ones, spread by digest order."""
    quotas = df.sparkSession.createDataFrame([(0, count)], "stratum int, quota bigint")
    ones = first_by_hash(
        df.select("id"), F.col("id").cast("string"), quotas, seed, F.lit(0)
    ).select("id", F.lit(1).alias(name))
    return df.join(ones, "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def leakage_table(
    source: SparkSession | DataFrame, n: int | None = 1000, seed: int = 42, id_column: str = "id"
) -> DataFrame:
    """``customer_id, age, income, credit_score, default, will_default``: a target copy."""
    i = F.col("id")
    return (
        _rows(source, n, id_column)
        .select(
            i.alias("customer_id"),
            whole(i, "age", 18, 80, seed).alias("age"),
            whole(i, "income", 20_000, 150_000, seed).alias("income"),
            whole(i, "credit_score", 300, 850, seed).alias("credit_score"),
        )
        .withColumn("default", (F.col("credit_score") < 600).cast("int"))
        .withColumn("will_default", F.col("default"))
    )


def imbalance_table(
    source: SparkSession | DataFrame, n: int | None = 2000, seed: int = 43, share: float = 0.03, id_column: str = "id"
) -> DataFrame:
    """``feature_1..5, target``: exactly ``share`` of the rows are positive."""
    rows = _rows(source, n, id_column)
    total = n if not isinstance(source, DataFrame) else rows.count()
    i = F.col("id")
    return with_minority(rows, "target", int(total * share), seed).select(
        *[normal(i, f"feature_{k}", seed).alias(f"feature_{k}") for k in (1, 2, 3)],
        (uniform(i, "feature_4", seed) * 100).alias("feature_4"),
        exponential(i, "feature_5", 2.0, seed).alias("feature_5"),
        "target",
    )


def clean_table(
    source: SparkSession | DataFrame, n: int | None = 500, seed: int = 44, text_target: bool = False, id_column: str = "id"
) -> DataFrame:
    """``height, weight, age, category``: balanced, no defect."""
    i = F.col("id")
    coin = (uniform(i, "category", seed) < 0.5).cast("int")
    return _rows(source, n, id_column).select(
        (170 + 10 * normal(i, "height", seed)).alias("height"),
        (70 + 15 * normal(i, "weight", seed)).alias("weight"),
        whole(i, "age", 18, 65, seed).alias("age"),
        (F.when(coin == 1, "A").otherwise("B") if text_target else coin).alias("category"),
    )


def wide_table(
    source: SparkSession | DataFrame, n: int | None = 12_000, seed: int = 45, features: int = 40, share: float = 0.08, id_column: str = "id"
) -> DataFrame:
    """``feature_0.., year, month, transaction_id, fraud, future_flag``: a noisy leak."""
    rows = _rows(source, n, id_column)
    total = n if not isinstance(source, DataFrame) else rows.count()
    i = F.col("id")
    noisy = F.col("fraud") + normal(i, "future_flag", seed) * 0.3
    return with_minority(rows, "fraud", int(total * share), seed).select(
        *[normal(i, f"feature_{k}", seed).alias(f"feature_{k}") for k in range(features)],
        whole(i, "year", 2020, 2024, seed).alias("year"),
        whole(i, "month", 1, 13, seed).alias("month"),
        i.alias("transaction_id"),
        "fraud",
        (noisy > 0.5).cast("int").alias("future_flag"),
    )


def multi_issue_table(
    source: SparkSession | DataFrame, n: int | None = 1500, seed: int = 46, share: float = 0.05, copies: int = 100, id_column: str = "id"
) -> DataFrame:
    """``user_id, feature_A..C, churned, churn_probability`` with repeated rows."""
    rows = _rows(source, n, id_column)
    total = n if not isinstance(source, DataFrame) else rows.count()
    i = F.col("id")
    base = with_minority(rows, "churned", int(total * share), seed).select(
        i.alias("user_id"),
        normal(i, "feature_A", seed).alias("feature_A"),
        normal(i, "feature_B", seed).alias("feature_B"),
        (uniform(i, "feature_C", seed) * 100).alias("feature_C"),
        "churned",
        F.col("churned").alias("churn_probability"),
    )
    return base.unionByName(base.where(F.col("user_id") < copies))


def drift_pair(spark: SparkSession, n: int = 800, seed: int = 47) -> tuple[DataFrame, DataFrame]:
    """Two similar tables: ``feat_1..3, label`` (10 %) and ``var_1..3, outcome`` (12 %)."""
    out = []
    for prefix, target, share, shift in (("feat", "label", 0.10, 0), ("var", "outcome", 0.12, 1)):
        i = F.col("id")
        out.append(
            with_minority(spark.range(n), target, int(n * share), seed + shift).select(
                *[normal(i, f"{prefix}_{k}", seed).alias(f"{prefix}_{k}") for k in (1, 2, 3)], target
            )
        )
    return out[0], out[1]
