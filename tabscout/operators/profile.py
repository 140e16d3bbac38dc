"""Risk profile of a labelled table, and keys that group similar tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.schema import missing
from tabscout.table import LabelledTable

# Name fragments that mark time and identifier columns.
TEMPORAL_NAMES = ("date", "time", "year", "month", "day", "timestamp")
ID_NAMES = ("id", "index", "key", "identifier")


def name_flag(names: Column, fragments: tuple[str, ...]) -> Column:
    """True where any name of an ARRAY<STRING> holds one of the fragments."""
    words = F.array(*[F.lit(f) for f in fragments])
    return F.exists(names, lambda n: F.exists(words, lambda w: F.contains(F.lower(n), w)))


def complexity_score() -> Column:
    """Additive risk score of a profile row, capped at 1.

    Terms are added in a fixed order, as binary fractions make the order matter
    next to the thresholds that read this score.
    """
    zero = F.lit(0.0)
    terms = (
        F.when(F.col("num_rows") > 100_000, 0.1).otherwise(zero),
        F.when(F.col("num_features") > 50, 0.15).otherwise(zero),
        F.when(F.col("class_balance_ratio") < 0.3, 0.2)
        .when(F.col("class_balance_ratio") < 0.5, 0.1)
        .otherwise(zero),
        F.when(F.col("missing_ratio") > 0.2, 0.15)
        .when(F.col("missing_ratio") > 0.1, 0.08)
        .otherwise(zero),
        F.when(F.col("has_temporal_features"), 0.15).otherwise(zero),
        F.when(F.col("has_id_features"), 0.1).otherwise(zero),
        F.when(F.col("num_classes") > 10, 0.1).otherwise(zero),
    )
    score = zero
    for term in terms:
        score = score + term
    return F.least(F.lit(1.0), score)


def profile(t: LabelledTable) -> DataFrame:
    """One row; missing cells and class counts come from one aggregate by class.

    Every class contributes one row per task to the exchange, whatever the table
    size, and no second pass over the data is needed.
    """
    fields = t.df.schema.fields
    width = len(fields)
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in fields)
    textual = sum(isinstance(f.dataType, T.StringType) for f in fields)
    # An array stays flat where a chain of sums would nest as deep as the table is wide.
    gaps = F.size(F.filter(F.array(*[missing(f) for f in fields]), lambda gone: gone))
    by_class = t.df.groupBy(t.label.alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(gaps).alias("gaps")
    )
    known = F.col("class").isNotNull()
    row = by_class.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("num_rows"),
        F.lit(width - 1).cast("bigint").alias("num_features"),
        F.count("class").alias("num_classes"),
        F.min(F.when(known, F.col("n"))).alias("low"),
        F.max(F.when(known, F.col("n"))).alias("high"),
        F.sum("gaps").alias("gaps"),
    )
    names = F.array(*[F.lit(f.name) for f in fields])
    return row.select(
        F.lit(t.name).alias("dataset"),
        "num_rows",
        "num_features",
        "num_classes",
        F.when(F.col("num_classes") > 1, F.col("low").cast("double") / F.col("high"))
        .otherwise(1.0)
        .alias("class_balance_ratio"),
        F.coalesce(F.try_divide(F.col("gaps").cast("double"), F.col("num_rows") * width), F.lit(0.0)).alias(
            "missing_ratio"
        ),
        F.lit(numeric / width).alias("numeric_ratio"),
        F.lit(textual / width).alias("categorical_ratio"),
        name_flag(names, TEMPORAL_NAMES).alias("has_temporal_features"),
        name_flag(names, ID_NAMES).alias("has_id_features"),
    ).withColumn("complexity_score", complexity_score())


def dataset_type() -> Column:
    """``small|large _ imbalanced|balanced _ simple|complex`` of a profile row."""
    return F.concat_ws(
        "_",
        F.when(F.col("num_rows") < 5000, "small").otherwise("large"),
        F.when(F.col("class_balance_ratio") < 0.3, "imbalanced").otherwise("balanced"),
        F.when(F.col("complexity_score") < 0.3, "simple").otherwise("complex"),
    )


def profile_key() -> Column:
    """``small|large _ few|many _ balanced|imbalanced`` of a profile row."""
    return F.concat_ws(
        "_",
        F.when(F.col("num_rows") < 10_000, "small").otherwise("large"),
        F.when(F.col("num_features") < 20, "few").otherwise("many"),
        F.when(F.col("class_balance_ratio") > 0.5, "balanced").otherwise("imbalanced"),
    )


def describe_columns(t: LabelledTable) -> DataFrame:
    """``position, column, type, is_target``: the schema as a table."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.name == t.target)
        for i, f in enumerate(t.df.schema)
    ]
    return t.spark.createDataFrame(
        rows, "position int, column string, type string, is_target boolean"
    )


def preview(t: LabelledTable, rows: int = 5) -> DataFrame:
    """The first rows in key order."""
    return (t.df.orderBy(*t.select_key()) if t.key else t.df).limit(rows)
