"""Value counts per feature and class, and rank sums over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.lineage import stored
from tabscout.schema import as_number, as_text, blocks, melt, union_all

# Columns unpivoted in one pass; more columns mean more passes, each of which
# reads its own columns only.
_COLUMNS_PER_PASS = 40
#: Rows of a bucket within which values are ranked.
BUCKET_ROWS = 100_000
# Parts that a bucket is cut into: a square, for the search in two steps.
_STEP = 16
_BUCKETS = _STEP * _STEP


def value_counts(
    df: DataFrame, fields: Sequence[T.StructField], label: Column | None = None
) -> DataFrame:
    """``feature, value[, class], n`` over non-missing cells, values as text.

    Unpivoting multiplies rows, but the partial aggregate collapses them before
    the exchange, and repeated values never travel twice from one task.
    """
    keep = {} if label is None else {"class": label}
    parts = [melt(df, {f.name: as_text(f) for f in b}, keep) for b in blocks(fields, _COLUMNS_PER_PASS)]
    return (
        union_all(parts)
        .where("value IS NOT NULL" + ("" if label is None else " AND class IS NOT NULL"))
        .groupBy("feature", "value", *keep)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def rank_sums(
    df: DataFrame,
    fields: Sequence[T.StructField],
    label: Column,
) -> DataFrame:
    """``feature, class, n, rank_sum, tie_sum``: mid-rank sums of each class.

    Ranks are needed within a whole feature, but no task sees a whole feature:
    values are cut into ordered buckets of a counted size, ranked inside their bucket, and the
    ranks are shifted by the size of all lower buckets. The shift is applied to
    the per-bucket sums, so no row is joined back. ``tie_sum`` is the class's
    share of the sum of ``t**3 - t`` over groups of equal values.
    """
    numbers = {f.name: as_number(f) for f in fields}
    named = blocks(list(numbers), _COLUMNS_PER_PASS)
    counted = (
        union_all([melt(df, {n: numbers[n] for n in b}, {"class": label}) for b in named])
        .where("value IS NOT NULL AND class IS NOT NULL")
        .groupBy("feature", "value", "class")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = rank_buckets(counted)
    within = W.partitionBy("feature", "bucket")
    tie = F.sum("n").over(W.partitionBy("feature", "bucket", "value"))
    upto = F.sum("n").over(within.orderBy("value"))
    local = counted.withColumn("tie", tie).withColumn("upto", upto).withColumn(
        "mid", F.col("upto") - F.col("tie") + (F.col("tie") + 1) / 2
    )
    per_bucket = local.groupBy("feature", "bucket", "class").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("mid")).alias("rank_sum"),
        F.sum(F.col("n") * (F.col("tie").cast("double") * F.col("tie") - 1)).alias("tie_sum"),
    )
    # One row per bucket and class from here on.
    lower = F.sum("n").over(W.partitionBy("feature").orderBy("bucket")) - F.sum("n").over(
        W.partitionBy("feature", "bucket")
    )
    return (
        per_bucket.withColumn("lower", lower)
        .groupBy("feature", "class")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("rank_sum") + F.col("lower") * F.col("n")).alias("rank_sum"),
            F.sum("tie_sum").alias("tie_sum"),
        )
    )


def rank_buckets(counted: DataFrame, most: int = BUCKET_ROWS) -> DataFrame:
    """Rows ``feature, value, ...`` with ``bucket``, an array that orders a feature's values in groups.

    All rows of a value share a bucket, and buckets ascend with the values. Buckets
    are counted, and those with more than ``most`` rows are cut again at sketched quantiles of
    their own rows, until none is left that holds more and has two values. The least
    value of a bucket always parts from the others, so every cut helps. What is
    broadcast is one row of ``_BUCKETS`` numbers for each bucket that is too large.
    """
    steps = [i / _BUCKETS for i in range(_BUCKETS + 1)]
    rows = stored(counted.withColumn("bucket", F.array().cast("array<int>")))
    while True:
        sizes = rows.groupBy("feature", "bucket").agg(
            F.count(F.lit(1)).alias("held"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        large = stored(sizes.where((F.col("held") > most) & (F.col("low") < F.col("high"))).select("feature", "bucket"))
        if large.isEmpty():
            return rows
        edges = stored(
            rows.join(F.broadcast(large), ["feature", "bucket"])
            .groupBy("feature", "bucket")
            .agg(F.percentile_approx("value", steps, 10 * _BUCKETS).alias("edges"))
        )
        coarse = _below(F.col("value"), F.lit(0), _STEP) * _STEP
        placed = (
            rows.join(F.broadcast(edges), ["feature", "bucket"], "left")
            .withColumn("coarse", coarse)
            .withColumn("fine", F.col("coarse") + _below(F.col("value"), F.col("coarse"), 1))
            # The least value stands alone; whether any other edge lies below a value is up to the sketch.
            .withColumn("own", F.when(F.col("value") > F.get("edges", F.lit(0)), F.col("fine") + 1).otherwise(0))
        )
        rows = stored(placed.withColumn("bucket", F.concat("bucket", F.array(F.coalesce("own", F.lit(0))))).drop("coarse", "fine", "own", "edges"))


def _below(value: Column, offset: Column, step: int) -> Column:
    """How many of fifteen of the ``edges``, ``step`` apart from ``offset`` on, lie below the value.

    Done with wide and then with narrow steps, this finds the value's bucket among
    quantile edges: buckets hold about equally many rows and never fall as the
    value rises. Sketched edges may be inexact: any edges keep the order.
    """
    places = [F.get("edges", offset + F.lit(i * step)) for i in range(1, _STEP)]
    return reduce(lambda a, b: a + b, [(edge < value).cast("int") for edge in places])
