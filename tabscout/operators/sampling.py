"""Column and row samplers. Row order is a seeded digest of the row key, so a
sample is the same in every run, on every cluster, at every partitioning."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.frequency import value_counts
from tabscout.functions.hashing import first_by_hash
from tabscout.functions.quantiles import quantile_values
from tabscout.operators.binning import bin_number
from tabscout.schema import as_number, column, empty, measure_cells, union_all
from tabscout.table import LabelledTable

DEFAULT_ROWS = 10_000
DEFAULT_COLUMNS = 50


def score_columns(t: LabelledTable, budget: int = DEFAULT_COLUMNS) -> DataFrame:
    """``feature, kind, score, position, kept``: columns ranked for sampling.

    Numeric columns by variance, all others by distinct values; the budget is
    split between the kinds in proportion to their number.
    """
    schema = "feature string, kind string, score double, place int"
    others = [f for f in t.features if f not in t.numeric]
    place = {f.name: i for i, f in enumerate(t.features)}
    places = F.create_map(*[x for n, i in place.items() for x in (F.lit(n), F.lit(i))])
    parts = [empty(t.spark, schema)]
    if t.numeric:
        variance = measure_cells(
            t.df, {f.name: as_number(f) for f in t.numeric}, lambda value: {"score": F.var_samp(value)}, "score double"
        )
        parts.append(
            variance.select("feature", F.lit("numeric").alias("kind"), F.coalesce("score", F.lit(0.0)).alias("score"))
            .withColumn("place", F.element_at(places, F.col("feature")))
        )
    if others:
        counted = value_counts(t.df, others).groupBy("feature").agg(F.count(F.lit(1)).cast("double").alias("score"))
        names = t.spark.createDataFrame([(f.name,) for f in others], "feature string")
        parts.append(
            names.join(counted, "feature", "left")
            .select("feature", F.lit("other").alias("kind"), F.coalesce("score", F.lit(0.0)).alias("score"))
            .withColumn("place", F.element_at(places, F.col("feature")))
        )
    total = len(t.features)
    numeric_quota = min(len(t.numeric), int(budget * (len(t.numeric) / total))) if total else 0
    other_quota = min(len(others), budget - numeric_quota)
    quota = F.when(F.col("kind") == "numeric", numeric_quota).otherwise(other_quota)
    # One row per column of the table, so the window is bounded by the schema.
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "place"))
    return (
        union_all(parts)
        .withColumn("position", rank)
        .select("feature", "kind", "score", "position", (rank <= quota).alias("kept"))
    )


def sample_columns(t: LabelledTable, budget: int = DEFAULT_COLUMNS) -> DataFrame:
    """The table with the target and at most ``budget`` features."""
    if len(t.features) <= budget:
        return t.df
    kept = score_columns(t, budget).where("kept").orderBy("kind", "position").collect()
    return t.df.select(column(t.target), *[column(r["feature"]) for r in kept])


def _draw(df: DataFrame, t: LabelledTable, quotas: DataFrame, stratum: Column) -> DataFrame:
    return first_by_hash(df, t.row_key, quotas, t.seed, stratum)


def stratified_quotas(t: LabelledTable, size: int) -> DataFrame:
    """``stratum, quota``: class shares of ``size``, largest remainders first."""
    counts = t.df.groupBy(t.label.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy(F.lit(1))
    # Classes only (a table of at most 50 rows where the sampler applies).
    share = F.col("n") * F.lit(float(size)) / F.sum("n").over(every)
    whole = F.floor("share")
    order = F.row_number().over(every.orderBy(F.desc(F.col("share") - whole), F.asc_nulls_first("stratum")))
    spare = F.lit(size) - F.sum(whole).over(every)
    return (
        counts.withColumn("share", share)
        .withColumn("order", order)
        .withColumn("spare", spare)
        .select(
            "stratum",
            F.least(F.col("n"), whole + (F.col("order") <= F.col("spare")).cast("int")).cast("bigint").alias("quota"),
        )
    )


def stratified_sample(t: LabelledTable, size: int = DEFAULT_ROWS) -> DataFrame:
    return _draw(t.df, t, stratified_quotas(t, size), t.label)


def _in_order(counts: DataFrame, wanted: Column, size: int) -> DataFrame:
    """Quotas granted in stratum order until ``size`` rows are given out."""
    quotas = counts.withColumn("quota", F.least(F.col("n"), wanted.cast("bigint")))
    before = F.sum("quota").over(
        W.partitionBy(F.lit(1)).orderBy("stratum").rowsBetween(W.unboundedPreceding, 0)
    ) - F.col("quota")
    return (
        quotas.withColumn("before", before)
        .select(
            "stratum",
            F.greatest(F.lit(0), F.least(F.col("quota"), F.lit(size) - F.col("before"))).cast("bigint").alias("quota"),
        )
        .where("quota > 0")
    )


def _numeric_fields(t: LabelledTable, with_target: bool) -> list[T.StructField]:
    kinds = T.NumericType
    return [
        f
        for f in t.df.schema
        if isinstance(f.dataType, kinds) and (with_target or f.name != t.target)
    ]


def quantile_code(t: LabelledTable, size: int = DEFAULT_ROWS, with_target: bool = True) -> Column:
    """The sum of a row's quantile-bin numbers."""
    bins = min(10, max(5, size // 1000))
    fields = _numeric_fields(t, with_target)
    cells = {f.name: as_number(f) for f in fields}
    facts = measure_cells(t.df, cells, lambda value: {"filled": F.count(value)}, "filled bigint").collect()
    sizes = {r["feature"]: r["filled"] for r in facts}
    edges = quantile_values(t.df, cells, sizes, [i / bins for i in range(bins + 1)])
    code = F.lit(0)
    for name, found in edges.items():
        inner = sorted(set(found))[1:]
        code = code + F.coalesce(bin_number(cells[name], inner), F.lit(0))
    return code


def quantile_sample(t: LabelledTable, size: int = DEFAULT_ROWS, with_target: bool = True) -> DataFrame:
    """An equal number of rows from every quantile code, tails included."""
    code = quantile_code(t, size, with_target)
    counts = t.df.groupBy(code.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))
    codes = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    wanted = F.greatest(F.lit(1), F.floor(F.lit(size) / codes))
    return _draw(t.df, t, _in_order(counts.withColumn("wanted", wanted), F.col("wanted"), size), code)


def cluster_sample(
    t: LabelledTable, size: int = DEFAULT_ROWS, with_target: bool = True, vector: str | None = None
) -> DataFrame:
    """Rows drawn from k-means clusters in proportion to cluster size."""
    k = min(20, max(5, size // 500))
    row, key = F.struct("*").alias("row"), t.row_key.alias("key")
    if vector is not None:
        from pyspark.ml.functions import array_to_vector

        features = array_to_vector(column(vector).cast("array<double>")).alias("features")
        ready = t.df.select(row, key, features)
    else:
        fields = _numeric_fields(t, with_target)
        means = t.df.agg(*[F.avg(as_number(f)).alias(f"m{i}") for i, f in enumerate(fields)]).first()
        cells = [
            F.coalesce(as_number(f), F.lit(means[i] if means[i] is not None else 0.0)).alias(f"x{i}")
            for i, f in enumerate(fields)
        ]
        names = [f"x{i}" for i in range(len(fields))]
        ready = VectorAssembler(inputCols=names, outputCol="features").transform(t.df.select(row, key, *cells))
    model = KMeans(k=k, seed=t.seed, featuresCol="features", predictionCol="stratum").fit(ready)
    clustered = model.transform(ready).select("row", "key", "stratum")
    counts = clustered.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    wanted = F.greatest(F.lit(1), F.floor(F.col("n") / total * size))
    quotas = _in_order(counts.withColumn("wanted", wanted), F.col("wanted"), size)
    return first_by_hash(clustered, F.col("key"), quotas, t.seed, F.col("stratum")).select("row.*")


def random_sample(t: LabelledTable, size: int = DEFAULT_ROWS) -> DataFrame:
    quotas = t.spark.createDataFrame([(0, size)], "stratum int, quota bigint")
    return _draw(t.df, t, quotas, F.lit(0))


def adaptive_method(t: LabelledTable, with_target: bool = True) -> str:
    """The first sampler that fits the table, from its class counts and types."""
    summary = t.class_summary
    lows = [n for n in (summary["low"], summary["unlabelled"] or None) if n is not None]
    if 0 < summary["classes"] <= 50 and min(lows) >= 2:
        return "stratified"
    numeric = _numeric_fields(t, with_target)
    if len(numeric) >= 3:
        return "quantile"
    return "cluster" if numeric else "random"


def adaptive_sample(t: LabelledTable, size: int = DEFAULT_ROWS, with_target: bool = True) -> DataFrame:
    """At most ``size`` rows by the first sampler that fits; a small table whole."""
    if t.rows <= size:
        return t.df
    method = adaptive_method(t, with_target)
    if method == "quantile":
        # Every row in one code leaves nothing to preserve.
        code = quantile_code(t, size, with_target)
        low, high = t.df.agg(F.min(code), F.max(code)).first()
        method = "quantile" if low != high else "cluster"
    if method == "stratified":
        return stratified_sample(t, size)
    if method == "quantile":
        return quantile_sample(t, size, with_target)
    if method == "cluster":
        return cluster_sample(t, size, with_target)
    return random_sample(t, size)
