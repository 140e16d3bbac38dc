"""Features that carry little: constant, flat, redundant, uninformative, sparse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.frequency import value_counts
from tabscout.functions.gram import strong_pairs
from tabscout.functions.quantiles import order_statistics
from tabscout.functions.stats import entropy_from_sum, xlogx
from tabscout.operators.binning import bin_counts
from tabscout.schema import (
    FINDINGS,
    Rule,
    as_number,
    as_text,
    blocks,
    emit,
    empty,
    finding,
    measure_cells,
    missing,
    union_all,
)
from tabscout.table import LabelledTable

TOOL = "feature_utility"
#: Two features that correlate more strongly than this are redundant.
REDUNDANT = 0.95


def measure_values(t: LabelledTable, features: Sequence[str] | None = None) -> DataFrame:
    """``feature, rows, distinct_values, top_count, top_value``, missing excluded.

    Ties for the most frequent value go to the smallest text.
    """
    fields = [f for f in t.features if features is None or f.name in features]
    if not fields:
        return empty(
            t.spark,
            "feature string, rows bigint, distinct_values bigint, top_count bigint, top_value string",
        )
    return (
        value_counts(t.df, fields)
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("distinct_values"),
            F.max("n").alias("top_count"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top_value"),
        )
        .select("feature", F.lit(t.rows).cast("bigint").alias("rows"), "distinct_values", "top_count", "top_value")
    )


def concentrated_features(t: LabelledTable, share: float = 0.95) -> list[str]:
    """Names of features where one value may hold more than ``share`` of all rows.

    A value held by most rows is the median under any order, so the median is
    the only candidate. A few narrow passes replace a shuffle of every
    distinct value; survivors are then counted exactly.
    """
    if share < 0.6:
        return [f.name for f in t.features]
    # Numbers are ordered by value, everything else by the hash of its text.
    order = {
        f.name: as_number(f)
        if isinstance(f.dataType, T.NumericType)
        else F.when(as_text(f).isNotNull(), F.hash(as_text(f)).cast("double"))
        for f in t.features
    }
    sizes = {n: facts.filled for n, facts in t.numeric_facts.items()}
    others = {n: c for n, c in order.items() if n not in sizes}
    counts = measure_cells(t.df, others, lambda value: {"filled": F.count(value)}, "filled bigint").collect()
    sizes |= {r["feature"]: r["filled"] for r in counts}
    middles = {n: [size // 2] for n, size in sizes.items() if size}
    found = {n: m for (n, _), m in order_statistics(t.df, order, middles, sizes, ends=t.ends).items()}
    # NULL where the cell is missing, else whether it holds the candidate.
    held = {n: order[n] == F.lit(m) for n, m in found.items()}
    counted = measure_cells(
        t.df,
        held,
        lambda value: {"top": F.count_if(value), "filled": F.count(value), "rows": F.count(F.lit(1))},
        "top bigint, filled bigint, rows bigint",
    ).where((F.col("top") > share * F.col("rows")) | (F.col("top") == F.col("filled")))
    return [r["feature"] for r in counted.select("feature").collect()]


def constant_rules(share: float = 0.95, dataset: str = "table") -> list[Rule]:
    top_share = F.try_divide(F.col("top_count").cast("double"), F.col("rows"))
    constant = finding(
        TOOL,
        "constant_feature",
        "critical",
        F.format_string('Feature "%s" has only one unique value - provides no information', "feature"),
        F.col("distinct_values"),
        F.struct(
            F.col("distinct_values").alias("unique_values"), F.col("top_value").alias("constant_value")
        ),
        F.col("feature"),
        dataset=dataset,
    )
    near = finding(
        TOOL,
        "near_constant_feature",
        "warning",
        F.format_string(
            'Feature "%s" has %.1f%% same value - very low variance', F.col("feature"), top_share * 100
        ),
        top_share,
        F.struct(
            F.col("distinct_values").alias("unique_values"),
            top_share.alias("most_common_frequency"),
            F.col("top_value").alias("most_common_value"),
        ),
        F.col("feature"),
        dataset=dataset,
    )
    distinct = F.col("distinct_values")
    return [(distinct == 1, constant), ((distinct > 1) & (top_share > share), near)]


def flag_constants(measure: DataFrame, **limits) -> DataFrame:
    return emit(measure, *constant_rules(**limits))


def cardinality_rules(
    t: LabelledTable, high: float = 0.5, min_distinct: int = 20, identifier: float = 0.95
) -> list[Rule]:
    """Text features only; the two findings are independent of each other."""
    ratio = F.try_divide(F.col("distinct_values").cast("double"), F.col("rows"))
    text = F.col("feature").isin([f.name for f in t.text])
    many = finding(
        TOOL,
        "high_cardinality",
        "warning",
        F.format_string(
            'Feature "%s" has %d unique values (%.1f%% of dataset) - may need encoding',
            F.col("feature"),
            F.col("distinct_values"),
            ratio * 100,
        ),
        ratio,
        F.struct(
            F.col("distinct_values").alias("unique_count"),
            F.col("rows").alias("total_count"),
            ratio.alias("cardinality_ratio"),
        ),
        F.col("feature"),
        dataset=t.name,
    )
    unique = finding(
        TOOL,
        "identifier_feature",
        "critical",
        F.format_string(
            'Feature "%s" appears to be an identifier (%.1f%% unique) - should be removed',
            F.col("feature"),
            ratio * 100,
        ),
        ratio,
        F.struct(F.col("distinct_values").alias("unique_count"), ratio.alias("cardinality_ratio")),
        F.col("feature"),
        dataset=t.name,
    )
    return [
        (text & (ratio > high) & (F.col("distinct_values") > min_distinct), many),
        (text & (ratio > identifier), unique),
    ]


def flag_cardinality(t: LabelledTable, measure: DataFrame, **limits) -> DataFrame:
    return emit(measure, *cardinality_rules(t, **limits))


def measure_variation(t: LabelledTable) -> DataFrame:
    """``feature, n, mean, std, coefficient_of_variation`` (absolute)."""
    return measure_cells(
        t.df,
        {f.name: as_number(f) for f in t.numeric},
        lambda value: {"n": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value)},
        "n bigint, mean double, std double",
    ).withColumn(
        "coefficient_of_variation",
        F.when(F.abs("mean") > 1e-10, F.abs(F.try_divide(F.col("std"), F.col("mean")))),
    )


def flag_low_variance(measure: DataFrame, threshold: float = 0.01, dataset: str = "table") -> DataFrame:
    return measure.where(F.col("coefficient_of_variation") < threshold).select(
        *finding(
            TOOL,
            "low_variance_numeric",
            "warning",
            F.format_string(
                'Feature "%s" has very low variance (CV=%.4f)', "feature", "coefficient_of_variation"
            ),
            F.col("coefficient_of_variation"),
            F.struct("coefficient_of_variation", "mean", "std"),
            F.col("feature"),
            dataset=dataset,
        )
    )


def measure_pairs(t: LabelledTable, least: float = 0.0) -> DataFrame:
    """``feature1, feature2, n, correlation`` over pairwise complete rows.

    Columns are centred on their mean first, so plain sums stay accurate. Pairs
    with a correlation below ``least`` in size are left out before they become
    rows; 0 keeps all, undefined ones included. A constant column has no correlation.
    """
    schema = "feature1 string, feature2 string, n bigint, correlation double"
    usable = [f for f in t.numeric if t.numeric_facts[f.name].filled > 1]
    if len(usable) < 2:
        return empty(t.spark, schema)
    centred = [as_number(f) - F.lit(t.numeric_facts[f.name].mean) for f in usable]
    # Rounding must not give a constant column a correlation.
    constant = F.array(*[F.lit(t.numeric_facts[f.name].constant) for f in usable])
    named = F.array(*[F.lit(f.name) for f in usable])
    flat = F.get(constant, F.col("i")) | F.get(constant, F.col("j"))
    pairs = strong_pairs(t.df, centred, least).select(
        F.get(named, F.col("i")).alias("feature1"),
        F.get(named, F.col("j")).alias("feature2"),
        "n",
        F.when(~flat, F.col("correlation")).alias("correlation"),
    )
    return pairs.where("correlation IS NOT NULL") if least > 0 else pairs


def flag_pairs(measure: DataFrame, threshold: float = REDUNDANT, dataset: str = "table") -> DataFrame:
    strength = F.abs("correlation")
    return measure.where(strength > threshold).select(
        *finding(
            TOOL,
            "redundant_features",
            "warning",
            F.format_string(
                'Features "%s" and "%s" are highly correlated (%.3f) - redundant', F.col("feature1"), F.col("feature2"), strength
            ),
            strength,
            F.struct("feature1", "feature2", strength.alias("correlation")),
            F.concat_ws(", ", "feature1", "feature2"),
            F.col("feature2"),
            dataset=dataset,
        )
    )


def information_from_counts(counts: DataFrame) -> DataFrame:
    """``feature, n, mutual_information, normalized_mi`` in nats from bin counts.

    The plug-in estimate is lowered by its expected value for an unrelated
    feature, as otherwise every feature of a small table would look informative.
    """
    joint = counts.groupBy("feature", "bin", "class").agg(F.sum("n").alias("n"))
    cells = joint.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum(xlogx(F.col("n"))).alias("sxy")
    )

    def marginal(side: str, total: str, number: str) -> DataFrame:
        summed = joint.groupBy("feature", side).agg(F.sum("n").alias("m"))
        return summed.groupBy("feature").agg(
            F.sum(xlogx(F.col("m"))).alias(total), F.count(F.lit(1)).alias(number)
        )

    n = F.col("n")
    plug_in = (
        entropy_from_sum(n, F.col("sx")) + entropy_from_sum(n, F.col("sy")) - entropy_from_sum(n, F.col("sxy"))
    )
    surplus = (F.col("bins") - 1) * (F.col("classes") - 1) / (2.0 * n)
    mi = F.greatest(plug_in - surplus, F.lit(0.0))
    scored = (
        cells.join(marginal("bin", "sx", "bins"), "feature")
        .join(marginal("class", "sy", "classes"), "feature")
        .select("feature", "n", mi.alias("mutual_information"))
    )
    # One row per feature, so a window over all of them is bounded by the schema.
    best = F.max("mutual_information").over(W.partitionBy(F.lit(1)))
    return scored.withColumn(
        "normalized_mi",
        F.when(best > 0, F.col("mutual_information") / best).otherwise(F.col("mutual_information")),
    )


def measure_information(t: LabelledTable, bins: int = 10) -> DataFrame:
    """Mutual information of every numeric feature, in ``bins`` quantile bins, with the class."""
    if not t.numeric or not t.target_is_class:
        return empty(
            t.spark, "feature string, n bigint, mutual_information double, normalized_mi double"
        )
    return information_from_counts(bin_counts(t, bins=bins))


def flag_low_information(
    t: LabelledTable,
    measure: DataFrame,
    max_relative: float = 0.05,
    max_absolute: float = 0.01,
    min_rows: int = 10,
) -> DataFrame:
    """Constant features are left to ``flag_constants``."""
    constant = [n for n, facts in t.numeric_facts.items() if facts.constant]
    fires = (
        (F.col("normalized_mi") < max_relative)
        & (F.col("mutual_information") < max_absolute)
        & (F.col("n") >= min_rows)
        & ~F.col("feature").isin(constant)
    )
    return measure.where(fires).select(
        *finding(
            TOOL,
            "low_information_feature",
            "info",
            F.format_string('Feature "%s" has very low mutual information with target', "feature"),
            F.col("mutual_information"),
            F.struct("mutual_information", "normalized_mi"),
            F.col("feature"),
            dataset=t.name,
        )
    )


def measure_missing(t: LabelledTable) -> DataFrame:
    """``feature, missing_count, total_count, missing_rate`` (share of all rows)."""
    return measure_cells(
        t.df,
        {f.name: missing(f) for f in t.features},
        lambda value: {"missing_count": F.count_if(value), "total_count": F.count(F.lit(1))},
        "missing_count bigint, total_count bigint",
    ).withColumn("missing_rate", F.try_divide(F.col("missing_count").cast("double"), F.col("total_count")))


def flag_missing(
    measure: DataFrame, critical: float = 0.7, warning: float = 0.4, dataset: str = "table"
) -> DataFrame:
    grave = F.col("missing_rate") > critical
    advice = F.when(grave, "too sparse to be useful").otherwise("consider imputation or removal")
    return measure.where(F.col("missing_rate") > warning).select(
        *finding(
            TOOL,
            F.when(grave, "excessive_missing").otherwise("high_missing"),
            F.when(grave, "critical").otherwise("warning"),
            F.format_string(
                'Feature "%s" has %.1f%% missing values - %s', F.col("feature"), F.col("missing_rate") * 100, advice
            ),
            F.col("missing_rate"),
            F.struct(
                "missing_count",
                "missing_rate",
                F.when(grave, F.col("total_count")).alias("total_count"),
            ),
            F.col("feature"),
            dataset=dataset,
        )
    )


def check_utility(t: LabelledTable) -> DataFrame:
    """All utility findings of one table.

    Distinct values are counted only where a finding is possible: for text
    features, and for features one value may dominate.
    """
    if not t.features:
        return empty(t.spark, FINDINGS)
    text = {f.name for f in t.text}
    counted = measure_values(t, sorted(text | set(concentrated_features(t))))
    parts = [
        emit(counted, *constant_rules(dataset=t.name), *cardinality_rules(t)),
        flag_missing(measure_missing(t), dataset=t.name),
    ]
    if t.numeric:
        parts.append(flag_low_variance(measure_variation(t), dataset=t.name))
        parts.append(flag_pairs(measure_pairs(t, REDUNDANT), REDUNDANT, dataset=t.name))
        parts.append(flag_low_information(t, measure_information(t)))
    return union_all(parts)


def recommended_removals(findings: DataFrame) -> DataFrame:
    """``dataset, feature``: single features with a critical utility finding."""
    return (
        findings.where(
            (F.col("tool") == TOOL)
            & (F.col("severity") == "critical")
            & F.col("feature").isNotNull()
            & ~F.contains(F.col("feature"), F.lit(","))
        )
        .select("dataset", "feature")
        .distinct()
    )


