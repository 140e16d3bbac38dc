"""Class balance, distribution shift, missingness by class, skew, sample size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.frequency import rank_sums
from tabscout.functions.quantiles import quantiles
from tabscout.functions.stats import chi2_sf, unbiased_skewness, yates_gap
from tabscout.schema import (
    FINDINGS,
    Rule,
    as_number,
    blocks,
    emit,
    empty,
    finding,
    measure_cells,
    missing,
    union_all,
)
from tabscout.table import LabelledTable

TOOL = "bias_detector"

# A class map is written into evidence only up to this many classes; the whole
# distribution stays available from ``measure_classes``.
EVIDENCE_CLASSES = 1000


def measure_classes(t: LabelledTable) -> DataFrame:
    """``class, n, percentage``: one row per class, share of all rows."""
    counts = t.df.groupBy(t.label.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("rows")).scalar()
    return (
        counts.withColumn("percentage", F.col("n") * 100.0 / total)
        .where("class IS NOT NULL")
    )


def measure_balance(t: LabelledTable) -> DataFrame:
    """One row: ``rows, classes, majority_n, minority_n, ratio, majority, minority``."""
    return (
        t.df.groupBy(t.label.alias("class"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.count("class").alias("classes"),
            F.max(F.when(F.col("class").isNotNull(), F.col("n"))).alias("majority_n"),
            F.min(F.when(F.col("class").isNotNull(), F.col("n"))).alias("minority_n"),
            # Ties go to the smallest label.
            F.min_by("class", F.when(F.col("class").isNotNull(), F.struct(-F.col("n"), F.col("class")))).alias("majority"),
            F.min_by("class", F.when(F.col("class").isNotNull(), F.struct(F.col("n"), F.col("class")))).alias("minority"),
        )
        .withColumn("ratio", F.try_divide(F.col("majority_n").cast("double"), F.col("minority_n")))
    )


def _class_map(t: LabelledTable, value: str) -> Column:
    """Class map for evidence as a scalar subquery, NULL above the size bound."""
    entry = F.struct(F.col("class"), F.col(value))
    return (
        measure_classes(t)
        .orderBy("class")
        .limit(EVIDENCE_CLASSES + 1)
        .agg(F.sort_array(F.collect_list(entry)).alias("m"))
        .select(F.when(F.size("m") <= EVIDENCE_CLASSES, F.map_from_entries("m")).alias("m"))
        .scalar()
    )


def balance_rules(
    t: LabelledTable, severe: float = 100, moderate: float = 10, mild: float = 3
) -> list[Rule]:
    ratio, classes = F.col("ratio"), F.col("classes")
    grade = F.when(ratio > severe, "severe").when(ratio > moderate, "moderate").otherwise("mild")
    single = finding(
        TOOL,
        "single_class",
        "critical",
        F.lit("Target variable has only one class - cannot train classifier"),
        classes,
        F.struct(
            classes.alias("class_count"), F.array_compact(F.array("majority")).alias("unique_values")
        ),
        dataset=t.name,
    )
    uneven = finding(
        TOOL,
        F.concat(grade, F.lit("_imbalance")),
        F.when(ratio > severe, "critical").when(ratio > moderate, "warning").otherwise("info"),
        F.format_string("%s class imbalance detected (ratio %.1f:1)", F.initcap(grade), ratio),
        ratio,
        F.struct(
            ratio.alias("imbalance_ratio"),
            _class_map(t, "percentage").alias("class_distribution"),
            F.when(ratio > severe, F.col("majority")).alias("majority_class"),
            F.when(ratio > severe, F.col("minority")).alias("minority_class"),
        ),
        dataset=t.name,
    )
    return [(classes < 2, single), ((classes >= 2) & (ratio > mild), uneven)]


def sample_size_rules(
    t: LabelledTable, min_rows: int = 100, min_class: int = 30, critical_class: int = 10
) -> list[Rule]:
    rows, smallest = F.col("rows"), F.col("minority_n")
    small = finding(
        TOOL,
        "small_dataset",
        "warning",
        F.format_string("Dataset has only %d samples - may be insufficient for robust training", rows),
        rows,
        F.struct(rows.alias("total_samples")),
        dataset=t.name,
    )
    thin = finding(
        TOOL,
        "small_class_size",
        F.when(smallest < critical_class, "critical").otherwise("warning"),
        F.format_string("Smallest class has only %d samples", smallest),
        smallest,
        F.struct(smallest.alias("min_class_size"), _class_map(t, "n").alias("class_distribution")),
        dataset=t.name,
    )
    return [(rows < min_rows, small), (smallest < min_class, thin)]


def flag_classes(t: LabelledTable) -> DataFrame:
    """Imbalance and sample-size findings.

    Two counts decide whether any rule holds; the class map of the evidence is
    only queried when one does.
    """
    summary = t.class_summary
    rules = []
    if summary["classes"] < 2 or summary["high"] > 3 * summary["low"]:
        rules += balance_rules(t)
    if summary["rows"] < 100 or (summary["low"] or 0) < 30:
        rules += sample_size_rules(t)
    return emit(measure_balance(t), *rules) if rules else empty(t.spark, FINDINGS)


def measure_kruskal(t: LabelledTable) -> DataFrame:
    """Kruskal-Wallis test of every numeric feature across classes.

    ``feature, n, groups, statistic, p_value, effect_size`` with tie correction
    and eta squared as effect size.
    """
    if not t.numeric:
        return empty(
            t.spark,
            "feature string, n bigint, groups bigint, statistic double, p_value double, effect_size double",
        )
    sums = rank_sums(t.df, t.numeric, t.label)
    per_feature = sums.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("spread"),
        F.sum("tie_sum").alias("ties"),
    )
    n, k = F.col("n").cast("double"), F.col("groups")
    raw = 12.0 / (n * (n + 1)) * F.col("spread") - 3 * (n + 1)
    corrected = F.try_divide(raw, 1 - F.try_divide(F.col("ties"), n * n * n - n))
    h = F.col("statistic")
    return (
        per_feature.where("groups >= 2")
        .select("feature", "n", "groups", corrected.alias("statistic"))
        .withColumn("p_value", chi2_sf(h, k - 1))
        .withColumn("effect_size", F.when(n > k, (h - k + 1) / (n - k)).otherwise(0.0))
    )


def kruskal_rule(max_p: float = 0.001, min_effect: float = 0.14, dataset: str = "table") -> Rule:
    fires = (F.col("p_value") < max_p) & (F.col("effect_size") > min_effect)
    return fires, finding(
        TOOL,
        "feature_distribution_bias",
        "warning",
        F.format_string('Feature "%s" has significantly different distributions across classes', "feature"),
        F.col("effect_size"),
        F.struct("p_value", "effect_size", F.lit("kruskal_wallis").alias("test")),
        F.col("feature"),
        dataset=dataset,
    )


def flag_kruskal(measure: DataFrame, **limits) -> DataFrame:
    return emit(measure, kruskal_rule(**limits))


def missing_by_class(t: LabelledTable) -> DataFrame:
    """``feature, class, n, missing``; the NULL class keeps unlabelled rows.

    One aggregate per block of columns, one row per class and task in the
    exchange.
    """
    parts = []
    for block in blocks(t.features, 60):
        counted = t.df.groupBy(t.label.alias("class")).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(missing(f)).alias(f"m{i}") for i, f in enumerate(block)],
        )
        cells = [
            F.struct(F.lit(f.name).alias("feature"), F.col(f"m{i}").alias("missing"))
            for i, f in enumerate(block)
        ]
        parts.append(counted.select("class", "n", F.inline(F.array(*cells))))
    return union_all(parts).select("feature", "class", "n", "missing")


def measure_missingness(t: LabelledTable, with_rates: bool | None = None) -> DataFrame:
    """Missingness of every feature against the class.

    ``feature, rows, missing, missing_rate, classes, max_rate, min_rate,
    difference, dof, chi2, p_value, rates``: rates and difference in percent;
    chi-squared over the 2 x K table, Yates-corrected when it is 2 x 2. The map
    ``rates`` is filled only up to ``EVIDENCE_CLASSES`` classes.
    """
    if with_rates is None:
        with_rates = t.class_summary["classes"] <= EVIDENCE_CLASSES
    known = F.col("class").isNotNull()
    n = F.when(known, F.col("n")).cast("double")
    gone = F.when(known, F.col("missing")).cast("double")
    rate = F.col("missing") * 100.0 / F.col("n")
    entry = F.when(known, F.struct(F.col("class"), rate.alias("rate")))
    rates = F.map_from_entries(F.sort_array(F.collect_list(entry)))
    totals = missing_by_class(t).groupBy("feature").agg(
        F.sum("n").alias("rows"),
        F.sum("missing").alias("missing"),
        F.count("class").alias("classes"),
        (F.count("class") + F.max((~known).cast("int"))).alias("labels"),
        F.sum(n).alias("cn"),
        F.sum(gone).alias("cm"),
        F.sum(gone * gone / n).alias("squares"),
        F.sum(1.0 / n).alias("inverse"),
        F.max(F.when(known, rate)).alias("max_rate"),
        F.min(F.when(known, rate)).alias("min_rate"),
        (rates if with_rates else F.lit(None).cast("map<string,double>")).alias("rates"),
    )
    # Chi-squared of a 2 x K table from sums: sum(m^2 / n) - M^2 / N over p (1 - p).
    both_kinds = (F.col("cm") > 0) & (F.col("cm") < F.col("cn"))
    p = F.col("cm") / F.col("cn")
    plain = (F.col("squares") - F.col("cm") * p) / (p * (1 - p))
    # All four gaps of a 2 x 2 table are equal, which gives the corrected value.
    gap = F.sqrt(F.greatest(plain, F.lit(0.0)) * p * (1 - p) / F.col("inverse"))
    corrected = yates_gap(gap) * yates_gap(gap) * F.col("inverse") / (p * (1 - p))
    chi2 = F.when(F.col("classes") == 2, corrected).otherwise(F.greatest(plain, F.lit(0.0)))
    return (
        totals.withColumn("dof", F.when(both_kinds, F.col("classes") - 1).otherwise(0))
        .withColumn("chi2", F.when(both_kinds, chi2).otherwise(0.0))
        .withColumn("p_value", F.when(F.col("dof") > 0, chi2_sf(F.col("chi2"), F.col("dof"))).otherwise(1.0))
        .withColumn("missing_rate", F.try_divide(F.col("missing") * 100.0, F.col("rows")))
        .withColumn("difference", F.col("max_rate") - F.col("min_rate"))
        .drop("cn", "cm", "squares", "inverse")
    )


def missingness_rules(
    min_difference: float = 20,
    max_p: float = 0.01,
    max_classes: int = 20,
    low: float = 1,
    high: float = 99,
    dataset: str = "table",
) -> list[Rule]:
    """Missing rates that differ between classes, and a significant pattern.

    Columns with hardly any or hardly no missing cells are not informative.
    """
    informative = (
        F.col("missing_rate").between(low, high)
        & (F.col("missing") > 0)
        & (F.col("missing") < F.col("rows"))
        & (F.col("classes") >= 2)
    )
    uneven = finding(
        TOOL,
        "missing_value_bias",
        "warning",
        F.format_string('Missing values in "%s" are unevenly distributed across classes', "feature"),
        F.col("difference"),
        F.struct(
            F.col("rates").alias("missing_by_class"),
            F.col("difference").alias("max_difference"),
            F.col("missing_rate").alias("overall_missing_rate"),
        ),
        F.col("feature"),
        dataset=dataset,
    )
    pattern = finding(
        TOOL,
        "missing_pattern_correlation",
        "warning",
        F.format_string('Missing pattern in "%s" significantly correlates with target', "feature"),
        F.col("chi2"),
        F.struct("chi2", "p_value", F.col("rates").alias("missing_by_class")),
        F.col("feature"),
        dataset=dataset,
    )
    significant = (F.col("p_value") < max_p) & (F.col("labels") <= max_classes)
    return [
        (informative & (F.col("difference") > min_difference), uneven),
        (informative & significant, pattern),
    ]


def _shape(t: LabelledTable, fields: Sequence[T.StructField]) -> DataFrame:
    return measure_cells(
        t.df,
        {f.name: as_number(f) for f in fields},
        lambda value: {"n": F.count(value), "g1": F.skewness(value), "mean": F.avg(value)},
        "n bigint, g1 double, mean double",
    )


def measure_skewness(t: LabelledTable, features: Sequence[str] | None = None) -> DataFrame:
    """``feature, n, skewness, mean, median``: bias-corrected skew, exact median."""
    fields = [f for f in t.numeric if features is None or f.name in features]
    shape = _shape(t, fields)
    cells = {f.name: as_number(f) for f in fields}
    sizes = {f.name: t.numeric_facts[f.name].filled for f in fields}
    medians = quantiles(t.df, cells, sizes, [0.5], ends=t.ends).select("feature", F.col("value").alias("median"))
    return shape.join(medians, "feature", "left").select(
        "feature", "n", unbiased_skewness(F.col("g1"), F.col("n")).alias("skewness"), "mean", "median"
    )


def skewness_rule(threshold: float = 5, dataset: str = "table") -> Rule:
    return F.abs("skewness") > threshold, finding(
        TOOL,
        "extreme_skewness",
        "warning",
        F.format_string('Feature "%s" has extreme skewness (%.2f)', "feature", "skewness"),
        F.col("skewness"),
        F.struct("skewness", "mean", "median"),
        F.col("feature"),
        dataset=dataset,
    )


def flag_skewness(measure: DataFrame, **limits) -> DataFrame:
    return emit(measure, skewness_rule(**limits))


def _skewed_names(t: LabelledTable, threshold: float = 5) -> list[str]:
    """Names of skewed features, so that medians are computed for those only."""
    shape = _shape(t, t.numeric)
    skewed = shape.where(F.abs(unbiased_skewness(F.col("g1"), F.col("n"))) > threshold)
    return [r["feature"] for r in skewed.select("feature").collect()]


def check_bias(t: LabelledTable, whole: LabelledTable | None = None, max_labels: int = 50) -> DataFrame:
    """All bias findings of one table.

    Where ``t`` is a sample, ``whole`` is the table it was drawn from: class
    balance and sample sizes are counted there. Distribution shift is tested up
    to ``max_labels`` labels, a missing label counting as one.
    """
    parts = [flag_classes(whole or t)]
    summary = t.class_summary
    labels = summary["classes"] + (1 if summary["unlabelled"] else 0)
    if 2 <= labels <= max_labels and t.numeric:
        parts.append(flag_kruskal(measure_kruskal(t), dataset=t.name))
    if t.features:
        parts.append(emit(measure_missingness(t), *missingness_rules(dataset=t.name)))
    skewed = _skewed_names(t) if t.numeric else []
    if skewed:
        parts.append(flag_skewness(measure_skewness(t, skewed), dataset=t.name))
    return union_all(parts) if parts else empty(t.spark, FINDINGS)
