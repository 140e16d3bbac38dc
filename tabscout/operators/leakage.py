"""Target leakage: association with, copies of, and encodings of the target."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.functions.frequency import value_counts
from tabscout.functions.lineage import stored
from tabscout.functions.rolling import contained_pieces
from tabscout.functions.stats import entropy_from_sum, guarded_corr, xlogx
from tabscout.schema import (
    FINDINGS,
    Rule,
    as_number,
    column,
    emit,
    empty,
    finding,
    measure_cells,
    union_all,
)
from tabscout.table import LabelledTable

TOOL = "leakage_detector"

# Name fragments that suggest leakage; the first match is reported.
SUSPICIOUS_NAMES = (
    "target", "label", "outcome", "result", "actual",
    "ground_truth", "gt", "prediction", "pred", "forecast",
    "future", "after", "post", "final", "end",
)


def measure_target_fit(t: LabelledTable) -> DataFrame:
    """Least-squares fit of the target on every numeric feature.

    ``feature, n, correlation, r2, coefficient, intercept`` over complete rows;
    empty for a text target. One pass, no shuffle of rows.
    """
    schema = "n bigint, cov double, vx double, vy double, mx double, my double"
    cells = {f.name: as_number(f) for f in t.numeric_or_bool} if t.target_is_numeric else {}
    y = F.col("y")

    def sums(x: Column) -> dict[str, Column]:
        xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        return {
            "n": F.count(xs),
            "cov": F.covar_pop(x, y),
            "vx": F.var_pop(xs),
            "vy": F.var_pop(ys),
            "mx": F.avg(xs),
            "my": F.avg(ys),
        }

    raw = measure_cells(t.df, cells, sums, schema, {"y": t.target_number} if cells else None)
    slope = F.try_divide(F.col("cov"), F.col("vx"))
    r = guarded_corr(F.col("cov"), F.sqrt("vx"), F.sqrt("vy"))
    return raw.where("n >= 2").select(
        "feature",
        "n",
        r.alias("correlation"),
        (r * r).alias("r2"),
        slope.alias("coefficient"),
        (F.col("my") - slope * F.col("mx")).alias("intercept"),
    )


def correlation_rule(critical: float = 0.99, warning: float = 0.95, dataset: str = "table") -> Rule:
    strong = F.abs("correlation") > critical
    adjective = F.when(strong, "near-perfect correlation").otherwise("suspiciously high correlation")
    return F.abs("correlation") > warning, finding(
        TOOL,
        F.when(strong, "perfect_correlation").otherwise("high_correlation"),
        F.when(strong, "critical").otherwise("warning"),
        F.format_string('Feature "%s" has %s (%.4f) with target', "feature", adjective, "correlation"),
        F.col("correlation"),
        F.struct("correlation"),
        F.col("feature"),
        dataset=dataset,
    )


def flag_correlation(fit: DataFrame, **limits) -> DataFrame:
    return emit(fit, correlation_rule(**limits))


def linear_copy_rule(threshold: float = 0.999, dataset: str = "table") -> Rule:
    return F.col("r2") > threshold, finding(
        TOOL,
        "linear_transformation",
        "critical",
        F.format_string('Feature "%s" appears to be a linear transformation of target (R²=%.6f)', "feature", "r2"),
        F.col("r2"),
        F.struct("r2", "coefficient", "intercept"),
        F.col("feature"),
        dataset=dataset,
    )


def flag_linear_copy(fit: DataFrame, **limits) -> DataFrame:
    return emit(fit, linear_copy_rule(**limits))


def measure_text_association(t: LabelledTable) -> DataFrame:
    """Mutual information and purity of every text feature against the target.

    ``feature, n, distinct_values, max_classes_per_value, mutual_information,
    target_entropy`` in nats. Entropies come from ``sum(n ln n)`` over the joint
    and marginal counts, so no window ever spans a feature or a class.
    """
    joint = value_counts(t.df, t.text, t.label) if t.text else empty(
        t.spark, "feature string, value string, class string, n bigint"
    )
    per_value = joint.groupBy("feature", "value").agg(
        F.sum("n").alias("nx"),
        F.count(F.lit(1)).alias("classes"),
        F.sum(xlogx(F.col("n"))).alias("sxy"),
    )
    values = per_value.groupBy("feature").agg(
        F.sum("nx").alias("n"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.max("classes").alias("max_classes_per_value"),
        F.sum("sxy").alias("sxy"),
        F.sum(xlogx(F.col("nx"))).alias("sx"),
    )
    labels = (
        joint.groupBy("feature", "class")
        .agg(F.sum("n").alias("ny"))
        .groupBy("feature")
        .agg(F.sum(xlogx(F.col("ny"))).alias("sy"))
    )
    n = F.col("n")
    h_y = entropy_from_sum(n, F.col("sy"))
    mi = entropy_from_sum(n, F.col("sx")) + h_y - entropy_from_sum(n, F.col("sxy"))
    return values.join(labels, "feature").select(
        "feature",
        "n",
        "distinct_values",
        "max_classes_per_value",
        F.greatest(mi, F.lit(0.0)).alias("mutual_information"),
        h_y.alias("target_entropy"),
    )


def normalized_mi(units: str = "consistent") -> Column:
    """Mutual information over target entropy, in [0, 1].

    ``units="mixed"`` divides nats by bits, which caps the ratio at ln 2 so
    that neither threshold can be passed; it exists for comparison only.
    """
    if units not in ("consistent", "mixed"):
        raise ValueError("units must be 'consistent' or 'mixed'")
    ratio = F.when(
        F.col("target_entropy") > 1e-12, F.col("mutual_information") / F.col("target_entropy")
    )
    return ratio if units == "consistent" else ratio * math.log(2)


def mutual_information_rule(
    critical: float = 0.95,
    warning: float = 0.85,
    units: str = "consistent",
    dataset: str = "table",
) -> Rule:
    share = normalized_mi(units)
    strong = share > critical
    adjective = F.when(strong, "near-perfect").otherwise("suspiciously high")
    return (F.col("n") >= 2) & (share > warning), finding(
        TOOL,
        F.when(strong, "perfect_mutual_information").otherwise("high_mutual_information"),
        F.when(strong, "critical").otherwise("warning"),
        F.format_string(
            'Feature "%s" has %s mutual information (%.4f) with target', F.col("feature"), adjective, share
        ),
        share,
        F.struct(share.alias("normalized_mi")),
        F.col("feature"),
        dataset=dataset,
    )


def flag_mutual_information(association: DataFrame, **limits) -> DataFrame:
    return emit(association, mutual_information_rule(**limits))


def perfect_predictor_rule(min_rows: int = 10, dataset: str = "table") -> Rule:
    pure = (
        (F.col("n") >= min_rows)
        & (F.col("distinct_values") > 2)
        & (F.col("max_classes_per_value") == 1)
    )
    return pure, finding(
        TOOL,
        "perfect_predictor",
        "critical",
        F.format_string('Feature "%s" perfectly predicts target (1-to-1 mapping)', "feature"),
        F.col("distinct_values"),
        F.struct(F.col("distinct_values").alias("unique_values")),
        F.col("feature"),
        dataset=dataset,
    )


def flag_perfect_predictor(association: DataFrame, **limits) -> DataFrame:
    return emit(association, perfect_predictor_rule(**limits))


def measure_names(t: LabelledTable) -> DataFrame:
    """``feature, keyword, filled``: first suspicious fragment of each name."""
    words = F.array(*[F.lit(w) for w in SUSPICIOUS_NAMES])
    counts = measure_cells(
        t.df,
        {f.name: column(f.name).isNotNull() for f in t.features},
        lambda value: {"filled": F.count_if(value)},
        "filled bigint",
    )
    hit = F.filter(words, lambda w: F.contains(F.lower("feature"), w))
    return counts.select("feature", F.try_element_at(hit, F.lit(1)).alias("keyword"), "filled")


def flag_names(t: LabelledTable) -> DataFrame:
    """Name findings need the schema only, so no data is read."""
    rows = []
    for f in t.features:
        hits = [w for w in SUSPICIOUS_NAMES if w in f.name.lower()]
        if hits:
            rows.append((f.name, hits[0]))
    named = t.spark.createDataFrame(rows, "feature string, keyword string")
    return named.select(
        *finding(
            TOOL,
            "suspicious_name",
            "warning",
            F.format_string('Feature "%s" has suspicious name containing "%s"', "feature", "keyword"),
            F.lit(None),
            F.struct("keyword"),
            F.col("feature"),
            dataset=t.name,
        )
    )


def measure_identical(t: LabelledTable) -> DataFrame:
    """``feature, identical``: same type as the target and equal in every row."""
    same_type = [f for f in t.features if f.dataType == t.target_field.dataType]
    return measure_cells(
        t.df,
        {f.name: column(f.name).eqNullSafe(column(t.target)) for f in same_type},
        lambda value: {"identical": F.bool_and(value)},
        "identical boolean",
    )


def flag_identical(identical: DataFrame, dataset: str = "table") -> DataFrame:
    return identical.where("identical").select(
        *finding(
            TOOL,
            "identical_to_target",
            "critical",
            F.format_string('Feature "%s" is identical to target column', "feature"),
            F.lit(None),
            F.struct(),
            F.col("feature"),
            dataset=dataset,
        )
    )


def measure_encoded_target(t: LabelledTable) -> DataFrame:
    """``feature, distinct_values, matched_targets``: target values inside text.

    Texts are searched by rolling hashes, see ``contained_pieces``; nothing
    compares every value with every target.
    """
    if not t.text:
        return empty(t.spark, "feature string, distinct_values bigint, matched_targets bigint")
    values = stored(value_counts(t.df, t.text).select("feature", "value"))
    found = contained_pieces(values, t.classes.select(F.col("class").alias("piece"))).groupBy("feature").agg(
        F.count(F.lit(1)).alias("matched_targets")
    )
    sizes = values.groupBy("feature").agg(F.count(F.lit(1)).alias("distinct_values"))
    return sizes.join(found, "feature", "left").select(
        "feature", "distinct_values", F.coalesce("matched_targets", F.lit(0)).alias("matched_targets")
    )


def flag_encoded_target(t: LabelledTable) -> DataFrame:
    matched = measure_encoded_target(t).where("matched_targets > 0")
    if not t.text:
        return empty(t.spark, FINDINGS)
    first = F.row_number().over(W.partitionBy("feature").orderBy("value"))
    samples = (
        value_counts(t.df, t.text)
        .withColumn("rank", first)
        .where("rank <= 5")
        .groupBy("feature")
        .agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    )
    return matched.join(samples, "feature").select(
        *finding(
            TOOL,
            "encoded_target_leakage",
            "warning",
            F.format_string('Feature "%s" values may encode target information', "feature"),
            F.col("matched_targets"),
            F.struct("sample_values"),
            F.col("feature"),
            dataset=t.name,
        )
    )


def check_leakage(t: LabelledTable, mi_units: str = "consistent") -> DataFrame:
    """All leakage findings of one table."""
    return union_all(
        [
            emit(
                measure_target_fit(t),
                correlation_rule(dataset=t.name),
                linear_copy_rule(dataset=t.name),
            ),
            emit(
                measure_text_association(t),
                mutual_information_rule(units=mi_units, dataset=t.name),
                perfect_predictor_rule(dataset=t.name),
            ),
            flag_identical(measure_identical(t), dataset=t.name),
            flag_names(t),
        ]
    )
