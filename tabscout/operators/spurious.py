"""Shortcut features: single features, simple rules and lopsided importances."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tabscout.functions.forests import Plan, binned, cut_points, fold_scores, importances
from tabscout.functions.hashing import hash_fold
from tabscout.operators.binning import QUARTILES, bin_counts, bin_number, feature_quantiles, usable_features
from tabscout.operators.sampling import DEFAULT_ROWS, adaptive_sample
from tabscout.schema import FINDINGS, as_number, empty, finding, measure_cells, union_all
from tabscout.table import LabelledTable

TOOL = "spurious_detector"
MIN_ROWS = 30

SINGLE_SCHEMA = (
    "feature string, n bigint, accuracy double, cv_scores array<double>, "
    "majority_share double, lift_over_majority double"
)


def measure_single_feature(t: LabelledTable, bins: int = 10, folds: int = 3) -> DataFrame:
    """Cross-validated accuracy of predicting the class from one binned feature.

    ``feature, n, accuracy, cv_scores, majority_share, lift_over_majority``.
    Each bin predicts the most frequent class of the other folds; a bin no other
    fold has seen predicts nothing. All features and folds come out of one table
    of counters; no model is trained.
    """
    if not t.numeric or not t.target_is_class:
        return empty(t.spark, SINGLE_SCHEMA)
    summary = t.class_summary
    labelled = summary["rows"] - summary["unlabelled"]
    splits = F.array(
        *[
            F.struct(
                F.lit(k).alias("fold"),
                F.col(f"n{k}").alias("held"),
                (F.col("n") - F.col(f"n{k}")).alias("seen"),
            )
            for k in range(folds)
        ]
    )
    scores = (
        bin_counts(t, bins, folds)
        .select("feature", "bin", "class", F.inline(splits))
        .groupBy("feature", "fold", "bin")
        .agg(
            F.min_by("held", F.struct(-F.col("seen"), F.col("class"))).alias("right"),
            F.max("seen").alias("seen"),
            F.sum("held").alias("held"),
        )
        .groupBy("feature", "fold")
        .agg(
            F.sum(F.when(F.col("seen") > 0, F.col("right")).otherwise(0)).alias("right"),
            F.sum("held").alias("held"),
        )
        .withColumn("score", F.try_divide(F.col("right").cast("double"), F.col("held")))
        .groupBy("feature")
        .agg(
            F.avg("score").alias("accuracy"),
            F.transform(F.sort_array(F.collect_list(F.struct("fold", "score"))), lambda s: s["score"]).alias(
                "cv_scores"
            ),
        )
    )
    majority = F.lit(summary["high"] / labelled if labelled else None).cast("double")
    return scores.select(
        "feature",
        F.lit(labelled).cast("bigint").alias("n"),
        "accuracy",
        "cv_scores",
        majority.alias("majority_share"),
        (F.col("accuracy") - majority).alias("lift_over_majority"),
    )


def flag_single_feature(
    measure: DataFrame,
    critical: float = 0.90,
    warning: float = 0.85,
    min_rows: int = MIN_ROWS,
    dataset: str = "table",
) -> DataFrame:
    strong = F.col("accuracy") > critical
    remark = F.when(strong, "potential shortcut learning").otherwise("investigate causality")
    extra = [c for c in ("lift_over_majority",) if c in measure.columns]
    return measure.where((F.col("accuracy") > warning) & (F.col("n") >= min_rows)).select(
        *finding(
            TOOL,
            F.when(strong, "single_feature_dominance").otherwise("high_single_feature_accuracy"),
            F.when(strong, "critical").otherwise("warning"),
            F.format_string(
                'Single feature "%s" achieves %.1f%% accuracy - %s', F.col("feature"), F.col("accuracy") * 100, remark
            ),
            F.col("accuracy"),
            F.struct("accuracy", "cv_scores", *extra),
            F.col("feature"),
            dataset=dataset,
        )
    )


def measure_threshold_rules(t: LabelledTable) -> DataFrame:
    """``feature, n, percentile, threshold, accuracy``: three rules a feature.

    The rule "above the percentile" is read as 1; one pass, no shuffle of rows.
    """
    schema = "feature string, n bigint, percentile int, threshold double, accuracy double"
    fields = usable_features(t) if t.target_is_numeric else []
    found = feature_quantiles(t) if fields else {}
    fields = [f for f in fields if f.name in found]
    if not fields:
        return empty(t.spark, schema)
    # The number of quartiles below the value decides all three rules at once.
    cells = {f.name: bin_number(t.imputed(f), [found[f.name][p] for p in QUARTILES]) for f in fields}
    y = F.col("y")
    counted = measure_cells(
        t.labelled_rows(),
        cells,
        lambda above: {
            "n": F.count(F.lit(1)),
            **{
                f"hits{i}": F.count_if(((above > i) & (y == 1)) | ((above <= i) & (y == 0)))
                for i in range(len(QUARTILES))
            },
        },
        "n bigint, hits0 bigint, hits1 bigint, hits2 bigint",
        {"y": t.target_number},
    )
    rows = [
        (f.name, i, int(p * 100), found[f.name][p]) for f in fields for i, p in enumerate(QUARTILES)
    ]
    rules = t.spark.createDataFrame(rows, "feature string, rule int, percentile int, threshold double")
    hits = F.element_at(F.array(*[F.col(f"hits{i}") for i in range(len(QUARTILES))]), F.col("rule") + 1)
    return counted.join(F.broadcast(rules), "feature").select(
        "feature",
        "n",
        "percentile",
        "threshold",
        F.try_divide(hits.cast("double"), F.col("n")).alias("accuracy"),
    )


def flag_threshold_rules(
    measure: DataFrame, threshold: float = 0.85, min_rows: int = MIN_ROWS, dataset: str = "table"
) -> DataFrame:
    """The lowest percentile that works is reported, one finding a feature."""
    first = (
        measure.where((F.col("accuracy") > threshold) & (F.col("n") >= min_rows))
        .groupBy("feature")
        .agg(F.min_by(F.struct("accuracy", "threshold", "percentile"), "percentile").alias("rule"))
        .select("feature", "rule.*")
    )
    return first.select(
        *finding(
            TOOL,
            "simple_threshold_rule",
            "warning",
            F.format_string(
                'Simple threshold rule on "%s" achieves %.1f%% accuracy', F.col("feature"), F.col("accuracy") * 100
            ),
            F.col("accuracy"),
            F.struct("accuracy", "threshold", "percentile"),
            F.col("feature"),
            dataset=dataset,
        )
    )


# --- forests ---------------------------------------------------------------


class Forests:
    """Every labelled row in bins, for the forest checks of an audit.

    Bins, trees and scores come from counts of all rows; the driver holds the trees.
    Folds and bootstrap draws are digests of the key, so they are the same in every run.
    """

    def __init__(self, t: LabelledTable, folds: int = 3):
        self.seed, self.folds = t.seed, folds
        usable = usable_features(t)
        self.features = [f.name for f in usable]
        summary = t.class_summary
        self.rows = summary["rows"] - summary["unlabelled"]
        names = sorted(r["class"] for r in t.classes.select("class").collect())
        self.classes = len(names)
        number = t.spark.createDataFrame(list(enumerate(names)), "label int, class string")
        cells = {f.name: t.imputed(f) for f in usable}
        labelled = t.labelled_rows()
        cuts = cut_points(labelled, cells, self.rows, t.ends)
        wide = labelled.select(
            *[cell.alias(f"x{i}") for i, cell in enumerate(cells.values())],
            t.label.alias("class"),
            hash_fold(t.row_key, t.seed, folds).alias("fold"),
            F.xxhash64(t.row_key).alias("draw"),
        ).join(F.broadcast(number), "class")
        placed = {name: F.col(f"x{i}") for i, name in enumerate(cells)}
        self.data = binned(wide, placed, cuts, F.col("label"), F.col("fold"), F.col("draw"))

    def scores(self, sets: Sequence[Sequence[int]], trees: int, depth: int) -> list[list[float]]:
        """Fold scores of several feature sets; all their forests grow in the same jobs."""
        plans = [Plan(tuple(columns), fold, trees, depth) for columns in sets for fold in range(self.folds)]
        done = fold_scores(self.data, plans, self.classes, self.seed)
        grouped = [done[i * self.folds : (i + 1) * self.folds] for i in range(len(sets))]
        return [[s for s in g if s is not None] for g in grouped]

    def importances(self, trees: int, depth: int) -> list[float]:
        plan = Plan(tuple(range(len(self.features))), -1, trees, depth)
        return importances(self.data, plan, len(self.features), self.classes, self.seed)


class ForestSample:
    """Assembled sample for the forest queries: at most ``size`` rows.

    Rows are ordered by key digest in one block, so bagging sees the same data in every run.
    """

    def __init__(self, t: LabelledTable, size: int = DEFAULT_ROWS, folds: int = 3):
        self.seed, self.folds = t.seed, folds
        usable = usable_features(t)
        self.features = [f.name for f in usable]
        labelled = LabelledTable(t.labelled_rows(), t.target, t.key, t.name, t.seed)
        drawn = adaptive_sample(labelled, size, with_target=False)
        flat = drawn.select(
            *[t.imputed(f).alias(f"x{i}") for i, f in enumerate(usable)],
            t.label.alias("class"),
            hash_fold(t.row_key, t.seed, folds).alias("fold"),
            F.md5(t.row_key.cast("binary")).alias("_order"),
        )
        flat = flat.repartition(1).sortWithinPartitions("_order").drop("_order")
        flat = flat.persist(StorageLevel.MEMORY_AND_DISK)
        indexed = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc").fit(flat).transform(flat)
        self.data = indexed
        self._held = flat
        self.rows = flat.count()

    def forest(self, trees: int, depth: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            numTrees=trees, maxDepth=depth, seed=self.seed, featuresCol="features", labelCol="label"
        )

    def vectors(self, columns: Sequence[int]) -> DataFrame:
        return VectorAssembler(inputCols=[f"x{i}" for i in columns], outputCol="features").transform(self.data)

    def fold_score(self, columns: Sequence[int], fold: int, trees: int, depth: int) -> float | None:
        ready = self.vectors(columns)
        train, held = ready.where(F.col("fold") != fold), ready.where(F.col("fold") == fold)
        model = self.forest(trees, depth).fit(train)
        right = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")))
        return right.first()[0]

    def scores(self, sets: Sequence[Sequence[int]], trees: int, depth: int) -> list[list[float]]:
        """Fold scores of several feature sets; the fits run concurrently."""
        tasks = [(columns, fold) for columns in sets for fold in range(self.folds)]
        with ThreadPool(8) as pool:
            done = pool.map(lambda a: self.fold_score(a[0], a[1], trees, depth), tasks)
        grouped = [done[i * self.folds : (i + 1) * self.folds] for i in range(len(sets))]
        return [[s for s in g if s is not None] for g in grouped]

    def importances(self, trees: int, depth: int) -> list[float]:
        model = self.forest(trees, depth).fit(self.vectors(range(len(self.features))))
        return [float(v) for v in model.featureImportances.toArray()]

    def close(self) -> None:
        self._held.unpersist()


def measure_single_feature_forest(t: LabelledTable, sample: Forests | ForestSample) -> DataFrame:
    """``feature, n, accuracy, cv_scores``: ten shallow trees per single feature."""
    schema = "feature string, n bigint, accuracy double, cv_scores array<double>"
    scored = sample.scores([[i] for i in range(len(sample.features))], trees=10, depth=3)
    rows = [
        (name, sample.rows, sum(s) / len(s), s) for name, s in zip(sample.features, scored) if s
    ]
    return t.spark.createDataFrame(rows, schema)


def measure_ablation(t: LabelledTable, sample: Forests | ForestSample) -> DataFrame:
    """``feature, n, baseline_accuracy, reduced_accuracy, drop_percentage``."""
    schema = (
        "feature string, n bigint, baseline_accuracy double, reduced_accuracy double, drop_percentage double"
    )
    every = list(range(len(sample.features)))
    if len(every) < 2:
        return empty(t.spark, schema)
    sets = [every] + [[j for j in every if j != i] for i in every]
    folds = sample.scores(sets, trees=20, depth=5)
    if not all(folds):
        return empty(t.spark, schema)
    scored = [sum(s) / len(s) for s in folds]
    base = scored[0]
    rows = [
        (name, sample.rows, base, kept, (base - kept) / base * 100 if base else None)
        for name, kept in zip(sample.features, scored[1:])
    ]
    return t.spark.createDataFrame(rows, schema)


def flag_ablation(
    measure: DataFrame, threshold: float = 15, min_rows: int = MIN_ROWS, dataset: str = "table"
) -> DataFrame:
    return measure.where((F.col("drop_percentage") > threshold) & (F.col("n") >= min_rows)).select(
        *finding(
            TOOL,
            "feature_removal_sensitivity",
            "warning",
            F.format_string(
                'Removing "%s" causes %.1f%% performance drop - possible over-reliance', "feature", "drop_percentage"
            ),
            F.col("drop_percentage"),
            F.struct("baseline_accuracy", "reduced_accuracy", "drop_percentage"),
            F.col("feature"),
            dataset=dataset,
        )
    )


def measure_importance(t: LabelledTable, sample: Forests | ForestSample) -> DataFrame:
    """``feature, n, importance``: impurity importances of fifty trees, sum 1."""
    rows = [(n, sample.rows, v) for n, v in zip(sample.features, sample.importances(50, 5))]
    return t.spark.createDataFrame(rows, "feature string, n bigint, importance double")


def flag_importance(
    measure: DataFrame, top: float = 70, top_two: float = 90, min_rows: int = MIN_ROWS, dataset: str = "table"
) -> DataFrame:
    entry = F.struct(F.col("importance"), F.col("feature"))
    ranked = measure.agg(
        F.max("n").alias("n"),
        F.count(F.lit(1)).alias("features"),
        F.sum("importance").alias("total"),
        F.sort_array(F.collect_list(entry), asc=False).alias("ranked"),
        F.map_from_entries(F.collect_list(F.struct("feature", "importance"))).alias("all"),
    ).where((F.col("n") >= min_rows) & (F.col("features") >= 3))
    first = F.element_at("ranked", 1)
    share = F.try_divide(first["importance"] * 100, F.col("total"))
    two = F.try_divide((first["importance"] + F.element_at("ranked", 2)["importance"]) * 100, F.col("total"))
    one = ranked.where(share > top).select(
        *finding(
            TOOL,
            "concentrated_importance",
            "warning",
            F.format_string(
                'Feature "%s" accounts for %.1f%% of importance - unusually concentrated', first["feature"], share
            ),
            share,
            F.struct(share.alias("importance_percentage"), F.col("all").alias("feature_importances")),
            first["feature"],
            dataset=dataset,
        )
    )
    pair = ranked.where((two > top_two) & (F.col("features") > 3)).select(
        *finding(
            TOOL,
            "top_features_dominate",
            "warning",
            F.format_string("Top 2 features account for %.1f%% of importance - check for shortcuts", two),
            two,
            F.struct(two.alias("top2_percentage"), F.col("features").alias("num_features")),
            dataset=dataset,
        )
    )
    return union_all([one, pair])


# --- deeper second look ----------------------------------------------------


def measure_relative_spread(t: LabelledTable) -> DataFrame:
    """``feature, n, coefficient_variation``: signed std / mean, 0 for mean 0."""
    spread = measure_cells(
        t.df,
        {f.name: as_number(f) for f in t.numeric},
        lambda value: {"n": F.count(value), "mean": F.avg(value), "std": F.stddev_samp(value)},
        "n bigint, mean double, std double",
    )
    ratio = F.when(F.col("mean") == 0, 0.0).otherwise(F.try_divide(F.col("std"), F.col("mean")))
    return spread.where("n > 0").select("feature", "n", ratio.alias("coefficient_variation"))


def flag_unstable(findings: DataFrame, spread: DataFrame, threshold: float = 0.1, dataset: str = "table") -> DataFrame:
    """Dominant single features that hardly vary."""
    suspects = findings.where(F.contains(F.col("type"), F.lit("dominance"))).select("feature").distinct()
    return spread.join(F.broadcast(suspects), "feature", "left_semi").where(
        F.col("coefficient_variation") < threshold
    ).select(
        *finding(
            TOOL,
            "unstable_predictor",
            "warning",
            F.format_string(
                'Feature "%s" has low variance (CV=%.4f) despite high accuracy - may not generalize',
                "feature",
                "coefficient_variation",
            ),
            F.col("coefficient_variation"),
            F.struct("coefficient_variation"),
            F.col("feature"),
            dataset=dataset,
        )
    )


def check_spurious(t: LabelledTable, single: str = "binned", forests: bool = True) -> DataFrame:
    """All shortcut findings of one table, from every labelled row.

    ``single`` picks the one-feature model: "binned" or "forest".
    ``forests=False`` leaves out ablation and importances.
    """
    if not t.numeric:
        return empty(t.spark, FINDINGS)
    parts = [flag_threshold_rules(measure_threshold_rules(t), dataset=t.name)]
    if single == "binned":
        parts.append(flag_single_feature(measure_single_feature(t), dataset=t.name))
    summary = t.class_summary
    enough = summary["rows"] - summary["unlabelled"] >= MIN_ROWS and summary["classes"] >= 2
    wanted = (forests or single == "forest") and enough and usable_features(t)
    if wanted and t.target_is_class:
        grown = Forests(t)
        if single == "forest":
            parts.append(flag_single_feature(measure_single_feature_forest(t, grown), dataset=t.name))
        if forests:
            parts.append(flag_ablation(measure_ablation(t, grown), dataset=t.name))
            if len(grown.features) >= 3:
                parts.append(flag_importance(measure_importance(t, grown), dataset=t.name))
    return union_all(parts)
