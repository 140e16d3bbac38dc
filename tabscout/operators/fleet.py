"""Check planning and audit history across many datasets.

Tables used here, one row per line of the list:

* profiles: ``by..., audit``, and the columns of ``profile.profile``;
* steps: ``by..., audit, position, tool, seconds, findings, criticals`` (one row
  per tool an audit ran);
* performance: what ``performance`` makes of the two, one row per audit.

``by`` names the columns that own a history (a team, a user); an empty ``by``
is one global history. ``audit`` orders an owner's audits and is unique within an
owner. Statistics that depend on the order of an
owner's audits are folded over blocks of that order, so one owner may have any number.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.operators.profile import dataset_type, profile_key
from tabscout.schema import TOOLS

# Per tool its cost weight and how often it finds critical issues.
TOOL_FACTS = (
    ("leakage_detector", 0.3, 0.15),
    ("contamination_detector", 0.2, 0.10),
    ("bias_detector", 0.2, 0.25),
    ("spurious_detector", 0.5, 0.20),
    ("feature_utility", 0.3, 0.05),
)
DEFAULT_SKIP_THRESHOLD = 0.45
# Contingency plans as trigger, priority, remediation, confidence,
# skipped tools, boosted tools, extra checks, goal, reasoning, recommendations.
PLANS = (
    (
        "leakage_detected", 10, "generate_leakage_removal_script", 0.95,
        ["spurious_detector"], ["bias_detector", "feature_utility"],
        ["temporal_leakage_check", "correlation_matrix_review"], "conservative_validation",
        "Data leakage invalidates model - must fix before proceeding",
        [
            "CRITICAL: Remove leaky features before any model training",
            "Verify that leaky features wouldn't be available at prediction time",
            "Consider temporal split validation to catch time-based leakage",
            "Review feature engineering pipeline for data snooping",
        ],
    ),
    (
        "severe_class_imbalance", 8, "generate_resampling_code", 0.90,
        [], ["contamination_detector"], ["stratification_check", "sampling_bias_analysis"], None,
        "Severe imbalance affects model training and evaluation",
        [
            "Use stratified sampling for train-test split",
            "Consider SMOTE, ADASYN, or class weights",
            "Use stratified K-fold cross-validation",
            "Choose metrics appropriate for imbalanced data (F1, AUC-ROC)",
            "Check if imbalance reflects true population distribution",
        ],
    ),
    (
        "contamination_detected", 9, "generate_deduplication_script", 0.95,
        [], ["leakage_detector"], ["duplicate_analysis", "train_test_overlap_check"], None,
        "Train-test contamination invalidates evaluation",
        [
            "CRITICAL: Remove duplicate samples from test set",
            "Re-split data with proper randomization",
            "Verify no information leakage during split",
            "Use scikit-learn's train_test_split with shuffle=True",
        ],
    ),
    (
        "multiple_critical_issues", 9, "generate_data_quality_report", 0.85,
        [], ["feature_utility"], ["comprehensive_audit", "cross_validation"], "deep_investigation",
        "Multiple critical issues suggest fundamental data problems",
        [
            "Dataset has multiple serious issues - recommend data quality review",
            "Consider data collection process audit",
            "May need significant data cleaning before modeling",
            "Document all issues for stakeholder review",
        ],
    ),
    (
        "high_spurious_correlation", 7, "generate_feature_analysis_report", 0.75,
        [], ["feature_utility", "bias_detector"], ["feature_interaction_analysis", "domain_validation"], None,
        "Spurious correlations won't generalize to new data",
        [
            "High accuracy from single features suggests shortcut learning",
            "Validate features against domain knowledge",
            "Test model on out-of-distribution data",
            "Consider ablation studies to understand feature importance",
            "Check for confounding variables",
        ],
    ),
    (
        "low_feature_quality", 5, "generate_feature_selection_code", 0.70,
        [], [], ["feature_engineering_suggestions"], None,
        "Low quality features waste computation and may harm model",
        [
            "Many low-variance or redundant features detected",
            "Consider feature selection (SelectKBest, RFE)",
            "Remove constant or near-constant features",
            "Apply PCA or feature extraction if appropriate",
            "Review feature engineering process",
        ],
    ),
    (
        "no_issues_found_yet", 3, None, 0.60,
        [], ["spurious_detector"], ["sensitivity_analysis"], "comprehensive_scan",
        "Clean data still needs thorough validation",
        [
            "No obvious issues found - running comprehensive checks",
            "Consider additional domain-specific validation",
            "Validate assumptions about data distribution",
            "Test model robustness with cross-validation",
        ],
    ),
    (
        "approaching_time_limit", 6, None, 0.80,
        ["feature_utility"], [], [], "quick_validation",
        "Time constraints require prioritization",
        [
            "Time limit approaching - focusing on critical checks only",
            "Consider running full audit offline for comprehensive results",
        ],
    ),
)
# Thresholds that a triggered plan changes.
PLAN_THRESHOLDS = {
    "leakage_detected": {"skip_threshold": 0.6},
    "multiple_critical_issues": {"skip_threshold": 0.2, "critical_threshold": 0.5},
    "no_issues_found_yet": {"skip_threshold": 0.3},
    "approaching_time_limit": {"skip_threshold": 0.55},
}

PLAN_SCHEMA = (
    "trigger string, priority int, auto_remediation string, plan_confidence double, "
    "skip_tools array<string>, boost_tools array<string>, extra_checks array<string>, "
    "change_goal string, reasoning string, user_recommendations array<string>, "
    "adjust_thresholds map<string,double>"
)


def plan_table(spark) -> DataFrame:
    return spark.createDataFrame([(*p, PLAN_THRESHOLDS.get(p[0], {})) for p in PLANS], PLAN_SCHEMA)


def with_tools(profiles: DataFrame) -> DataFrame:
    """Every profile row once per tool, with ``tool, tool_order, cost, critical_rate``."""
    tools = F.array(
        *[
            F.struct(
                F.lit(name).alias("tool"),
                F.lit(i).alias("tool_order"),
                F.lit(cost).alias("cost"),
                F.lit(rate).alias("critical_rate"),
            )
            for i, (name, cost, rate) in enumerate(TOOL_FACTS)
        ]
    )
    return profiles.select("*", F.inline(tools))


def eligible_tools(profiles: DataFrame) -> DataFrame:
    """Profiles x tools with ``eligible``: tiny tables skip two checks."""
    columns = F.col("num_features") + 1
    skip = ((F.col("tool") == "feature_utility") & (columns <= 3)) | (
        (F.col("tool") == "spurious_detector") & (F.col("num_rows") < 50)
    )
    return with_tools(profiles).withColumn("eligible", ~skip)


def relevance_score(effectiveness: Column) -> Column:
    """How much a tool matters for a profile row, in [0, 1]."""
    c, tool, zero = F.col, F.col("tool"), F.lit(0.0)
    leak = F.when(c("has_id_features"), 0.4).otherwise(zero) + F.when(
        c("has_temporal_features"), 0.3
    ).otherwise(zero) + F.lit(0.3)
    bias = (
        F.when(c("class_balance_ratio") < 0.5, 0.5).otherwise(zero)
        + F.when(c("class_balance_ratio") < 0.3, 0.3).otherwise(zero)
        + c("missing_ratio") * 0.3
        + F.lit(0.2)
    )
    contamination = F.when(c("num_rows") < 10_000, 0.3).otherwise(zero) + F.lit(0.4)
    spurious = (
        c("complexity_score") * 0.4
        + F.when(c("num_features") > 20, 0.3).otherwise(zero)
        + F.lit(0.2)
    )
    utility = F.when(c("num_features") > 30, 0.4).when(c("num_features") > 15, 0.2).otherwise(
        zero
    ) + F.lit(0.3)
    base = (
        F.when(tool == "leakage_detector", leak)
        .when(tool == "bias_detector", bias)
        .when(tool == "contamination_detector", contamination)
        .when(tool == "spurious_detector", spurious)
        .when(tool == "feature_utility", utility)
    )
    score = base + effectiveness * 0.3 - c("cost") * 0.1 + c("critical_rate") * 0.2
    return F.greatest(zero, F.least(F.lit(1.0), score))


def similar_effectiveness(
    profiles: DataFrame,
    history: DataFrame,
    steps: DataFrame,
    by: Sequence[str] = (),
) -> DataFrame:
    """``by..., audit, tool, effectiveness``: mean yield of a tool on similar tables.

    ``profiles`` are the tables to plan for, ``history`` the profiles of past
    audits. Similar: sizes and feature counts within a factor of two, complexity
    within 0.3. Past audits are summed up in cells of half an octave of size and of
    features and 0.1 of complexity. A profile meets the cells of the sizes
    around its own: the sums of a cell whose extremes are all similar count as
    they are, one whose extremes rule it out is left, and only the audits in
    cells on the border are compared singly, equal ones as one.
    """
    by = list(by)
    gain = F.least(F.lit(1.0), F.col("criticals") / F.greatest(F.lit(1.0), F.col("seconds")))

    def octaves(name: str) -> Column:
        return F.when(F.col(name) > 0, F.floor(2 * F.log2(F.col(name).cast("double")))).otherwise(-1).cast("int")

    axes = {"num_rows": octaves("num_rows"), "num_features": octaves("num_features"), "complexity_score": F.floor(F.col("complexity_score") * 10).cast("int")}
    cell = [f"cell_{name}" for name in axes]
    past = stored(
        steps.join(history.select(*by, "audit", *axes), [*by, "audit"])
        .groupBy(*by, *axes, "tool")
        .agg(F.sum(gain).alias("gain"), F.count(F.lit(1)).alias("n"))
        .withColumns({f"cell_{name}": place for name, place in axes.items()})
    )
    ends = [e for name in axes for e in (F.min(name).alias(f"least_{name}"), F.max(name).alias(f"most_{name}"))]
    cells = past.groupBy(*by, *cell, "tool").agg(F.sum("gain").alias("gain"), F.sum("n").alias("n"), *ends)
    around = [axes["num_rows"] + i for i in range(-3, 4)]
    wanted = profiles.select(*by, "audit", *axes, F.explode(F.array(*around)).alias("cell_num_rows"))

    def near(name: str, other: Column) -> Column:
        own = F.col(f"p.{name}")
        if name == "complexity_score":
            return F.abs(own - other) <= 0.3
        return F.try_divide(F.abs(own - other).cast("double"), F.greatest(own, other)) <= 0.5

    def whole(prefix: str) -> Column:
        """Both extremes of every axis are similar, hence everything between them."""
        return reduce(lambda a, b: a & b, [near(name, F.col(f"{prefix}.{end}_{name}")) for name in axes for end in ("least", "most")])

    def apart(prefix: str) -> Column:
        """On some axis all of the cell lies to one side, and the end that is closer is not similar."""
        sides = []
        for name in axes:
            own, least, most = F.col(f"p.{name}"), F.col(f"{prefix}.least_{name}"), F.col(f"{prefix}.most_{name}")
            sides.append(((own < least) & ~near(name, least)) | ((own > most) & ~near(name, most)))
        return F.coalesce(reduce(lambda a, b: a | b, sides), F.lit(False))

    def same(left: str, right: str, names: Sequence[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names])

    met = (
        wanted.alias("p")
        .join(cells.alias("c"), same("p", "c", [*by, "cell_num_rows"]) & ~apart("c"))
        .select(
            *[F.col(f"p.{c}") for c in (*by, "audit", *axes)],
            *[F.col(f"c.{c}") for c in (*cell, "tool", "gain", "n")],
            F.coalesce(whole("c"), F.lit(False)).alias("inside"),
        )
    )
    met = stored(met)
    single = (
        met.where(~F.col("inside"))
        .drop("gain", "n")
        .alias("p")
        .join(past.alias("h"), same("p", "h", [*by, *cell, "tool"]) & reduce(lambda a, b: a & b, [near(n, F.col(f"h.{n}")) for n in axes]))
        .select(*[F.col(f"p.{c}") for c in (*by, "audit", "tool")], "h.gain", "h.n")
    )
    return (
        met.where("inside")
        .select(*by, "audit", "tool", "gain", "n")
        .unionByName(single)
        .groupBy(*by, "audit", "tool")
        .agg((F.sum("gain") / F.sum("n")).alias("effectiveness"))
    )


def score_tools(
    profiles: DataFrame, effectiveness: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Profiles x tools with ``effectiveness`` (0.5 when unknown) and ``score``."""
    pairs = with_tools(profiles)
    if effectiveness is None:
        pairs = pairs.withColumn("effectiveness", F.lit(0.5))
    else:
        pairs = pairs.join(effectiveness, [*by, "audit", "tool"], "left").withColumn(
            "effectiveness", F.coalesce("effectiveness", F.lit(0.5))
        )
    return pairs.withColumn("score", relevance_score(F.col("effectiveness")))


def check_plan(
    scores: DataFrame,
    threshold: Column | float = DEFAULT_SKIP_THRESHOLD,
    boosts: DataFrame | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The tools worth running per profile, best first, as ``plan_position``."""
    if boosts is not None:
        scores = (
            scores.join(boosts.select(*by, "audit", "tool", "boost"), [*by, "audit", "tool"], "left")
            .withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0)))
            .drop("boost")
        )
    limit = F.lit(threshold) if isinstance(threshold, float) else threshold
    rank = F.row_number().over(W.partitionBy(*by, "audit").orderBy(F.desc("score"), "tool_order"))
    return scores.where(F.col("score") >= limit).withColumn("plan_position", rank)


def audit_outcomes(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``tools, total_time, critical_found, efficiency, critical_per_tool, coverage``."""
    return (
        steps.groupBy(*by, "audit")
        .agg(
            F.count(F.lit(1)).alias("tools"),
            F.sum("seconds").alias("total_time"),
            F.sum("criticals").alias("critical_found"),
        )
        .withColumn(
            "efficiency",
            F.when(F.col("total_time") > 0, F.col("tools") / F.col("total_time")).otherwise(0.0),
        )
        .withColumn("critical_per_tool", F.col("critical_found") / F.col("tools"))
        .withColumn("coverage", F.col("tools") / F.lit(float(len(TOOLS))))
    )


def tool_usage(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return steps.groupBy(*by, "tool").agg(F.count(F.lit(1)).alias("audits"))


def profile_variety(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``audits, unique_profiles, dataset_types`` of each history."""
    return profiles.groupBy(*by).agg(
        F.count(F.lit(1)).alias("audits"),
        F.count_distinct(profile_key()).alias("unique_profiles"),
        F.count_distinct(dataset_type()).alias("dataset_types"),
    )


def in_blocks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], blocks: int | None = None) -> DataFrame:
    """The rows with ``_block``: runs of each key's order, numbered in it, so that a long history is many tasks' work.

    A block is a range partition over keys and order, as many as shuffles have
    partitions unless told. Rows that agree in both share one.
    """
    count = blocks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [F.col(c) for c in (*keys, *order)]
    return stored(rows.repartitionByRange(count, *names).withColumn("_block", F.spark_partition_id()))


def running_effectiveness(
    values: DataFrame, keys: Sequence[str], order: Sequence[str], from_first: bool, blocks: int | None = None
) -> DataFrame:
    """``keys..., effectiveness``: the recurrence ``e = (e + value) / 2`` per key.

    It starts from the first value itself, or from 0. A run of n values takes e to
    e / 2^n + s, where s weighs them 1/2, 1/4, ... from the newest back. Runs are
    folded block by block and then in the order of the blocks, s1 / 2^n2 + s2, so
    no task holds a whole key, however many values it has.
    """
    age = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*[F.desc(o) for o in order]))
    folded = (
        in_blocks(values, keys, order, blocks)
        .withColumn("_age", age)
        .groupBy(*keys, "_block")
        .agg(
            F.sum(F.col("value") * F.pow(F.lit(0.5), F.col("_age"))).alias("s"),
            F.count(F.lit(1)).alias("n"),
            F.max_by("value", "_age").alias("oldest"),
        )
    )
    # From here on one row per key and block.
    newer = F.sum("n").over(W.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(W.unboundedPreceding, -1))
    total = F.sum(F.col("s") * F.pow(F.lit(0.5), F.coalesce("_newer", F.lit(0))))
    if from_first:
        total = total + F.min_by("oldest", "_block") * F.pow(F.lit(0.5), F.sum("n"))
    return folded.withColumn("_newer", newer).groupBy(*keys).agg(total.alias("effectiveness"))


def strategy_effectiveness(steps: DataFrame, profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., tool, profile_key, effectiveness``: running criticals per second."""
    keyed = profiles.select(*by, "audit", profile_key().alias("profile_key"))
    values = steps.join(keyed, [*by, "audit"]).withColumn(
        "value", F.col("criticals") / F.greatest(F.lit(0.1), F.col("seconds"))
    )
    return running_effectiveness(values, [*by, "tool", "profile_key"], ["audit"], True)


def mean_effectiveness(effectiveness: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., tool, effectiveness``: the mean over all profile keys of ``strategy_effectiveness``."""
    return effectiveness.groupBy(*by, "tool").agg(F.avg("effectiveness").alias("effectiveness"))


def performance(steps: DataFrame, profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per audit: speed, yield and context.

    ``tool_sequence, time_to_first_critical`` (NULL when none), ``total_time,
    critical_found, empty_share, efficiency, early_stop, dataset_type,
    complexity_score``. An audit has at most one row per tool.
    """
    owner = [*by, "audit"]
    spent = F.sum("seconds").over(
        W.partitionBy(*owner).orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    )
    per_audit = (
        steps.withColumn("spent", spent)
        .groupBy(*owner)
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("position", "tool"))), lambda s: s["tool"]
            ).alias("tool_sequence"),
            F.min(F.when(F.col("criticals") > 0, F.col("spent"))).alias("time_to_first_critical"),
            F.sum("seconds").alias("total_time"),
            F.sum("criticals").alias("critical_found"),
            F.avg((F.col("findings") == 0).cast("double")).alias("empty_share"),
        )
        .withColumn(
            "efficiency",
            F.when(F.col("total_time") > 0, F.col("critical_found") / F.col("total_time")).otherwise(0.0),
        )
        .withColumn("early_stop", F.size("tool_sequence") < len(TOOLS))
    )
    context = profiles.select(
        *owner, dataset_type().alias("dataset_type"), "complexity_score", "has_id_features", "class_balance_ratio"
    )
    return per_audit.join(context, owner)


def position_effectiveness(perf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., dataset_type, tool, effectiveness``: early, efficient tools score high."""
    value = F.when(
        F.col("time_to_first_critical").isNotNull(), F.col("efficiency") / (F.col("i") + 1)
    ).otherwise(0.5)
    values = perf.select(
        *by, "audit", "dataset_type", "efficiency", "time_to_first_critical",
        F.posexplode("tool_sequence").alias("i", "tool"),
    ).withColumn("value", value)
    return running_effectiveness(values, [*by, "dataset_type", "tool"], ["audit"], False)


def best_sequences(perf: DataFrame, by: Sequence[str] = (), min_efficiency: float = 0.1) -> DataFrame:
    """``by..., dataset_type, tool_sequence, efficiency, audits``.

    The sequence with the best mean efficiency among those that once found a
    critical issue efficiently. A batch rule: the result does not depend on the
    order in which audits happened to be learned from.
    """
    worked = (F.col("critical_found") > 0) & (F.col("efficiency") > min_efficiency)
    means = (
        perf.withColumn("sequence", F.concat_ws(">", "tool_sequence"))
        .groupBy(*by, "dataset_type", "sequence")
        .agg(
            F.avg("efficiency").alias("efficiency"),
            F.count(F.lit(1)).alias("audits"),
            F.count_if(worked).alias("successes"),
        )
        .where("successes > 0")
    )
    # At most a few hundred orders of five tools per dataset type.
    rank = F.row_number().over(
        W.partitionBy(*by, "dataset_type").orderBy(F.desc(F.round("efficiency", 12)), F.desc("audits"), "sequence")
    )
    return means.withColumn("rank", rank).where("rank = 1").drop("rank", "successes")


def recent_empty_share(perf: DataFrame, by: Sequence[str] = (), last: int = 10, blocks: int | None = None) -> DataFrame:
    """Each audit with ``seen`` (audits so far) and the mean empty share of the last ten."""
    return _recent_in_blocks(perf, by, last, blocks).drop("_block")


def _recent_in_blocks(perf: DataFrame, by: Sequence[str], last: int, blocks: int | None) -> DataFrame:
    """The same with the block of the owner's history that an audit is in.

    Each block gets the last nine rows before it,
    which the last nine blocks before it have, and the number of rows before it.
    """
    by, halo = list(by), last - 1
    rows = in_blocks(perf.select(*by, "audit", "empty_share"), by, ["audit"], blocks)
    newest = F.row_number().over(W.partitionBy(*by, "_block").orderBy(F.desc("audit")))
    ends = (
        rows.withColumn("_age", newest)
        .groupBy(*by, "_block")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sort_array(F.collect_list(F.when(F.col("_age") <= halo, F.struct("audit", "empty_share")))).alias("tail"),
        )
    )
    earlier = W.partitionBy(*by).orderBy("_block")  # one row per key and block
    before = ends.select(
        *by,
        "_block",
        F.coalesce(F.sum("n").over(earlier.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.flatten(F.collect_list("tail").over(earlier.rowsBetween(-halo, -1))).alias("tails"),
    ).withColumn("tails", F.slice("tails", F.greatest(F.lit(1), F.size("tails") - (halo - 1)), halo))
    same = reduce(lambda a, b: a & b, [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_block")])
    own = rows.alias("r").join(before.alias("b"), same).select("r.*", "_before", F.lit(False).alias("_halo"))
    extra = before.select(*by, F.inline("tails"), "_block", "_before", F.lit(True).alias("_halo"))
    order = W.partitionBy(*by, "_block").orderBy(F.desc("_halo"), "audit")
    return (
        own.unionByName(extra)
        .select(
            *by,
            "audit",
            "_halo",
            (F.count_if(~F.col("_halo")).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("_before")).alias("seen"),
            F.avg("empty_share").over(order.rowsBetween(-halo, 0)).alias("recent_empty_share"),
            "_block",
        )
        .where(~F.col("_halo"))
        .drop("_halo")
    )


def _clamped(value: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, value))


def tune_threshold(perf: DataFrame, by: Sequence[str] = (), blocks: int | None = None) -> DataFrame:
    """``by..., audits, steps, skip_threshold``: the threshold after all audits in order.

    From 0.45, 0.05 up when more than 40 % of recent tools found nothing, 0.05
    down below 10 %, within [0.3, 0.6]. Kept as whole steps of 0.05, so repeated
    additions do not drift. A run of moves takes any level x to x + shift, held
    between low and high; that triple is folded move by move within a block of the
    history, and block by block after that.
    """
    by = list(by)
    share, low, high = F.col("recent_empty_share"), F.lit(-3), F.lit(3)
    moves = _recent_in_blocks(perf, by, 10, blocks).withColumn(
        "move",
        F.when(F.col("seen") < 3, 0).when(share > 0.4, 1).when(share < 0.1, -1).otherwise(0),
    )
    ordered = F.sort_array(F.collect_list(F.when(F.col("move") != 0, F.struct("audit", "move"))))
    free = F.struct(F.lit(0).alias("shift"), F.lit(-1_000_000).alias("low"), F.lit(1_000_000).alias("high"))

    def moved(run: Column, m: Column) -> Column:
        ends = [_clamped(run[e] + m["move"], low, high).alias(e) for e in ("low", "high")]
        return F.struct((run["shift"] + m["move"]).alias("shift"), *ends)

    runs = moves.groupBy(*by, "_block").agg(F.aggregate(ordered, free, moved).alias("run"), F.count(F.lit(1)).alias("n"))
    level = F.aggregate(
        F.sort_array(F.collect_list(F.struct("_block", "run"))),
        F.lit(0),
        lambda x, b: _clamped(x + b["run"]["shift"], b["run"]["low"], b["run"]["high"]),
    )
    return (
        runs.groupBy(*by)
        .agg(F.sum("n").alias("audits"), level.alias("steps"))
        .select(
            *by,
            "audits",
            "steps",
            F.round(F.lit(DEFAULT_SKIP_THRESHOLD) + F.col("steps") * 0.05, 2).alias("skip_threshold"),
        )
    )


def mine_patterns(perf: DataFrame, by: Sequence[str] = (), last: int = 20) -> DataFrame:
    """``by..., pattern, tool, confidence, sample_size`` from the newest audits."""
    newest = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("audit")))
    recent = perf.withColumn("age", newest).where(F.col("age") <= last)
    risky = F.col("complexity_score") > 0.4
    uneven = F.contains(F.col("dataset_type"), F.lit("imbalanced"))
    leads = F.try_element_at("tool_sequence", F.lit(1)) == "leakage_detector"
    early = F.array_contains(F.slice("tool_sequence", 1, 2), "bias_detector")
    facts = recent.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(risky).alias("risky"),
        F.count_if(risky & leads).alias("led"),
        F.count_if(uneven).alias("uneven"),
        F.count_if(uneven & early).alias("early"),
    )

    def entry(pattern: str, tool: str, hits: str, group: str) -> Column:
        share = F.try_divide(F.col(hits).cast("double"), F.col(group))
        return F.when(
            (F.col(group) >= 3) & (share > 0.7),
            F.struct(
                F.lit(pattern).alias("pattern"),
                F.lit(tool).alias("tool"),
                share.alias("confidence"),
                F.col(group).alias("sample_size"),
            ),
        )

    found = F.array_compact(
        F.array(
            entry("id_features_leakage_first", "leakage_detector", "led", "risky"),
            entry("imbalanced_bias_priority", "bias_detector", "early", "uneven"),
        )
    )
    return facts.where("n >= 5").select(*by, F.inline(found))


def learned_boosts(profiles: DataFrame, patterns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., audit, tool, pattern, boost``: patterns that apply to a profile.

    A history has at most two patterns; without ``by`` the two-row pattern table
    is looked up by the condition each profile meets.
    """
    met = F.array_compact(
        F.array(
            F.when(F.col("has_id_features"), F.lit("id_features_leakage_first")),
            F.when(F.col("class_balance_ratio") < 0.3, F.lit("imbalanced_bias_priority")),
        )
    )
    weight = F.when(F.col("pattern") == "id_features_leakage_first", 0.3).otherwise(0.2)
    return (
        profiles.select(*by, "audit", F.explode(met).alias("pattern"))
        .join(patterns, [*by, "pattern"])
        .select(*by, "audit", "tool", "pattern", (weight * F.col("confidence")).alias("boost"))
    )


def tool_ranking(effectiveness: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., dataset_type, tool, place``: tools by learned effectiveness."""
    rank = F.row_number().over(
        W.partitionBy(*by, "dataset_type").orderBy(F.desc(F.round("effectiveness", 9)), "tool")
    )
    return effectiveness.withColumn("place", rank)


def improvement(perf: DataFrame, by: Sequence[str] = (), window: int = 5) -> DataFrame:
    """``by..., audits, early_efficiency, late_efficiency, improvement_rate``.

    First against last five audits in percent, within +-100; 0 below ten audits.
    """
    owner = list(by)
    if not owner:
        # One history: a constant owner keeps the join below an equality join.
        return improvement(perf.withColumn("_all", F.lit(0)), ["_all"], window).drop("_all")
    ends = []
    for side, order in (("early", F.asc("audit")), ("late", F.desc("audit"))):
        rank = F.row_number().over(W.partitionBy(*owner).orderBy(order))
        ends.append(
            perf.withColumn("rank", rank)
            .where(F.col("rank") <= window)
            .select(*owner, F.lit(side).alias("side"), "efficiency")
        )
    means = (
        ends[0]
        .unionByName(ends[1])
        .groupBy(*owner)
        .agg(
            F.avg(F.when(F.col("side") == "early", F.col("efficiency"))).alias("early_efficiency"),
            F.avg(F.when(F.col("side") == "late", F.col("efficiency"))).alias("late_efficiency"),
        )
    )
    counts = perf.groupBy(*owner).agg(F.count(F.lit(1)).alias("audits"))
    joined = counts.join(means, owner)
    change = F.try_divide(F.col("late_efficiency") - F.col("early_efficiency"), F.col("early_efficiency")) * 100
    return joined.withColumn(
        "improvement_rate",
        F.when(F.col("audits") < 2 * window, 0.0)
        .when(F.col("early_efficiency") == 0, 0.0)
        .otherwise(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), change))),
    )


def history_summary(perf: DataFrame, by: Sequence[str] = (), last: int = 10) -> DataFrame:
    """``audits, avg_efficiency_recent, avg_time_to_critical`` over the newest ten."""
    newest = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("audit")))
    return (
        perf.withColumn("age", newest)
        .where(F.col("age") <= last)
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("recent_audits"),
            F.avg("efficiency").alias("avg_efficiency_recent"),
            F.avg("time_to_first_critical").alias("avg_time_to_critical"),
        )
    )


def contingency_triggers(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """``dataset, trigger, place`` and the plan's columns, most urgent first.

    ``runs`` has ``dataset, tools, time_used, time_budget``; ``findings`` may be
    the whole fleet's. All eight rules come from one conditional aggregate.
    """
    tool, critical = F.col("tool"), F.col("severity") == "critical"
    facts = findings.groupBy("dataset").agg(
        F.count_if((tool == "leakage_detector") & critical).alias("leaks"),
        F.count_if((tool == "bias_detector") & (F.col("type") == "severe_imbalance")).alias("severe"),
        F.count_if((tool == "contamination_detector") & critical).alias("overlaps"),
        F.count_if(critical).alias("criticals"),
        F.count_if(tool == "spurious_detector").alias("spurious"),
        F.count_if(tool == "feature_utility").alias("utility"),
    )
    c = F.col
    rules = {
        "leakage_detected": c("leaks") > 0,
        "severe_class_imbalance": c("severe") > 0,
        "contamination_detected": c("overlaps") > 0,
        "multiple_critical_issues": c("criticals") >= 3,
        "high_spurious_correlation": c("spurious") >= 10,
        "low_feature_quality": c("utility") > c("tools") * 3,
        "no_issues_found_yet": (c("criticals") == 0) & (c("tools") >= 2),
        "approaching_time_limit": c("time_used") > c("time_budget") * 0.7,
    }
    fired = F.array_compact(
        F.array(
            *[
                F.when(rule, F.struct(F.lit(name).alias("trigger"), F.lit(i).alias("rule")))
                for i, (name, rule) in enumerate(rules.items())
            ]
        )
    )
    # At most eight rows per dataset.
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("priority"), "rule"))
    return (
        runs.join(facts, "dataset", "left")
        .na.fill(0)
        .select("dataset", F.inline(fired))
        .join(F.broadcast(plan_table(findings.sparkSession)), "trigger")
        .withColumn("place", place)
        .drop("rule")
    )


def remediations(triggers: DataFrame) -> DataFrame:
    """Triggered plans that come with a remediation, most urgent first."""
    return triggers.where(F.col("auto_remediation").isNotNull()).select(
        "dataset",
        "trigger",
        F.col("auto_remediation").alias("remediation_type"),
        F.col("user_recommendations").alias("recommendations"),
        "priority",
        F.col("plan_confidence").alias("confidence"),
    )


def adjusted_thresholds(triggers: DataFrame) -> DataFrame:
    """``dataset, threshold, value``: what a dataset's plans set, the most urgent plan deciding."""
    changes = triggers.select("dataset", "place", F.explode("adjust_thresholds").alias("threshold", "value"))
    return changes.groupBy("dataset", "threshold").agg(F.min_by("value", "place").alias("value"))


def contingency_summary(triggers: DataFrame) -> DataFrame:
    return triggers.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("plans_triggered"),
        F.sum(F.size("user_recommendations")).alias("total_recommendations"),
        F.count("auto_remediation").alias("auto_remediations_available"),
    )
