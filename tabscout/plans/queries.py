"""One query per operator over the shared tables; doubles rounded, columns named."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.functions.lineage import shared_folder
from tabscout.operators import bias, contamination, fleet, generators, leakage, sampling, spurious, utility
from tabscout.operators import profile as prof
from tabscout.operators import report as roll
from tabscout.plans import workloads as wl
from tabscout.plans.audit import audit
from tabscout.schema import union_all
from tabscout.sources import sinks
from tabscout.sources.tables import load_split, read_table
from tabscout.table import LabelledTable

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of a sum's order do not matter."""
    return df.select(
        *[
            (F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if kind == "double" else F.col(n)
            for n, kind in df.dtypes
        ]
    )


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


def _joined(name: str, sep: str = " / ") -> Column:
    return F.concat_ws(sep, F.col(name)).alias(name)


# --- leakage ---


@query
def leak_corr(spark, d):
    fit = leakage.measure_target_fit(wl.line_audit(spark, d))
    return rounded(fit.select("feature", "n", "correlation"))


@query
def leak_linear(spark, d):
    fit = leakage.measure_target_fit(wl.line_audit(spark, d))
    return rounded(fit.select("feature", "r2", "coefficient", "intercept"))


@query
def leak_mutual_info(spark, d):
    found = leakage.measure_text_association(wl.region_audit(spark, d))
    return rounded(
        found.select(
            "feature",
            "n",
            "mutual_information",
            "target_entropy",
            leakage.normalized_mi().alias("normalized_mi"),
            leakage.normalized_mi("mixed").alias("normalized_mi_mixed_units"),
        )
    )


@query
def leak_perfect_predictor(spark, d):
    found = leakage.measure_text_association(wl.region_audit(spark, d))
    pure = (F.col("n") >= 10) & (F.col("distinct_values") > 2) & (F.col("max_classes_per_value") == 1)
    return found.select("feature", "n", "distinct_values", "max_classes_per_value", pure.alias("perfect"))


@query
def leak_names(spark, d):
    t = LabelledTable(wl.read(spark, d, "lineitem"), "l_returnflag", name="lineitem")
    return leakage.measure_names(t)


@query
def leak_identical(spark, d):
    return leakage.measure_identical(wl.line_audit(spark, d))


@query
def leak_encoded_target(spark, d):
    t = LabelledTable(
        wl.read(spark, d, "part").select("p_brand", "p_name", "p_type", "p_size"), "p_size", name="part"
    )
    return leakage.measure_encoded_target(t)


@query
def leak_findings(spark, d):
    found = leakage.check_leakage(wl.line_audit(spark, d))
    return found.select("tool", "type", "severity", "feature")


# --- contamination ---


@query
def dup_rows(spark, d):
    docs = contamination.measure_duplicates(wl.read(spark, d, "documents"), ["text", "lang"])
    lines = contamination.measure_duplicates(
        wl.read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    )
    return rounded(
        docs.select(F.lit("documents").alias("source"), "*").unionByName(
            lines.select(F.lit("lineitem").alias("source"), "*")
        )
    )


@query
def contam_exact(spark, d):
    return rounded(contamination.measure_exact_overlap(*wl.document_split(spark, d)))


@query
def contam_hash(spark, d):
    return rounded(contamination.measure_hash_overlap(*wl.document_split(spark, d)))


@query
def contam_keys(spark, d):
    lines = wl.read(spark, d, "lineitem")
    train, test = lines.where("l_linenumber <= 5"), lines.where("l_linenumber > 5")
    return rounded(contamination.measure_key_overlap(train, test, ["l_orderkey"]))


@query
def contam_cosine(spark, d):
    train, test = wl.embedding_split(spark, d)
    return rounded(contamination.measure_near_duplicates(train, test, vector="v").drop("pairs"))


@query
def contam_cosine_rows(spark, d):
    train, test = wl.part_split(spark, d)
    return rounded(
        contamination.measure_near_duplicates(train, test, threshold=0.9999, standardize=True).drop("pairs")
    )


@query
def split_sizes(spark, d):
    return contamination.split_sizes(*wl.document_split(spark, d))


# --- bias ---


def _balanced_tables(spark, d) -> list[LabelledTable]:
    return [
        LabelledTable(wl.read(spark, d, "labels"), "toxic", ("doc_id",), "labels"),
        LabelledTable(wl.read(spark, d, "events"), "event_type", ("event_id",), "events"),
        LabelledTable(wl.read(spark, d, "lineitem"), "l_returnflag", (), "lineitem"),
    ]


@query
def class_balance(spark, d):
    return rounded(
        union_all(
            [
                bias.measure_classes(t).select(F.lit(t.name).alias("source"), "class", "n", "percentage")
                for t in _balanced_tables(spark, d)
            ]
        )
    )


@query
def class_ratio(spark, d):
    return rounded(
        union_all(
            [
                bias.measure_balance(t).select(F.lit(t.name).alias("source"), "*")
                for t in _balanced_tables(spark, d)
            ]
        )
    )


@query
def kruskal(spark, d):
    lines = bias.measure_kruskal(wl.line_audit(spark, d, three_classes=True))
    events = LabelledTable(
        wl.read(spark, d, "events").select("value", "event_type"), "event_type", name="events"
    )
    return rounded(
        lines.select(F.lit("lineitem").alias("source"), "*").unionByName(
            bias.measure_kruskal(events).select(F.lit("events").alias("source"), "*")
        )
    )


@query
def sample_size_findings(spark, d):
    """Class balance and sample size of three tables; the twin states the thresholds."""
    labels, events = wl.read(spark, d, "labels"), wl.read(spark, d, "events")
    tables = [
        LabelledTable(labels, "toxic", name="labels by toxic"),
        LabelledTable(labels.where("toxic = 1"), "quality", name="toxic labels by quality"),
        LabelledTable(events, "event_type", name="events"),
        LabelledTable(events.where("event_id = 0"), "event_type", name="one event"),
    ]
    return union_all([bias.flag_classes(t).select("dataset", "type", "severity", rounded_metric()) for t in tables])


def rounded_metric():
    return F.round("metric", 6).alias("metric")


@query
def missing_by_class(spark, d):
    return bias.missing_by_class(wl.line_audit(spark, d, three_classes=True))


@query
def missing_chi2(spark, d):
    wanted = ["feature", "rows", "missing", "missing_rate", "difference", "dof", "chi2", "p_value"]
    three = bias.measure_missingness(wl.line_audit(spark, d, three_classes=True), with_rates=False)
    two = bias.measure_missingness(wl.line_audit(spark, d), with_rates=False)
    both = three.select(F.lit("target3").alias("label"), *wanted).unionByName(
        two.select(F.lit("target").alias("label"), *wanted)
    )
    return rounded(_longs(both, "dof"))


@query
def skewness(spark, d):
    lines = bias.measure_skewness(wl.line_audit(spark, d))
    events = LabelledTable(
        wl.read(spark, d, "events").select("value", "event_type"), "event_type", name="events"
    )
    return rounded(lines.unionByName(bias.measure_skewness(events)), 4)


# --- samplers ---


@query
def sample_columns(spark, d):
    t = LabelledTable(wl.read(spark, d, "lineitem"), "l_returnflag", name="lineitem")
    return rounded(_longs(sampling.score_columns(t, budget=5), "position"), 2)


def _keyed_events(spark, d, target: str = "event_type") -> LabelledTable:
    return LabelledTable(
        wl.read(spark, d, "events").select("event_id", "user_id", "event_type", "value"),
        target,
        ("event_id",),
        "events",
    )


@query
def sample_stratified(spark, d):
    return sampling.stratified_sample(_keyed_events(spark, d), 1000)


@query
def sample_quantile(spark, d):
    return sampling.quantile_sample(wl.order_audit(spark, d), 1000)


@query
def sample_random(spark, d):
    return sampling.random_sample(_keyed_events(spark, d), 1000)


@query
def sample_adaptive(spark, d):
    return sampling.adaptive_sample(wl.order_audit(spark, d), 1200).select("o_orderkey", "target")


@query
def sample_cluster(spark, d):
    t = LabelledTable(wl.read(spark, d, "embeddings"), "label", ("vec_id",), "embeddings")
    return sampling.cluster_sample(t, 200, vector="embedding").select("vec_id", "label")


# --- shortcuts ---


@query
def single_feature_binned(spark, d):
    found = spurious.measure_single_feature(wl.order_audit(spark, d))
    return rounded(found.drop("cv_scores"))


@query
def threshold_rules(spark, d):
    found = spurious.measure_threshold_rules(wl.order_audit(spark, d))
    return rounded(_longs(found, "percentile"))


@query
def relative_spread(spark, d):
    return rounded(spurious.measure_relative_spread(wl.line_audit(spark, d)))


@query
def unstable_predictors(spark, d):
    t = wl.order_audit(spark, d)
    dominant = spurious.flag_single_feature(spurious.measure_single_feature(t), warning=0.5, critical=0.5)
    found = spurious.flag_unstable(dominant, spurious.measure_relative_spread(t), threshold=0.6)
    return rounded(found.select("feature", "type", "severity", "metric"))


def _forest(spark, d) -> tuple[LabelledTable, spurious.ForestSample]:
    t = wl.order_audit(spark, d)
    return t, spurious.ForestSample(t)


@query
def single_feature_forest(spark, d):
    t, sample = _forest(spark, d)
    return spurious.measure_single_feature_forest(t, sample).drop("cv_scores")


@query
def ablation(spark, d):
    t, sample = _forest(spark, d)
    return spurious.measure_ablation(t, sample)


@query
def importance(spark, d):
    t, sample = _forest(spark, d)
    return spurious.measure_importance(t, sample)


# --- utility ---


@query
def value_concentration(spark, d):
    found = utility.measure_values(wl.line_audit(spark, d))
    share = F.try_divide(F.col("top_count").cast("double"), F.col("rows"))
    return rounded(found.select("feature", "rows", "distinct_values", "top_count", share.alias("top_share")))


@query
def cardinality(spark, d):
    t = wl.region_audit(spark, d)
    ratio = F.try_divide(F.col("distinct_values").cast("double"), F.col("rows"))
    found = utility.measure_values(t).withColumn("ratio", ratio)
    return rounded(
        found.select(
            "feature",
            "distinct_values",
            "ratio",
            ((F.col("ratio") > 0.5) & (F.col("distinct_values") > 20)).alias("high_cardinality"),
            (F.col("ratio") > 0.95).alias("identifier"),
        )
    )


@query
def variation(spark, d):
    return rounded(utility.measure_variation(wl.line_audit(spark, d)), 4)


@query
def redundant_pairs(spark, d):
    return rounded(utility.measure_pairs(wl.line_audit(spark, d)))


@query
def low_information(spark, d):
    return rounded(utility.measure_information(wl.line_audit(spark, d, three_classes=True), bins=10))


@query
def missing_values(spark, d):
    lines = utility.measure_missing(wl.line_audit(spark, d))
    docs = utility.measure_missing(wl.document_audit(spark, d))
    return rounded(
        lines.select(F.lit("lineitem").alias("source"), "*").unionByName(
            docs.select(F.lit("documents").alias("source"), "*")
        )
    )


@query
def utility_findings(spark, d):
    found = utility.check_utility(wl.line_audit(spark, d))
    return found.where("type <> 'low_information_feature'").select("type", "severity", "feature")


@query
def recommended_removals(spark, d):
    found = utility.check_utility(wl.line_audit(spark, d))
    return utility.recommended_removals(found)


# --- profiles ---

PROFILED = {
    "region": "r_name",
    "nation": "n_regionkey",
    "customer": "c_mktsegment",
    "supplier": "s_nationkey",
    "part": "p_type",
    "orders": "o_orderstatus",
    "lineitem": "l_returnflag",
    "events": "event_type",
    "documents": "lang",
    "embeddings": "label",
    "pages": "url",
    "benchmark": "item_id",
    "labels": "toxic",
    "conversations": "role",
}


@query
def profiles(spark, d):
    rows = union_all(
        [prof.profile(LabelledTable(wl.read(spark, d, n), y, (), n)) for n, y in PROFILED.items()]
    )
    return rounded(
        rows.withColumn("dataset_type", prof.dataset_type()).withColumn("profile_key", prof.profile_key())
    )


@query
def fleet_types(spark, d):
    found = wl.event_profiles(spark, d)
    return rounded(
        found.select(
            "owner",
            "audit",
            "complexity_score",
            prof.dataset_type().alias("dataset_type"),
            prof.profile_key().alias("profile_key"),
        )
    )


# --- roll-ups of findings ---


def _found(spark, d) -> tuple[DataFrame, DataFrame]:
    return wl.event_executed(spark, d), wl.event_findings(spark, d)


@query
def severity_rollup(spark, d):
    return roll.severity_rollup(wl.event_findings(spark, d))


@query
def critical_leaks(spark, d):
    found = roll.select_findings(wl.event_findings(spark, d), "leakage_detector", "critical")
    return rounded(found.select("dataset", "tool", "type", "severity", "feature", "metric"))


@query
def single_check_status(spark, d):
    """The status of each tool as a check by itself reports it, which tells info-only results apart."""
    return _longs(roll.tool_status(*_found(spark, d), info_status=True), "position")


@query
def split_sources(spark, d):
    """Orders written as a training and a test CSV file, and loaded again as one labelled table."""
    orders = wl.read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    folder = f"{shared_folder(spark).rstrip('/')}/split-{uuid.uuid4().hex}"
    sides = {"train": orders.where("o_orderkey % 10 < 7"), "test": orders.where("o_orderkey % 10 >= 7")}
    for name, side in sides.items():
        side.write.csv(f"{folder}/{name}.csv", header=True)
    t, train, test = load_split(spark, f"{folder}/train.csv", f"{folder}/test.csv", "o_orderstatus", ("o_orderkey",), schema=orders.schema)
    parts = {"both": t.df, "train": train, "test": test}
    total = F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("price")
    counted = [df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), total).withColumn("side", F.lit(n)) for n, df in parts.items()]
    return rounded(union_all(counted), 2)


@query
def findings_export(spark, d):
    """The findings of the fleet written as CSV and read back; commas, quotes and missing features survive."""
    path = f"{shared_folder(spark).rstrip('/')}/findings-{uuid.uuid4().hex}.csv"
    sinks.write_findings_csv(_found(spark, d)[1], path)
    back = read_table(spark, path, "type string, severity string, feature string, message string, evidence string, tool string")
    return back.groupBy("tool", "type", "severity", "feature").agg(F.count(F.lit(1)).alias("n"))


@query
def tool_status(spark, d):
    return _longs(roll.tool_status(*_found(spark, d)), "position")


@query
def critic_confidence(spark, d):
    found = roll.critique(*_found(spark, d))
    return rounded(
        found.select(
            "dataset",
            "tool",
            "confidence",
            "needs_recheck",
            F.size("concerns").cast("bigint").alias("concerns"),
            _joined("recommendations"),
        )
    )


@query
def critic_assessment(spark, d):
    found = roll.assessment(roll.critique(*_found(spark, d)))
    return rounded(
        found.select(
            "dataset",
            "overall_confidence",
            "reliability",
            F.size("major_concerns").cast("bigint").alias("concerns"),
            F.size("actionable_recommendations").cast("bigint").alias("recommendations"),
            _joined("tools_needing_recheck"),
            "critique_count",
        )
    )


@query
def readiness(spark, d):
    return rounded(_longs(roll.readiness(*_found(spark, d)), "readiness_score"))


@query
def recommendations(spark, d):
    return roll.recommendations(*_found(spark, d))


@query
def adaptive_status(spark, d):
    found = roll.adaptive_status(*_found(spark, d))
    return found.select("dataset", "current_status", _joined("priority_areas"), _joined("recommendations"))


@query
def severity_distribution(spark, d):
    return roll.severity_distribution(wl.event_findings(spark, d))


@query
def audit_reports(spark, d):
    found = roll.report(*_found(spark, d))
    return found.select(
        "dataset",
        "verdict",
        F.col("readiness_score").cast("bigint").alias("readiness_score"),
        F.col("summary.total_findings").alias("total_findings"),
        F.size("critical_blockers").cast("bigint").alias("blockers"),
        F.size("warnings").cast("bigint").alias("warnings"),
        F.size("all_findings").cast("bigint").alias("findings"),
        F.size("recommendations").cast("bigint").alias("recommendations"),
        F.size("execution_timeline").cast("bigint").alias("timeline"),
    )


# --- history ---

BY = ["owner"]


def _history(spark, d) -> tuple[DataFrame, DataFrame]:
    return wl.event_steps(spark, d), wl.event_profiles(spark, d)


def _performance(spark, d) -> DataFrame:
    return fleet.performance(*_history(spark, d), BY)


@query
def eligibility(spark, d):
    found = fleet.eligible_tools(wl.event_profiles(spark, d).withColumn("num_features", F.col("num_classes") - 2))
    return found.select("owner", "audit", "tool", "eligible")


@query
def relevance_scores(spark, d):
    return rounded(
        fleet.score_tools(wl.event_profiles(spark, d)).select("owner", "audit", "tool", "score")
    )


@query
def check_plan(spark, d):
    found = fleet.check_plan(fleet.score_tools(wl.event_profiles(spark, d)), by=BY)
    return rounded(_longs(found.select("owner", "audit", "tool", "score", "plan_position"), "plan_position"))


@query
def similar_effectiveness(spark, d):
    steps, profiles_ = _history(spark, d)
    latest, past = wl.latest_and_past(profiles_)
    return rounded(fleet.similar_effectiveness(latest, past, steps, BY))


@query
def learned_plan(spark, d):
    steps, profiles_ = _history(spark, d)
    latest, past = wl.latest_and_past(profiles_)
    known = fleet.similar_effectiveness(latest, past, steps, BY)
    perf = fleet.performance(steps, past, BY)
    boosts = fleet.learned_boosts(latest, fleet.mine_patterns(perf, BY), BY)
    tuned = fleet.tune_threshold(perf, BY).select("owner", "skip_threshold")
    scored = fleet.score_tools(latest, known, BY).join(tuned, "owner", "left")
    limit = F.coalesce("skip_threshold", F.lit(fleet.DEFAULT_SKIP_THRESHOLD))
    found = fleet.check_plan(scored, limit, boosts, BY)
    return rounded(_longs(found.select("owner", "audit", "tool", "score", "plan_position"), "plan_position"))


@query
def audit_outcomes(spark, d):
    return rounded(fleet.audit_outcomes(wl.event_steps(spark, d), BY))


@query
def tool_usage(spark, d):
    return fleet.tool_usage(wl.event_steps(spark, d))


@query
def profile_variety(spark, d):
    return fleet.profile_variety(wl.event_profiles(spark, d), BY)


@query
def history_round_trip(spark, d):
    """The history written to a folder, twice under one run id and once more under a later one, and read back."""
    steps, profiles_ = _history(spark, d)
    nested = sinks.history_rows(profiles_, steps, BY)
    path = f"{shared_folder(spark).rstrip('/')}/history-{uuid.uuid4().hex}"
    for run in ("1", "1", "2"):
        sinks.append_history(nested, path, run)
    back = sinks.load_history(spark, path, [*BY, "audit"])
    return rounded(_longs(sinks.history_steps(back, BY), "position"))


@query
def strategy_effectiveness(spark, d):
    return rounded(fleet.strategy_effectiveness(*_history(spark, d), BY))


@query
def mean_effectiveness(spark, d):
    return rounded(fleet.mean_effectiveness(fleet.strategy_effectiveness(*_history(spark, d), BY), BY))


@query
def position_effectiveness(spark, d):
    return rounded(fleet.position_effectiveness(_performance(spark, d), BY))


@query
def tool_ranking(spark, d):
    found = fleet.tool_ranking(fleet.position_effectiveness(_performance(spark, d), BY), BY)
    return _longs(found.select("owner", "dataset_type", "tool", "place"), "place")


@query
def audit_performance(spark, d):
    found = _performance(spark, d)
    return rounded(
        found.select(
            "owner",
            "audit",
            F.concat_ws(">", "tool_sequence").alias("tool_sequence"),
            "time_to_first_critical",
            "total_time",
            "critical_found",
            "empty_share",
            "efficiency",
            "early_stop",
            "dataset_type",
        )
    )


@query
def best_sequences(spark, d):
    return rounded(fleet.best_sequences(_performance(spark, d)).drop("tool_sequence"))


@query
def threshold_tuning(spark, d):
    return rounded(_longs(fleet.tune_threshold(_performance(spark, d), BY), "steps"))


@query
def recent_empty_share(spark, d):
    return rounded(_longs(fleet.recent_empty_share(_performance(spark, d), BY), "seen"))


@query
def mined_patterns(spark, d):
    return rounded(fleet.mine_patterns(_performance(spark, d), BY))


@query
def learned_boosts(spark, d):
    latest, _ = wl.latest_and_past(wl.event_profiles(spark, d))
    patterns = fleet.mine_patterns(_performance(spark, d), BY)
    return rounded(fleet.learned_boosts(latest, patterns, BY))


@query
def improvement(spark, d):
    return rounded(fleet.improvement(_performance(spark, d), BY))


@query
def history_summary(spark, d):
    return rounded(fleet.history_summary(_performance(spark, d), BY))


def _triggers(spark, d) -> DataFrame:
    return fleet.contingency_triggers(wl.event_findings(spark, d), wl.event_runs(spark, d))


@query
def contingency_triggers(spark, d):
    found = _triggers(spark, d).select("dataset", "trigger", "priority", "place", "change_goal")
    return _longs(found, "priority", "place")


@query
def remediations(spark, d):
    found = fleet.remediations(_triggers(spark, d))
    return _longs(found.select("dataset", "trigger", "remediation_type", "priority"), "priority")


@query
def adjusted_thresholds(spark, d):
    return fleet.adjusted_thresholds(_triggers(spark, d))


@query
def contingency_summary(spark, d):
    return fleet.contingency_summary(_triggers(spark, d))


# --- generators, keyed by the orders table ---


def _orders(spark, d) -> DataFrame:
    return wl.read(spark, d, "orders")


@query
def generate_leakage(spark, d):
    return generators.leakage_table(_orders(spark, d), id_column="o_orderkey")


@query
def generate_imbalance(spark, d):
    return rounded(generators.imbalance_table(_orders(spark, d), id_column="o_orderkey"))


@query
def generate_clean(spark, d):
    return rounded(generators.clean_table(_orders(spark, d), id_column="o_orderkey"))


@query
def generate_wide(spark, d):
    return rounded(generators.wide_table(_orders(spark, d), features=4, id_column="o_orderkey"))


@query
def generate_multi_issue(spark, d):
    return rounded(generators.multi_issue_table(_orders(spark, d), id_column="o_orderkey"))


@query
def generate_drift(spark, d):
    first = generators.imbalance_table(_orders(spark, d), seed=47, share=0.10, id_column="o_orderkey")
    second = generators.imbalance_table(_orders(spark, d), seed=48, share=0.12, id_column="o_orderkey")
    wanted = ["feature_1", "feature_2", "feature_3", "target"]
    return rounded(
        first.select(F.lit("v1").alias("version"), *wanted).unionByName(
            second.select(F.lit("v2").alias("version"), *wanted)
        )
    )


# --- whole audits ---


@query
def audit_findings(spark, d):
    """All checks on the line items; findings that are rules, not models."""
    found = audit(wl.line_audit(spark, d).df, "target", name="lineitem", forests=False, cache=False).findings
    return found.select("tool", "type", "severity", "feature")


@query
def audit_timeline(spark, d):
    """The recorded steps of an audit and of its report: every step has its time, which differs from run to run."""
    table = wl.line_audit(spark, d)
    result = audit(table.df, "target", name="lineitem", tools=("leakage_detector", "contamination_detector"), forests=False)
    listed = result.report.select(
        "audit_metadata", F.inline("execution_timeline").alias("position", "tool", "status", "findings_count", "timestamp", "execution_time")
    )
    inside = (F.col("execution_time") > 0) & (F.col("execution_time") <= F.col("audit_metadata.execution_time"))
    return listed.select(
        F.col("position").cast("bigint").alias("position"),
        "tool",
        "status",
        "findings_count",
        (inside & (F.col("timestamp") >= F.col("audit_metadata.timestamp"))).alias("timed"),
        F.element_at("audit_metadata.dataset_shape", 1).alias("num_rows"),
        F.element_at("audit_metadata.dataset_shape", 2).alias("num_columns"),
        F.col("audit_metadata.target_column").alias("target_column"),
    )


@query
def audit_split_findings(spark, d):
    train, test = wl.document_split(spark, d)
    found = contamination.check_contamination(train, test, near_rows=None, dataset="documents")
    return rounded(found.select("type", "severity", "metric"))


@query
def audit_readiness(spark, d):
    result = audit(wl.order_audit(spark, d).df, "target", key=("o_orderkey",), name="orders", cache=False)
    return rounded(result.readiness)
