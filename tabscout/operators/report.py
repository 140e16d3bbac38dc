"""Roll-ups of findings: status, confidence, score, verdict, report.

Every function takes tables that may hold one dataset or a whole fleet of them:
``findings`` as in ``schema.FINDINGS`` and ``executed`` with ``dataset, tool,
position`` (one row per tool that ran, with or without findings).
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.schema import TOOLS

HIGH, MEDIUM, LOW = 0.9, 0.7, 0.5

# Texts of the report.
CONCERNS = {
    "perfect": "Found %d features with near-perfect correlation. Verify these are not legitimate derived features.",
    "names_only": (
        "Only found suspicious feature names without correlation evidence. "
        "Names alone are not definitive proof of leakage."
    ),
    "identical": "DEFINITIVE: %d features are identical to target. This is certain leakage.",
    "overlap_high": "High contamination rate (%.1f%%) - definitely problematic.",
    "overlap_mid": "Moderate contamination (%.1f%%) - investigate further.",
    "overlap_low": "Low contamination (%.1f%%) - might be acceptable depending on use case.",
    "near_only": "Found only near-duplicates, not exact matches. Similarity threshold might need tuning.",
    "severe": "Severe class imbalance confirmed. This will impact model training.",
    "class_tiny": "Extremely small class size (%d samples) - likely insufficient for training.",
    "class_small": "Small class size (%d samples) - monitor performance on minority class.",
    "dominance": "Single features achieving high accuracy alone. Could be legitimate or spurious.",
    "threshold": "Simple threshold rules work too well. Verify this is not dataset artifact.",
    "low_info": "Many features flagged as low information. Verify with domain experts before removal.",
}
ADVICE = {
    "perfect": ("Manually inspect features with perfect correlation to confirm they are truly leaked.",),
    "overlap_low": ("For critical applications, even 1% contamination should be addressed.",),
    "near_only": ("Manually inspect near-duplicate samples to verify they are truly problematic.",),
    "severe": ("Consider: SMOTE, class weights, or stratified sampling.",),
    "missing": ("Missing value patterns correlate with target. Imputation strategy is critical.",),
    "dominance": (
        "Verify domain knowledge: Is this feature logically causal?",
        "Test model on out-of-distribution data to check generalization.",
        "Consider ablation studies to understand feature importance.",
    ),
    "low_info": ("Low information features might still be useful in ensembles or interactions.",),
}
RECOMMENDATIONS = {
    "leakage": "PRIORITY: Remove or investigate features flagged as data leakage before training any models.",
    "imbalance": "Address class imbalance using resampling, class weights, or stratified sampling.",
    "contamination": "Ensure proper train-test separation. Remove duplicate samples from test set.",
}
STATUS_ADVICE = {
    "data_leakage": "CRITICAL: Data leakage detected. Do not train models until resolved.",
    "class_imbalance": "Severe class imbalance detected. Consider resampling or adjusted metrics.",
}

_SEVERITIES = ("critical", "warning", "info")


def executed_tools(spark: SparkSession, dataset: str, tools: tuple[str, ...] = TOOLS) -> DataFrame:
    rows = [(dataset, tool, i) for i, tool in enumerate(tools)]
    return spark.createDataFrame(rows, "dataset string, tool string, position int")


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in _SEVERITIES]


def select_findings(
    findings: DataFrame, tool: str | None = None, severity: str | None = None
) -> DataFrame:
    """Findings of one tool and/or severity."""
    if tool is not None:
        findings = findings.where(F.col("tool") == tool)
    if severity is not None:
        findings = findings.where(F.col("severity") == severity)
    return findings


def severity_rollup(findings: DataFrame) -> DataFrame:
    """Counts per dataset and tool, with a NULL tool for the dataset total and a
    NULL dataset for the grand total."""
    return findings.rollup("dataset", "tool").agg(
        F.count("severity").alias("total_findings"), *_severity_counts()
    )


def severity_distribution(findings: DataFrame) -> DataFrame:
    """``severity, n``: data of a findings chart."""
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def tool_status(executed: DataFrame, findings: DataFrame, info_status: bool = False) -> DataFrame:
    """``dataset, tool, position, findings_count, *_count, status`` of every tool run.

    ``fail`` with a critical finding, ``warning`` with any other, else ``pass``.
    ``info_status`` tells info-only results apart, as single checks do.
    """
    counts = findings.groupBy("dataset", "tool").agg(
        F.count(F.lit(1)).alias("findings_count"), *_severity_counts()
    )
    named = ["findings_count", *[f"{s}_count" for s in _SEVERITIES]]
    joined = executed.join(counts, ["dataset", "tool"], "left").na.fill(0, named)
    status = F.when(F.col("findings_count") == 0, "pass").when(F.col("critical_count") > 0, "fail")
    if info_status:
        status = status.when(F.col("warning_count") == 0, "info")
    return joined.withColumn("status", status.otherwise("warning")).select(
        "dataset", "tool", "position", *named, "status"
    )


def audit_summary(executed: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per dataset: tools run and findings by severity."""
    return (
        tool_status(executed, findings)
        .groupBy("dataset")
        .agg(
            F.count(F.lit(1)).alias("tools_executed"),
            F.sum("findings_count").alias("total_findings"),
            *[F.sum(f"{s}_count").alias(f"{s}_count") for s in _SEVERITIES],
        )
        .withColumn("has_critical_blockers", F.col("critical_count") > 0)
    )


def critique(executed: DataFrame, findings: DataFrame) -> DataFrame:
    """``dataset, tool, position, confidence, needs_recheck, concerns, recommendations``.

    One conditional aggregate per dataset and tool; later rules override earlier
    ones, so each CASE lists them last first.
    """
    kind = F.col("type")

    def has(text: str) -> Column:
        return F.count_if(F.contains(kind, F.lit(text)))

    facts = findings.groupBy("dataset", "tool").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((kind == "perfect_correlation") & (F.col("metric") > 0.99)).alias("perfect"),
        F.count_if(kind == "suspicious_name").alias("names"),
        F.count_if(kind == "identical_to_target").alias("identical"),
        F.max(F.when(kind == "train_test_contamination", F.col("metric"))).alias("overlap"),
        F.count_if(kind == "near_duplicates").alias("near"),
        F.count_if(kind == "severe_imbalance").alias("severe"),
        F.min(F.when(kind == "small_class_size", F.col("metric"))).alias("smallest"),
        has("missing").alias("missing"),
        has("dominance").alias("dominance"),
        has("threshold").alias("threshold"),
        has("constant").alias("constant"),
        has("low_information").alias("low_info"),
    )
    c = F.col
    tool = c("tool")
    leak, contam, bias, spur, util = (tool == name for name in TOOLS)
    names_only = leak & (c("names") > 0) & (c("names") == c("n"))
    overlap = contam & c("overlap").isNotNull()
    near_only = contam & (c("near") > 0) & c("overlap").isNull()
    small = bias & c("smallest").isNotNull()
    low_only = util & (c("low_info") > 0) & (c("low_info") == c("n"))
    dominant = spur & (c("dominance") > 0)
    confidence = (
        F.when(leak & (c("identical") > 0), 1.0)
        .when(names_only, MEDIUM)
        .when(near_only, MEDIUM)
        .when(overlap & (c("overlap") > 10), HIGH)
        .when(overlap & (c("overlap") > 1), MEDIUM)
        .when(overlap, LOW)
        .when(small & (c("smallest") < 10), HIGH)
        .when(small, MEDIUM)
        .when(bias & (c("severe") > 0), HIGH)
        .when(dominant, MEDIUM)
        .when(low_only, MEDIUM)
        .when(util & (c("constant") > 0), HIGH)
        .otherwise(1.0)
    )
    rules: list[tuple[str, Column, tuple[Column, ...]]] = [
        ("perfect", leak & (c("perfect") > 0), (c("perfect"),)),
        ("names_only", names_only, ()),
        ("identical", leak & (c("identical") > 0), (c("identical"),)),
        ("overlap_high", overlap & (c("overlap") > 10), (c("overlap"),)),
        ("overlap_mid", overlap & (c("overlap") > 1) & (c("overlap") <= 10), (c("overlap"),)),
        ("overlap_low", overlap & (c("overlap") <= 1), (c("overlap"),)),
        ("near_only", near_only, ()),
        ("severe", bias & (c("severe") > 0), ()),
        ("class_tiny", small & (c("smallest") < 10), (c("smallest").cast("bigint"),)),
        ("class_small", small & (c("smallest") >= 10), (c("smallest").cast("bigint"),)),
        ("missing", bias & (c("missing") > 0), ()),
        ("dominance", dominant, ()),
        ("threshold", spur & (c("threshold") > 0), ()),
        ("low_info", low_only, ()),
    ]
    concerns = F.array_compact(
        F.array(
            *[
                F.when(rule, F.format_string(CONCERNS[name], *args) if args else F.lit(CONCERNS[name]))
                for name, rule, args in rules
                if name in CONCERNS
            ]
        )
    )
    advice = F.array_compact(
        F.array(*[F.when(rule, F.lit(text)) for name, rule, _ in rules for text in ADVICE.get(name, ())])
    )
    return executed.join(facts, ["dataset", "tool"], "left").select(
        "dataset",
        "tool",
        "position",
        F.when(c("n").isNull(), 1.0).otherwise(confidence).alias("confidence"),
        F.coalesce(dominant, F.lit(False)).alias("needs_recheck"),
        concerns.alias("concerns"),
        advice.alias("recommendations"),
    )


def assessment(critiques: DataFrame) -> DataFrame:
    """One row per dataset over its at most five critiques."""
    ordered = F.sort_array(
        F.collect_list(F.struct("position", "tool", "concerns", "recommendations", "needs_recheck"))
    )
    mean = F.col("overall_confidence")
    return (
        critiques.groupBy("dataset")
        .agg(
            F.avg("confidence").alias("overall_confidence"),
            F.count(F.lit(1)).alias("critique_count"),
            ordered.alias("all"),
        )
        .select(
            "dataset",
            "overall_confidence",
            # The mean of at most five tenths: guard the limits against rounding.
            F.when(F.round(mean, 9) >= HIGH, "high")
            .when(F.round(mean, 9) >= MEDIUM, "medium")
            .otherwise("low")
            .alias("reliability"),
            F.flatten(F.transform("all", lambda x: x["concerns"])).alias("major_concerns"),
            F.array_distinct(F.flatten(F.transform("all", lambda x: x["recommendations"]))).alias(
                "actionable_recommendations"
            ),
            F.transform(F.filter("all", lambda x: x["needs_recheck"]), lambda x: x["tool"]).alias(
                "tools_needing_recheck"
            ),
            "critique_count",
        )
    )


def readiness_score(critical: Column, warnings: Column, confidence: Column) -> Column:
    """Score between 15 and 100 from finding counts and mean confidence."""
    for_critical = (
        F.when(critical <= 0, 0)
        .when(critical == 1, 12)
        .when(critical == 2, 22)
        .otherwise(22 + (critical - 2) * 7)
    )
    for_warnings = (
        F.when(warnings <= 3, warnings * 3)
        .when(warnings <= 6, 9 + (warnings - 3) * 2)
        .otherwise(15 + (warnings - 6))
    )
    unsure = F.when(F.round(confidence, 9) < MEDIUM, 5).otherwise(0)
    raw = 100 - for_critical - for_warnings - unsure
    return F.greatest(F.lit(15), F.least(F.lit(100), raw)).cast("int")


def verdict(critical: Column, warnings: Column, score: Column) -> Column:
    return (
        F.when((critical >= 3) | (score < 30), "NOT READY")
        .when((critical > 0) | (score < 60) | (warnings > 5), "NEEDS ATTENTION")
        .when((score >= 80) & (warnings <= 3), "READY")
        .otherwise("NEEDS ATTENTION")
    )


def readiness(executed: DataFrame, findings: DataFrame) -> DataFrame:
    """Summary, confidence, score and verdict: one row per dataset."""
    confidence = critique(executed, findings).groupBy("dataset").agg(
        F.avg("confidence").alias("overall_confidence")
    )
    return (
        audit_summary(executed, findings)
        .join(confidence, "dataset")
        .withColumn(
            "readiness_score",
            readiness_score(F.col("critical_count"), F.col("warning_count"), F.col("overall_confidence")),
        )
        .withColumn(
            "verdict",
            verdict(F.col("critical_count"), F.col("warning_count"), F.col("readiness_score")),
        )
    )


def recommendations(executed: DataFrame, findings: DataFrame) -> DataFrame:
    """``dataset, recommendation``: distinct advice triggered by the findings."""
    from_critic = critique(executed, findings).select(
        "dataset", F.explode("recommendations").alias("recommendation")
    )
    triggered = F.array_compact(
        F.array(
            F.when(F.col("tool") == "leakage_detector", F.lit(RECOMMENDATIONS["leakage"])),
            F.when(
                (F.col("tool") == "bias_detector") & (F.col("type") == "severe_imbalance"),
                F.lit(RECOMMENDATIONS["imbalance"]),
            ),
            F.when(F.col("tool") == "contamination_detector", F.lit(RECOMMENDATIONS["contamination"])),
        )
    )
    direct = findings.select("dataset", F.explode(triggered).alias("recommendation"))
    return from_critic.unionByName(direct).distinct()


def adaptive_status(executed: DataFrame, findings: DataFrame) -> DataFrame:
    """``dataset, current_status, priority_areas, recommendations``."""
    totals = findings.groupBy("dataset").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.count_if((F.col("tool") == "leakage_detector") & (F.col("severity") == "critical")).alias("leaks"),
        F.count_if((F.col("tool") == "bias_detector") & (F.col("type") == "severe_imbalance")).alias("severe"),
    )
    areas = F.array_compact(
        F.array(
            F.when(F.col("leaks") > 0, "data_leakage"), F.when(F.col("severe") > 0, "class_imbalance")
        )
    )
    texts = F.create_map(*[x for k, v in STATUS_ADVICE.items() for x in (F.lit(k), F.lit(v))])
    return (
        executed.select("dataset")
        .distinct()
        .join(totals, "dataset", "left")
        .na.fill(0)
        .select(
            "dataset",
            F.when(F.col("critical") > 0, "red")
            .when(F.col("warnings") > 3, "yellow")
            .otherwise("green")
            .alias("current_status"),
            areas.alias("priority_areas"),
        )
        .withColumn("recommendations", F.transform("priority_areas", lambda a: F.element_at(texts, a)))
    )


def _finding_list(findings: DataFrame, where: Column, name: str) -> Column:
    item = F.struct("tool", "type", "severity", "feature", "message", "metric", "evidence")
    return F.sort_array(F.collect_list(F.when(where, item))).alias(name)


def report(executed: DataFrame, findings: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """One row per dataset with the whole report, nested.

    A dataset has at most a few findings per column, so its lists are bounded by
    its schema.
    """
    severity = F.col("severity")
    lists = findings.groupBy("dataset").agg(
        _finding_list(findings, severity == "critical", "critical_blockers"),
        _finding_list(findings, severity == "warning", "warnings"),
        _finding_list(findings, F.lit(True), "all_findings"),
    )
    advice = (
        recommendations(executed, findings)
        .groupBy("dataset")
        .agg(F.sort_array(F.collect_set("recommendation")).alias("recommendations"))
    )
    timeline_source = tool_status(executed, findings) if steps is None else steps
    wanted = [c for c in ("position", "tool", "status", "findings_count", "timestamp", "execution_time") if c in timeline_source.columns]
    timeline = timeline_source.groupBy("dataset").agg(
        F.sort_array(F.collect_list(F.struct(*wanted))).alias("execution_timeline")
    )
    critic = assessment(critique(executed, findings))
    return (
        readiness(executed, findings)
        .drop("overall_confidence")
        .join(critic, "dataset")
        .join(lists, "dataset", "left")
        .join(advice, "dataset", "left")
        .join(timeline, "dataset", "left")
        .select(
            "dataset",
            "verdict",
            "readiness_score",
            F.struct(
                "tools_executed", "total_findings", "critical_count", "warning_count", "info_count"
            ).alias("summary"),
            *[_or_empty(c, lists) for c in ("critical_blockers", "warnings", "all_findings")],
            F.struct(
                "overall_confidence",
                "reliability",
                "major_concerns",
                "actionable_recommendations",
                "tools_needing_recheck",
                "critique_count",
            ).alias("critic_assessment"),
            _or_empty("recommendations", advice),
            "execution_timeline",
        )
    )


def _or_empty(name: str, frame: DataFrame) -> Column:
    kind = frame.schema[name].dataType
    return F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
