"""Writing findings, reports and audit history. All writes are distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.schema import column


def write_report_json(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per dataset; evidence is nested JSON text."""
    report.write.mode(mode).json(path)


def write_findings_csv(findings: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """``type, severity, feature, message, evidence, tool``; nothing for no findings."""
    if findings.isEmpty():
        return False
    (
        findings.select("type", "severity", "feature", "message", "evidence", "tool")
        .write.mode(mode)
        .csv(path, header=True, escape='"')
    )
    return True


def audit_record(
    profile: DataFrame, status: DataFrame, findings: DataFrame, target: str
) -> DataFrame:
    """Metadata, steps, findings, order and summary of each audit, nested.

    One row per dataset; at most five steps and a few findings per column.
    """
    step_columns = [
        c
        for c in ("position", "tool", "timestamp", "status", "findings_count", "execution_time")
        if c in status.columns
    ]
    steps = status.groupBy("dataset").agg(
        F.sort_array(F.collect_list(F.struct(*step_columns))).alias("audit_steps"),
        F.count(F.lit(1)).alias("tools_executed"),
        F.sum("findings_count").alias("total_findings"),
        F.sum("critical_count").alias("critical_count"),
        F.sum("warning_count").alias("warning_count"),
        F.sum("info_count").alias("info_count"),
    )
    listed = findings.groupBy("dataset").agg(
        F.sort_array(
            F.collect_list(F.struct("tool", "type", "severity", "feature", "message", "evidence"))
        ).alias("findings")
    )
    return (
        profile.join(steps, "dataset")
        .join(listed, "dataset", "left")
        .select(
            "dataset",
            F.struct(
                F.array(F.col("num_rows"), F.col("num_features") + 1).alias("dataset_shape"),
                F.lit(target).alias("target_column"),
            ).alias("metadata"),
            "audit_steps",
            "findings",
            F.transform("audit_steps", lambda s: s["tool"]).alias("tool_execution_order"),
            F.struct(
                "tools_executed",
                "total_findings",
                "critical_count",
                "warning_count",
                "info_count",
                (F.col("critical_count") > 0).alias("has_critical_blockers"),
            ).alias("summary"),
        )
    )


def history_rows(profiles: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """Nested history: profile columns, tool order and per-tool maps, one row per audit."""
    owner = [*by, "audit"]
    ordered = F.sort_array(F.collect_list(F.struct("position", "tool", "seconds", "findings", "criticals")))
    nested = steps.groupBy(*owner).agg(ordered.alias("s")).select(
        *owner,
        F.transform("s", lambda x: x["tool"]).alias("execution_order"),
        F.map_from_entries(F.transform("s", lambda x: F.struct(x["tool"], x["criticals"]))).alias("findings_by_tool"),
        F.map_from_entries(F.transform("s", lambda x: F.struct(x["tool"], x["findings"]))).alias("all_findings_by_tool"),
        F.map_from_entries(F.transform("s", lambda x: F.struct(x["tool"], x["seconds"]))).alias("execution_times"),
        F.aggregate("s", F.lit(0.0), lambda a, x: a + x["seconds"]).alias("total_time"),
        F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["criticals"]).alias("critical_found"),
    )
    return profiles.join(nested, owner)


def history_steps(history: DataFrame, by: list[str]) -> DataFrame:
    """The flat step table back from nested history rows."""
    return history.select(
        *by,
        "audit",
        F.posexplode("execution_order").alias("position", "tool"),
        "findings_by_tool",
        "all_findings_by_tool",
        "execution_times",
    ).select(
        *by,
        "audit",
        "position",
        "tool",
        F.element_at("execution_times", F.col("tool")).alias("seconds"),
        F.element_at("all_findings_by_tool", F.col("tool")).alias("findings"),
        F.element_at("findings_by_tool", F.col("tool")).alias("criticals"),
    )


def append_history(history: DataFrame, path: str, run: str) -> None:
    """Adds the audits of one run to the Parquet history.

    A run owns the folder ``run=<run>`` and replaces it, so a job that is run again
    under its id adds nothing, and neither does a task that Spark tries twice. Runs
    with other ids may write at the same time. Later runs need greater ids, as text.
    """
    if not run or "/" in run or "=" in run:
        raise ValueError("a run id is a name of its own, without / and =")
    history.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run=_{run}")


def load_history(spark: SparkSession, path: str, keys: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The audits of all runs, of each (by ``keys``, null is a key) what the latest run says."""
    reader = spark.read.option("mergeSchema", "true") if schema is None else spark.read.schema(T.StructType([*schema.fields, T.StructField("run", T.StringType())]))
    rows = reader.parquet(path)
    names = [c for c in rows.columns if c != "run"]
    whole = F.struct(*[column(c) for c in names])
    return rows.groupBy(*[column(k) for k in keys]).agg(F.max_by(whole, "run").alias("_latest")).select("_latest.*")
