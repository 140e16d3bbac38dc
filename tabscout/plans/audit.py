"""A whole audit: every check that applies, the second look, and the roll-ups."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import cached_property
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.operators import report as roll
from tabscout.operators.bias import check_bias
from tabscout.operators.contamination import check_contamination
from tabscout.operators.fleet import eligible_tools
from tabscout.operators.leakage import check_leakage, flag_encoded_target
from tabscout.operators.profile import profile
from tabscout.operators.sampling import adaptive_sample, sample_columns
from tabscout.operators.spurious import check_spurious, flag_unstable, measure_relative_spread
from tabscout.operators.utility import check_utility, recommended_removals
from tabscout.schema import TOOLS, empty, FINDINGS, union_all
from tabscout.table import LabelledTable


@dataclass
class AuditResult:
    """Findings of one audit and the tables derived from them."""

    table: LabelledTable
    findings: DataFrame
    executed: DataFrame
    #: ``dataset, tool, timestamp, execution_time``: when each check began and the seconds it took, writing its
    #: findings included. Checks overlap. Null times where findings were not materialised, as nothing ran then.
    times: DataFrame
    started: datetime
    seconds: float

    @cached_property
    def profile(self) -> DataFrame:
        return profile(self.table)

    @property
    def status(self) -> DataFrame:
        return roll.tool_status(self.executed, self.findings)

    @property
    def steps(self) -> DataFrame:
        """``status`` with the time and the seconds of each check: the timeline of the audit."""
        return self.status.join(self.times, ["dataset", "tool"], "left")

    @property
    def metadata(self) -> Column:
        """What was audited, when, and how long it took."""
        return F.struct(
            F.array(F.lit(self.table.rows).cast("bigint"), F.lit(len(self.table.df.columns)).cast("bigint")).alias("dataset_shape"),
            F.lit(self.table.target).alias("target_column"),
            F.lit(self.started).alias("timestamp"),
            F.lit(self.seconds).alias("execution_time"),
        )

    @property
    def critiques(self) -> DataFrame:
        return roll.critique(self.executed, self.findings)

    @property
    def readiness(self) -> DataFrame:
        return roll.readiness(self.executed, self.findings)

    @property
    def recommendations(self) -> DataFrame:
        return roll.recommendations(self.executed, self.findings)

    @property
    def removals(self) -> DataFrame:
        return recommended_removals(self.findings)

    @property
    def report(self) -> DataFrame:
        """One nested row: verdict, findings, advice, the timeline with times, and what was audited."""
        return roll.report(self.executed, self.findings, self.steps).withColumn("audit_metadata", self.metadata)


def audit(
    df: DataFrame,
    target: str,
    test: DataFrame | None = None,
    key: tuple[str, ...] = (),
    name: str = "table",
    tools: tuple[str, ...] = TOOLS,
    forests: bool = True,
    single: str = "binned",
    near_rows: int | None = None,
    encoded_target: bool = False,
    mi_units: str = "consistent",
    sample: int | None = None,
    max_columns: int | None = None,
    materialize: bool = True,
    cache: bool = False,
) -> AuditResult:
    """Audits a labelled table, or a train/test pair.

    Checks read the whole table. ``sample`` and ``max_columns`` opt in to the
    row and column samplers for the bias and shortcut checks; the sample is written
    once, and class counts always come from the whole table. Without it the forest checks
    train on every labelled row too. Rules that need exact row order
    use ``key``. Each check writes its findings, a few rows per column, unless
    ``materialize`` is False, as every roll-up reads them several times; so its time is known. ``cache``
    keeps the table in memory until the findings are written.
    """
    started = datetime.now(UTC)
    unknown = set(tools) - set(TOOLS)
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(sorted(unknown))}")
    whole = df if test is None else df.unionByName(test, allowMissingColumns=True)
    if cache:
        whole = whole.persist()
    if cache and test is None:
        df = whole
    t = LabelledTable(whole, target, tuple(key), name)
    shape = [f for f in TOOLS if f in tools]
    eligible = {
        r["tool"]: r["eligible"]
        for r in eligible_tools(profile(t)).select("tool", "eligible").collect()
    }
    run = [tool for tool in shape if eligible[tool]]

    narrowed = t
    if max_columns is not None and len(t.features) > max_columns:
        columns = sample_columns(t, max_columns)
        narrowed = LabelledTable(columns, target, t.key if all(k in columns.columns for k in t.key) else (), name)
    if sample is not None:
        narrowed = LabelledTable(stored(adaptive_sample(narrowed, sample)), target, narrowed.key, name)

    def leakage() -> list[DataFrame]:
        return [check_leakage(t, mi_units), *([flag_encoded_target(t)] if encoded_target else [])]

    def shortcuts() -> list[DataFrame]:
        found = check_spurious(narrowed, single, forests)
        # Dominant features get the second look.
        return [found, flag_unstable(found, measure_relative_spread(t), dataset=name)]

    checks = {
        "leakage_detector": leakage,
        "contamination_detector": lambda: [check_contamination(df, test, key, near_rows, dataset=name)],
        "bias_detector": lambda: [check_bias(narrowed, t)],
        "spurious_detector": shortcuts,
        "feature_utility": lambda: [check_utility(t)],
    }
    if run:
        # Facts that several checks share; measured once, before they start.
        for shared in {id(t): t, id(narrowed): narrowed}.values():
            _ = (shared.numeric_facts, shared.class_summary)
        def timed(tool: str) -> tuple[DataFrame, tuple]:
            begun, clock = datetime.now(UTC), time.monotonic()
            found = union_all(checks[tool]())
            if materialize:
                return stored(found), (name, tool, begun, time.monotonic() - clock)
            return found, (name, tool, None, None)

        # The checks wait for small results most of the time, so they overlap.
        with ThreadPool(len(run)) as pool:
            parts, times = zip(*pool.map(timed, run), strict=True)
    else:
        parts, times = [], []
    spark = df.sparkSession
    findings = union_all(parts) if parts else empty(spark, FINDINGS)
    if materialize:
        for used in (t, narrowed):
            used.release()
        if cache:
            whole.unpersist()
    recorded = spark.createDataFrame(list(times), "dataset string, tool string, timestamp timestamp, execution_time double")
    executed = roll.executed_tools(spark, name, tuple(run))
    return AuditResult(t, findings, executed, recorded, started, (datetime.now(UTC) - started).total_seconds())
