import hashlib
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscout import audit
from tabscout.operators import fleet, generators, profile, report, sampling
from tabscout.sources import sinks, tables
from tabscout.table import LabelledTable

@pytest.fixture(scope="module")
def golden(spark):
    """200 patients, ten of them sick: one column is the diagnosis, one never changes, two say nothing."""
    rng = np.random.default_rng(23)
    sick = rng.permutation([1] * 10 + [0] * 190)
    pdf = pd.DataFrame(
        {
            "height": rng.normal(170, 10, 200),
            "weight": rng.normal(70, 12, 200),
            "diagnosis": sick,
            "clinic": 4,
            "sick": sick,
        }
    )
    return audit(spark.createDataFrame(pdf), "sick", name="golden", forests=False)


def test_findings_of_planted_table(golden):
    rows = golden.findings.collect()
    found = {(r["tool"], r["type"], r["severity"], r["feature"]) for r in rows}
    planted = {
        ("leakage_detector", "perfect_correlation", "critical", "diagnosis"),
        ("leakage_detector", "identical_to_target", "critical", "diagnosis"),
        ("leakage_detector", "linear_transformation", "critical", "diagnosis"),
        ("bias_detector", "moderate_imbalance", "warning", None),
        ("bias_detector", "small_class_size", "warning", None),
        ("bias_detector", "feature_distribution_bias", "warning", "diagnosis"),
        ("spurious_detector", "single_feature_dominance", "critical", "diagnosis"),
        ("feature_utility", "constant_feature", "critical", "clinic"),
        ("feature_utility", "low_variance_numeric", "warning", "clinic"),
    }
    assert planted <= found
    # With 95 % in one class any column "predicts" it, so shortcut findings on others are expected.
    assert {k for k in found - planted if k[0] in ("leakage_detector", "bias_detector")} == set()
    assert {k[3] for k in found if k[1] == "low_information_feature"} <= {"height", "weight", "clinic"}
    by = {(r["type"], r["feature"]): r for r in rows}
    shift = json.loads(by["feature_distribution_bias", "diagnosis"]["evidence"])
    # Two groups that do not overlap: H = n - 1 after the tie correction.
    assert shift["p_value"] == pytest.approx(math.erfc(math.sqrt(199 / 2)), rel=1e-9)
    assert shift["effect_size"] == pytest.approx(1.0, abs=1e-9)
    assert by["moderate_imbalance", None]["metric"] == 19


def test_rollups_of_planted_table(golden):
    ready = golden.readiness.first()
    critical = golden.findings.where("severity = 'critical'").count()
    assert ready["critical_count"] == critical
    assert ready["verdict"] == "NOT READY"
    whole = golden.report.first()
    assert len(whole["critical_blockers"]) == critical
    assert [r["feature"] for r in golden.removals.collect()] == ["clinic"]


def test_sinks(golden, spark, tmp_path):
    assert sinks.write_findings_csv(golden.findings, str(tmp_path / "f"))
    back = spark.read.csv(str(tmp_path / "f"), header=True, escape='"')
    assert back.columns == ["type", "severity", "feature", "message", "evidence", "tool"]
    assert back.count() == golden.findings.count()
    assert not sinks.write_findings_csv(golden.findings.where("false"), str(tmp_path / "g"))
    sinks.write_report_json(golden.report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["verdict"] == "NOT READY"
    record = sinks.audit_record(golden.profile, golden.status, golden.findings, "target").first()
    assert record["summary"]["critical_count"] == golden.findings.where("severity = 'critical'").count()
    assert record["metadata"]["dataset_shape"] == [200, 5]


def test_small_tables_skip_checks(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (4, 1), (5, 0)], "feature1 int, target int")
    result = audit(df, "target")
    assert {r["tool"] for r in result.executed.collect()} == {
        "leakage_detector",
        "contamination_detector",
        "bias_detector",
    }
    assert {r["type"] for r in result.findings.collect()} == {"small_dataset", "small_class_size"}


def test_split_audit(spark, tmp_path):
    for name, low in (("train", 0), ("test", 40)):
        rows = spark.range(low, low + 60).select(
            F.col("id").cast("int").alias("a"), (F.col("id") * 7 % 11).cast("int").alias("b"), (F.col("id") % 2).cast("int").alias("y")
        )
        rows.write.csv(str(tmp_path / f"{name}.csv"), header=True)
    t, train, test = tables.load_split(spark, str(tmp_path / "train.csv"), str(tmp_path / "test.csv"), "y")
    assert t.df.count() == 120
    found = audit(train, "y", test, key=("a",), tools=("contamination_detector",)).findings
    types = {r["type"]: json.loads(r["evidence"]) for r in found.collect()}
    assert types["train_test_contamination"]["count"] == 20
    assert types["duplicate_indices"]["count"] == 20


def test_score_and_verdict_steps(spark):
    cases = {
        (0, 0, 1.0): (100, "READY"),
        (1, 0, 1.0): (88, "NEEDS ATTENTION"),
        (2, 3, 0.6): (64, "NEEDS ATTENTION"),
        (3, 0, 1.0): (71, "NOT READY"),
        (0, 6, 1.0): (85, "NEEDS ATTENTION"),
        (0, 4, 1.0): (89, "NEEDS ATTENTION"),
        (44, 26, 1.0): (15, "NOT READY"),
    }
    df = spark.createDataFrame(list(cases), "c int, w int, f double")
    df = df.withColumn("s", report.readiness_score(F.col("c"), F.col("w"), F.col("f")))
    df = df.withColumn("v", report.verdict(F.col("c"), F.col("w"), F.col("s")))
    assert {(r.c, r.w, r.f): (r.s, r.v) for r in df.collect()} == cases


def test_critique_overrides(spark):
    rows = [
        ("d", "leakage_detector", "perfect_correlation", "critical", 0.999),
        ("d", "leakage_detector", "identical_to_target", "critical", None),
        ("d", "bias_detector", "severe_imbalance", "critical", 200.0),
        ("d", "bias_detector", "small_class_size", "critical", 5.0),
        ("d", "spurious_detector", "single_feature_dominance", "critical", 0.92),
    ]
    found = spark.createDataFrame(rows, "dataset string, tool string, type string, severity string, metric double")
    executed = report.executed_tools(spark, "d", ("leakage_detector", "bias_detector", "spurious_detector"))
    got = {r["tool"]: r["confidence"] for r in report.critique(executed, found).collect()}
    assert got == {"leakage_detector": 1.0, "bias_detector": 0.9, "spurious_detector": 0.7}
    overall = report.assessment(report.critique(executed, found)).first()
    assert overall["overall_confidence"] == pytest.approx(0.8667, abs=1e-4)
    assert overall["reliability"] == "medium"


def test_generated_tables_keep_their_defects(spark):
    leak = LabelledTable(generators.leakage_table(spark), "default", ("customer_id",))
    assert profile.profile(leak).first()["complexity_score"] == pytest.approx(0.1)
    uneven = generators.imbalance_table(spark)
    assert uneven.where("target = 1").count() == 60
    many = generators.multi_issue_table(spark)
    assert many.count() == 1600
    t = LabelledTable(many, "churned")
    assert profile.profile(t).first()["complexity_score"] == 0.30000000000000004
    v1, v2 = generators.drift_pair(spark)
    assert (v1.where("label = 1").count(), v2.where("outcome = 1").count()) == (80, 96)
    wide = generators.wide_table(spark, 500)
    assert len(wide.columns) == 45


def test_samplers(spark):
    df = spark.range(3000).select(
        "id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c")
    )
    t = LabelledTable(df, "y", ("id",))
    drawn = sampling.stratified_sample(t, 500)
    assert {r["y"]: r["count"] for r in drawn.groupBy("y").count().collect()} == {0: 450, 1: 50}
    assert sampling.random_sample(t, 100).count() == 100
    assert 0 < sampling.quantile_sample(t, 600).count() <= 600
    assert 0 < sampling.cluster_sample(t, 300).count() <= 300
    assert sampling.adaptive_method(t) == "stratified"
    assert sampling.adaptive_method(LabelledTable(df, "id")) == "quantile"
    assert sampling.sample_columns(t, 2).columns[0] == "y"
    assert len(sampling.sample_columns(t, 2).columns) == 3


def test_running_effectiveness_is_the_recurrence(spark):
    values = [0.5, 2.0, 0.0, 7.5, 1.25]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, audit int, value double")
    for from_first in (True, False):
        e = values[0] if from_first else values[0] / 2
        for v in values[1:]:
            e = (e + v) / 2
        got = fleet.running_effectiveness(df, ["k"], ["audit"], from_first).first()["effectiveness"]
        assert got == pytest.approx(e, rel=1e-12)


def test_history_survives_a_round_trip(spark, tmp_path):
    steps = spark.createDataFrame(
        [("o", "a1", 0, "leakage_detector", 1.5, 3, 1), ("o", "a1", 1, "bias_detector", 0.5, 0, 0)],
        "owner string, audit string, position int, tool string, seconds double, findings bigint, criticals bigint",
    )
    profiles = spark.createDataFrame([("o", "a1", 10)], "owner string, audit string, num_rows bigint")
    path = str(tmp_path / "h")
    for _ in range(2):
        sinks.append_history(sinks.history_rows(profiles, steps, ["owner"]), path, "2026-01-05")
    back = sinks.load_history(spark, path, ["owner", "audit"])
    assert back.count() == 1
    assert sorted(map(tuple, sinks.history_steps(back, ["owner"]).distinct().collect())) == sorted(map(tuple, steps.collect()))


def test_history_of_several_runs(spark, tmp_path):
    """A run again adds nothing; a later run replaces what it has, null owners included, and leaves the rest."""
    path, schema = str(tmp_path / "h"), "owner string, audit string, tools map<string,int>, n int"
    first = [("o", "a1", {"x": 1}, 1), ("o", "a2", None, 2), (None, "a1", {}, 3)]
    for run, rows in (("r1", first), ("r1", first), ("r2", [(None, "a1", {"y": 2}, 30), ("p", "a9", {}, 4)]), ("r1", first)):
        sinks.append_history(spark.createDataFrame(rows, schema), path, run)
    back = sinks.load_history(spark, path, ["owner", "audit"])
    assert {(r.owner, r.audit): r.n for r in back.collect()} == {("o", "a1"): 1, ("o", "a2"): 2, (None, "a1"): 30, ("p", "a9"): 4}
    assert back.count() == 4
    with pytest.raises(ValueError):
        sinks.append_history(back, path, "a/b")


def test_audit_records_times_and_what_it_audited(spark):
    df = spark.range(400).select((F.col("id") % 2).cast("int").alias("y"), F.lit(3).alias("flat"), *[F.rand(i).alias(f"a{i}") for i in range(12)])
    result = audit(df, "y", tools=("leakage_detector", "feature_utility"), forests=False)
    steps = {r.tool: r for r in result.steps.collect()}
    assert set(steps) == {"leakage_detector", "feature_utility"}
    assert all(0 < r.execution_time <= result.seconds for r in steps.values())
    row = result.report.first()
    assert row.audit_metadata.dataset_shape == [400, 14] and row.audit_metadata.target_column == "y"
    assert {s.tool: s.execution_time for s in row.execution_timeline} == {t: r.execution_time for t, r in steps.items()}
    record = sinks.audit_record(result.profile, result.steps, result.findings, "y").first()
    assert all(s.execution_time > 0 and s.timestamp for s in record.audit_steps)
    lazy = audit(df, "y", tools=("leakage_detector",), forests=False, materialize=False)
    assert [r.execution_time for r in lazy.steps.collect()] == [None]


def test_audit_of_a_wide_table(spark):
    """A profile of 3,000 columns: no expression may nest as deep as the table is wide."""
    wide = spark.range(1000).select(
        (F.col("id") % 2).cast("int").alias("y"), *[((F.col("id") * (i + 3)) % 97).alias(f"c{i}") for i in range(3000)]
    )
    row = profile.profile(LabelledTable(wide, "y")).first()
    assert (row["num_rows"], row["num_features"], row["num_classes"]) == (1000, 3000, 2)


def test_plans_that_change_thresholds(spark):
    rows = [("d", "multiple_critical_issues", 2), ("d", "leakage_detected", 1), ("e", "no_issues_found_yet", 1)]
    fired = spark.createDataFrame(rows, "dataset string, trigger string, place int").join(fleet.plan_table(spark), "trigger")
    got = {(r.dataset, r.threshold): r.value for r in fleet.adjusted_thresholds(fired).collect()}
    assert got == {("d", "skip_threshold"): 0.6, ("d", "critical_threshold"): 0.5, ("e", "skip_threshold"): 0.3}


def test_cluster_sample_by_brute_force(spark):
    """Five clusters far apart: each gives its share of the sample, the rows whose seeded digests are smallest."""
    rng = random.Random(3)
    sizes = (1000, 500, 300, 150, 50)
    rows = [(1000 * c + i, 100.0 * c * (-1) ** c + rng.random(), 70.0 * c + rng.random(), c % 2) for c, n in enumerate(sizes) for i in range(n)]
    t = LabelledTable(spark.createDataFrame(rows, "k bigint, a double, b double, y int").repartition(4).select("k", "a", "b", "y"), "y", ("k",))
    spread = LabelledTable(t.df.withColumn("v", F.array("a", "b")), "y", ("k",))
    got = {r.k for r in sampling.cluster_sample(spread, 200, vector="v").collect()}
    expected = set()
    for c, n in enumerate(sizes):
        own = sorted((hashlib.md5(f"{t.seed}|{r[0]}".encode()).hexdigest(), r[0]) for r in rows if r[0] // 1000 == c)
        expected |= {k for _, k in own[: max(1, n * 200 // sum(sizes))]}
    assert got == expected and len(got) == 200
