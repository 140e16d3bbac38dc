import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscout.operators import bias, contamination, leakage, spurious, utility
from tabscout.table import LabelledTable


def table(spark, pdf, target, **kw):
    return LabelledTable(spark.createDataFrame(pdf), target, **kw)


def fired(df):
    return {(r["type"], r["severity"], r["feature"]) for r in df.collect()}


@pytest.fixture(scope="module")
def pumps(spark):
    """A copy and a multiple of the target, a sensor that nearly gives it away, and an unrelated column."""
    rng = np.random.default_rng(11)
    failed = rng.permutation([0, 1] * 30)
    return table(
        spark,
        pd.DataFrame(
            {
                "vibration": rng.normal(size=60),
                "stopped": failed,
                "repair_result": 5 - 3 * failed,
                "sensor": failed + 0.06 * np.where(np.arange(60) % 2, 1, -1),
                "failed": failed,
            }
        ),
        "failed",
    )


def test_leakage_of_planted_copies(pumps):
    found = fired(leakage.check_leakage(pumps))
    assert found == {
        ("perfect_correlation", "critical", "stopped"),
        ("identical_to_target", "critical", "stopped"),
        ("linear_transformation", "critical", "stopped"),
        ("perfect_correlation", "critical", "repair_result"),
        ("linear_transformation", "critical", "repair_result"),
        ("suspicious_name", "warning", "repair_result"),
        ("perfect_correlation", "critical", "sensor"),
    }


def test_correlation_values_and_constant_column(pumps, spark):
    fit = {r["feature"]: r for r in leakage.measure_target_fit(pumps).collect()}
    pdf = pumps.df.toPandas()
    want = np.corrcoef(pdf["sensor"], pdf["failed"])[0, 1]
    assert 0.99 < want < 0.9995
    assert fit["sensor"]["correlation"] == pytest.approx(want, abs=1e-12)
    assert fit["sensor"]["r2"] == pytest.approx(want**2, abs=1e-12)
    flat = table(spark, pd.DataFrame({"c": [1, 1, 1], "y": [0, 1, 0]}), "y")
    assert leakage.measure_target_fit(flat).first()["correlation"] is None


def test_thresholds_are_strict(spark):
    fit = spark.createDataFrame(
        [("a", 0.99, 0.9), ("b", 0.95, 0.999), ("c", -0.9900001, 0.9990001)],
        "feature string, correlation double, r2 double",
    ).withColumns({"coefficient": F.lit(1.0), "intercept": F.lit(0.0), "n": F.lit(9)})
    assert fired(leakage.flag_correlation(fit)) == {
        ("high_correlation", "warning", "a"),
        ("perfect_correlation", "critical", "c"),
    }
    assert fired(leakage.flag_linear_copy(fit)) == {("linear_transformation", "critical", "c")}


def test_text_association_in_both_units(spark):
    pdf = pd.DataFrame({"city": list("aabbccdd") * 3, "noise": list("xy") * 12, "y": list("ppqqppqq") * 3})
    t = table(spark, pdf, "y")
    measured = leakage.measure_text_association(t)
    found = fired(leakage.flag_mutual_information(measured)) | fired(leakage.flag_perfect_predictor(measured))
    assert found == {
        ("perfect_mutual_information", "critical", "city"),
        ("perfect_predictor", "critical", "city"),
    }
    assert not fired(leakage.flag_mutual_information(measured, units="mixed"))


def test_encoded_target(spark):
    pdf = pd.DataFrame({"code": ["id-yes-1", "id-no-2", "z"], "plain": ["a", "b", "c"], "y": ["yes", "no", "no"]})
    found = leakage.flag_encoded_target(table(spark, pdf, "y")).collect()
    assert [r["feature"] for r in found] == ["code"]
    assert json.loads(found[0]["evidence"])["sample_values"] == ["id-no-2", "id-yes-1", "z"]


def test_text_target_silences_numeric_checks(spark):
    t = table(spark, pd.DataFrame({"x": [1.0, 2.0, 3.0], "y": ["a", "b", "a"]}), "y")
    assert not fired(leakage.check_leakage(t))


def split(spark):
    """Ten test rows: three stand in the training split as they are, two more nearly so."""
    rng = np.random.default_rng(13)
    train = pd.DataFrame(rng.normal(size=(40, 4)), columns=["w", "x", "y", "z"])
    train.insert(0, "row", range(40))
    test = pd.DataFrame(rng.normal(size=(10, 4)) , columns=["w", "x", "y", "z"])
    test.insert(0, "row", range(100, 110))
    test.iloc[:3] = train.iloc[[4, 9, 17]].to_numpy()
    test["row"] = test["row"].astype(int)
    return train, test


def test_contamination_of_planted_rows(spark):
    train, test = split(spark)
    sides = spark.createDataFrame(train), spark.createDataFrame(test)
    found = {r["type"]: r for r in contamination.check_contamination(*sides, key=("row",)).collect()}
    assert json.loads(found["train_test_contamination"]["evidence"]) == {"count": 3, "percentage": 30.0}
    assert json.loads(found["hash_contamination"]["evidence"])["count"] == 3
    assert json.loads(found["duplicate_indices"]["evidence"])["count"] == 3
    assert "exact_duplicates_train" not in found
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (train.to_numpy(float), test.to_numpy(float))]
    best = (unit[1] @ unit[0].T).max(axis=1)
    near = json.loads(found["near_duplicates"]["evidence"])
    assert (near["count"], found["near_duplicates"]["severity"]) == (int((best >= 0.95).sum()), "critical")


def test_spot_check_draws_by_key(spark):
    train, test = split(spark)
    sides = spark.createDataFrame(train), spark.createDataFrame(test)
    whole = contamination.measure_near_duplicates_head(*sides, ["row"], 1000).first()
    unit = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in (train.to_numpy(float), test.to_numpy(float))]
    best = (unit[1] @ unit[0].T).max(axis=1)
    assert (whole["total"], whole["count"]) == (10, int((best >= 0.95).sum()))
    assert whole["avg_similarity"] == pytest.approx(best.mean(), abs=1e-12)
    part = contamination.measure_near_duplicates_head(*sides, ["row"], 6).first()
    assert part["total"] == 6
    with pytest.raises(ValueError):
        contamination.measure_near_duplicates_head(*sides, [], 6)


def test_whole_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(400, 3)), rng.normal(size=(200, 3))
    # A third of each side is one dense spot, some rows are zero.
    a[:130], b[:60] = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    b[60:63] = 0
    names = ["p", "q", "r"]
    train = spark.createDataFrame(pd.DataFrame(a, columns=names))
    test = spark.createDataFrame(pd.DataFrame(b, columns=names))
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    cos = (b / np.where(norm == 0, 1, norm)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T
    for threshold in (0.9, 0.95, 0.999):
        got = contamination.measure_near_duplicates(train, test, threshold).first()
        assert got["count"] == int((cos.max(axis=1) >= threshold).sum())
        assert got["total"] == 200


def shuffled_rows(df):
    """Rows that the exchanges of a collected DataFrame wrote, by the plan's own counters."""
    def children(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return [node.executedPlan()]
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return [node.plan()]
        own = node.children()
        return [own.apply(i) for i in range(own.size())]

    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        nodes += children(node)
    return total


def test_a_row_that_is_half_of_the_table_moves_once_per_task(spark):
    """20,000 copies of one row among 20,000 others, 8 tasks: its copies are counted where they are read."""
    rows = spark.range(40_000, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id")).alias("a"), F.when(F.col("id") % 2 == 0, "copy").alias("b")
    )
    hashed = contamination.stored(rows.withColumn("_h", contamination.row_hash64(["a", "b"])).repartition(8))
    repeated = hashed.groupBy("_h").count().where("count > 1").select("_h")
    copies = contamination._behind(hashed, repeated).groupBy("_h", "a", "b").count()
    found = [r["count"] for r in copies.collect() if r["count"] > 1]
    assert found == [20_000]
    # What moves: the digests of the filter (here at most 20,001 a task each) and the copies, once per task, besides chance hits.
    moved = shuffled_rows(copies) - shuffled_rows(_collected(hashed.groupBy("_h").count()))
    assert moved < 300
    got = contamination.measure_duplicates(rows).first()
    assert (got.total, got["count"]) == (40_000, 19_999)
    both = contamination.measure_exact_overlap(rows, rows.where("a < 100")).first()
    assert (both.total, both["count"]) == (20_050, 20_050)


def _collected(df):
    df.collect()
    return df


def test_null_rows_are_equal_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, None), (1, "a")], "x int, y string")
    assert contamination.measure_duplicates(df).first()["count"] == 1
    assert contamination.measure_exact_overlap(df, df.limit(3)).first()["count"] == 3


def biased():
    """Eight of 120 rows in the small class, where most readings are missing; one column with a huge outlier."""
    rng = np.random.default_rng(17)
    pdf = pd.DataFrame({"size": rng.integers(1, 9, 120), "reading": rng.normal(size=120), "outlier": rng.normal(size=120)})
    pdf["kind"] = [0] * 112 + [1] * 8
    pdf.loc[114:, "reading"] = np.nan
    pdf.loc[0, "reading"] = np.nan
    pdf.loc[5, "outlier"] = 1000.0
    return pdf


def test_bias_of_planted_table(spark):
    pdf = biased()
    found = {(r["type"], r["feature"]): r for r in bias.check_bias(table(spark, pdf, "kind")).collect()}
    assert found["moderate_imbalance", None]["metric"] == 14
    assert found["small_class_size", None]["severity"] == "critical"
    assert found["missing_value_bias", "reading"]["metric"] == pytest.approx(75 - 100 / 112)
    # A 2 x 2 table of missing by kind, with the continuity correction.
    observed = np.array([[1, 6], [111, 2]], float)
    expected = np.outer(observed.sum(1), observed.sum(0)) / observed.sum()
    chi2 = ((np.abs(observed - expected) - 0.5) ** 2 / expected).sum()
    pattern = json.loads(found["missing_pattern_correlation", "reading"]["evidence"])
    assert pattern["chi2"] == pytest.approx(chi2, rel=1e-9)
    x = pdf["outlier"].to_numpy()
    g1 = ((x - x.mean()) ** 3).mean() / ((x - x.mean()) ** 2).mean() ** 1.5
    want = g1 * np.sqrt(120 * 119) / 118
    assert found["extreme_skewness", "outlier"]["metric"] == pytest.approx(want, rel=1e-9)
    assert json.loads(found["extreme_skewness", "outlier"]["evidence"])["median"] == pytest.approx(np.median(x))
    assert len(found) == 5


def test_class_sizes_behind_a_sample(spark):
    rows = spark.range(60_000).select(F.col("id"), (F.col("id") % 500 == 0).cast("int").alias("y"), F.rand(1).alias("x"))
    from tabscout import audit

    found = {r["type"] for r in audit(rows, "y", key=("id",), sample=10_000, tools=("bias_detector",)).findings.collect()}
    assert "small_class_size" not in found and "severe_imbalance" in found


def test_single_class_and_tiny_table(spark):
    t = table(spark, pd.DataFrame({"x": [1.0, 2.0], "y": [1, 1]}), "y")
    assert fired(bias.check_bias(t)) == {
        ("single_class", "critical", None),
        ("small_dataset", "warning", None),
        ("small_class_size", "critical", None),
    }


def test_utility_of_planted_table(spark):
    rng = np.random.default_rng(19)
    depth = rng.integers(0, 900, 150)
    pdf = pd.DataFrame(
        {
            "depth": depth,
            "depth_in_feet": depth * 3.28,
            "site": ["north"] * 150,
            "flag": [0] * 146 + [1] * 4,
            "steady": 50 + 0.01 * rng.normal(size=150),
            "rare": [np.nan] * 120 + list(rng.normal(size=30)),
            "tag": [f"tag-{i}" for i in range(150)],
            "wet": rng.integers(0, 2, 150),
        }
    )
    found = fired(utility.check_utility(table(spark, pdf, "wet")))
    assert {f for f in found if f[0] != "low_information_feature"} == {
        ("constant_feature", "critical", "site"),
        ("near_constant_feature", "warning", "flag"),
        ("low_variance_numeric", "warning", "steady"),
        ("redundant_features", "warning", "depth, depth_in_feet"),
        ("excessive_missing", "critical", "rare"),
        ("high_cardinality", "warning", "tag"),
        ("identifier_feature", "critical", "tag"),
    }


def test_pairs_over_complete_rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd"))
    pdf["d"] = pdf["a"] * 2 + rng.normal(size=300) * 0.1
    pdf.loc[::3, "b"] = np.nan
    pdf["y"] = 1
    want = pdf[list("abcd")].corr()
    rows = utility.measure_pairs(table(spark, pdf, "y")).collect()
    assert len(rows) == 6
    for x, y, n, r in rows:
        assert n == (200 if "b" in (x, y) else 300)
        assert r == pytest.approx(want.loc[x, y], abs=1e-12)


def test_shortcut_rules(spark):
    np.random.seed(42)
    magic = np.random.rand(200)
    pdf = pd.DataFrame({"age": np.random.randint(20, 70, 200), "magic": magic, "target": (magic > 0.5).astype(int)})
    t = table(spark, pdf, "target")
    rules = {(r["feature"], r["percentile"]): r["accuracy"] for r in spurious.measure_threshold_rules(t).collect()}
    assert [rules["magic", p] for p in (25, 50, 75)] == pytest.approx([0.74, 0.99, 0.76])
    found = {(r["type"], r["feature"]) for r in spurious.check_spurious(t, forests=False).collect()}
    assert found == {("simple_threshold_rule", "magic"), ("single_feature_dominance", "magic")}


def test_empty_and_missing_inputs(spark):
    empty = LabelledTable(spark.createDataFrame([], "x double, s string, y int"), "y")
    for check in (leakage.check_leakage, utility.check_utility, bias.check_bias, spurious.check_spurious):
        assert not {k for k, _, _ in fired(check(empty))} - {"single_class", "small_dataset", "small_class_size"}
    nulls = LabelledTable(spark.createDataFrame([(None, 1), (None, 0)] * 20, "x double, y int"), "y")
    assert ("excessive_missing", "critical", "x") in fired(utility.check_utility(nulls))
    assert not fired(spurious.check_spurious(nulls))
    with pytest.raises(ValueError):
        LabelledTable(nulls.df, "nope")
