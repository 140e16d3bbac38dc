"""Forests that are grown by counts of all rows, against plain Python."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscout import audit
from tabscout.functions import forests
from tabscout.operators import spurious
from tabscout.table import LabelledTable


def planted(rows):
    """One class decided by the first column but for some noise; the other columns say little."""
    rng = np.random.default_rng(29)
    pdf = pd.DataFrame({"id": np.arange(rows), "a": rng.normal(size=rows), "b": rng.integers(0, 4, rows), "c": rng.normal(size=rows)})
    pdf["d"] = np.where(rng.random(rows) < 0.9, 0.0, rng.exponential(size=rows))
    pdf["y"] = (pdf["a"] + 0.2 * rng.normal(size=rows) > 0.3).astype(int)
    return pdf


def test_forest_checks_read_every_row(spark, monkeypatch):
    def sampled(*args, **kwargs):
        raise AssertionError("a sample was drawn")

    monkeypatch.setattr(spurious, "adaptive_sample", sampled)
    df = spark.createDataFrame(planted(12_000))
    found = audit(df, "y", key=("id",), tools=("spurious_detector",)).findings
    by = {(r["type"], r["feature"]): json.loads(r["evidence"]) for r in found.collect()}
    drop = by["feature_removal_sensitivity", "a"]
    assert drop["baseline_accuracy"] > 0.85 > 0.7 > drop["reduced_accuracy"]
    assert sum(by["concentrated_importance", "a"]["feature_importances"].values()) == pytest.approx(1)
    grown = spurious.Forests(LabelledTable(df, "y", ("id",)))
    assert grown.rows == grown.data.agg(F.sum("n")).first()[0] == 12_000


def test_rare_class_outside_a_sample(spark):
    """A class of three rows is among those the forests tell apart, however many rows there are."""
    df = spark.range(20_000).select(
        "id",
        F.when(F.col("id") < 3, 7.0).otherwise(F.col("id") % 2).alias("a"),
        (F.col("id") % 5).alias("b"),
        F.when(F.col("id") < 3, "rare").when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("y"),
    )
    grown = spurious.Forests(LabelledTable(df, "y", ("id",)))
    assert grown.classes == 3
    assert {r["label"]: r["n"] for r in grown.data.groupBy("label").agg(F.sum("n").alias("n")).collect()} == {0: 9998, 1: 9999, 2: 3}
    cuts = forests.cut_points(df, {"a": F.col("a").cast("double")}, 20_000)
    assert cuts == {"a": [0.0, 1.0]}


def test_cut_points(spark):
    pdf = planted(5000)
    cells = {n: F.col(n).cast("double") for n in "abd"}
    cuts = forests.cut_points(spark.createDataFrame(pdf).repartition(5), cells, 5000)
    ordered = np.sort(pdf["a"].to_numpy())
    assert cuts["a"] == [ordered[i * 5000 // 32] for i in range(1, 32)]
    assert cuts["b"] == [0, 1, 2]
    # The common value has a bin of its own, the others share what is left.
    codes = np.searchsorted(cuts["d"], pdf["d"])
    assert len(cuts["d"]) == 31 and len(set(codes[pdf["d"] == 0])) == 1
    rest = codes[pdf["d"] > 0]
    assert set(codes[pdf["d"] == 0]).isdisjoint(rest) and np.bincount(rest).max() <= 1 + len(rest) / 30


def prepared(spark, pdf, parts=3):
    t = LabelledTable(spark.createDataFrame(pdf).repartition(parts), "y", ("id",))
    return spurious.Forests(t)


def brute_tree(codes, label, weight, depth):
    """``(feature, cut, gain)`` of each node by its number, all features tried."""
    found = {}

    def square(mask):
        counts = np.bincount(label[mask], weight[mask], 2)
        return (counts**2).sum() / counts.sum() if counts.sum() else 0

    def split(mask, node):
        total = weight[mask].sum()
        options = []
        for f in range(codes.shape[1]):
            for cut in range(31):
                low, high = mask & (codes[:, f] <= cut), mask & (codes[:, f] > cut)
                if weight[low].sum() and weight[high].sum():
                    options.append(((square(low) + square(high) - square(mask)) / total, -f, -cut))
        if options and max(options)[0] > 1e-12 and node < 2**depth - 1:
            gain, f, cut = max(options)
            found[node] = (-f, -cut, gain)
            split(mask & (codes[:, -f] <= -cut), 2 * node + 1)
            split(mask & (codes[:, -f] > -cut), 2 * node + 2)

    split(np.ones(len(label), bool), 0)
    return found


def test_tree_against_brute_force(spark):
    grown = prepared(spark, planted(700))
    rows = grown.data.toPandas()
    codes = np.array([list(c) for c in rows["codes"]])
    plan = forests.Plan(tuple(range(codes.shape[1])), 1, 1, 3)
    tree = forests.Tree(plan, 0, 42, 2)
    whole = rows["fold"].to_numpy() != 1
    weight = forests._drawing(42)(rows["draw"].to_numpy(), rows["n"].to_numpy(), 1)[0]
    want = brute_tree(codes[whole], rows["label"].to_numpy()[whole], weight[whole], 3)
    merge, forests.Tree.merge = forests.Tree.merge, lambda self: None
    try:
        tree = forests.grow(grown.data, [plan], 2, 42)[0][0]
    finally:
        forests.Tree.merge = merge
    inner = np.flatnonzero(tree.feature >= 0)
    assert set(inner) == set(want) and len(want) > 3
    for node in inner:
        assert tree.gain[node] == pytest.approx(want[node][2], rel=1e-9)
    assert (tree.feature[0], tree.cut[0]) == want[0][:2]
    # Told by hand: each held row goes to its leaf, which votes by its class shares.
    tree.merge()
    held = rows["fold"].to_numpy() == 1
    right = 0
    for code, label in zip(codes[held], rows["label"].to_numpy()[held]):
        node = 0
        while tree.feature[node] >= 0:
            node = 2 * node + 1 + int(code[tree.feature[node]] > tree.cut[node])
        right += tree.counts[node].argmax() == label
    assert forests.fold_scores(grown.data, [plan], 2, 42) == [pytest.approx(right / held.sum())]


def test_same_forest_at_every_partitioning_and_block(spark, monkeypatch):
    pdf = planted(900)
    plan = forests.Plan((0, 1, 2, 3, 4), -1, 4, 4)
    one = forests.importances(prepared(spark, pdf, 1).data, plan, 5, 2, 42)
    grown = prepared(spark, pdf, 7)
    monkeypatch.setattr(forests, "_COUNTERS", 1200)
    assert forests.importances(grown.data.repartition(5), plan, 5, 2, 42) == one
    assert one[1] == max(one) and sum(one) == pytest.approx(1)


def test_bootstrap_of_repeated_rows():
    digest = np.random.default_rng(3).integers(-(2**63), 2**63, 40_000)
    for rows in (1, 2, 40, 500):
        drawn = forests._drawing(42)(digest, np.full(40_000, rows), 6)
        assert drawn.mean() == pytest.approx(rows, rel=0.02)
        assert drawn.var() == pytest.approx(rows, rel=0.05)
        assert abs(np.corrcoef(drawn)[np.triu_indices(6, 1)]).max() < 0.03


def test_equal_rows_and_one_fold(spark):
    """Rows without a key that are all equal to many others fall into few folds; a fold without rows has no score."""
    df = spark.createDataFrame([(1.0, 2.0, 1)] * 50 + [(0.0, 2.0, 0)] * 50, "a double, b double, y int")
    grown = spurious.Forests(LabelledTable(df, "y"))
    assert sorted(r["n"] for r in grown.data.collect()) == [50, 50]
    assert spurious.check_spurious(LabelledTable(df, "y")).count() >= 1
    null = spark.createDataFrame([(None, float(i % 7), float(i % 3), i % 2) for i in range(60)], "id string, a double, b double, y int")
    assert spurious.measure_ablation(LabelledTable(null, "y", ("id",)), spurious.Forests(LabelledTable(null, "y", ("id",)))).count() == 0
