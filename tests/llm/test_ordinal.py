"""Ordinal grades: held-out accuracy and edge cases."""

import math

import numpy as np
import pytest
import xxhash
from planted import make
from pyspark.sql import functions as F

from tabscout.llm.ordinal import Grades, features, fit_grades, grade, loss, quality_grade

SF = "/root/testdata/sf0.1"


def test_held_out_grades(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    held = labels.where("doc_id % 4 = 0")
    model = fit_grades(docs, labels.where("doc_id % 4 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = grade(docs.join(held, "doc_id").select("doc_id", "text", "grade"), model).collect()
    truth = np.array([r.grade for r in rows])
    kept = np.array([r.tail_probability >= 0.5 for r in rows])
    expected = np.array([r.expected_grade for r in rows])
    assert len(rows) > 800
    assert kept[truth == 2].mean() > 0.97
    assert kept[truth == 0].mean() < 0.1
    assert kept[truth == 1].mean() < 0.25
    means = [expected[truth == g].mean() for g in range(3)]
    assert means == sorted(means)


def test_equal_samples_give_equal_models(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", quality_grade(F.col("quality"), F.col("toxic")).alias("grade"))
    one, two = fit_grades(docs, labels), fit_grades(docs.repartition(5), labels.repartition(3))
    assert (one.hashes == two.hashes).all() and (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, 2), (4, 0), (5, 1), (1, 0), (None, 1), (99, 2), (6, None), (7, 5)], "doc_id bigint, grade int")
    model = fit_grades(edge_docs, labels)
    rows = grade(edge_docs, model).collect()
    assert len(rows) == edge_docs.count()
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r in rows)
    assert len({r.expected_grade for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert grade(no_docs, model).count() == 0
    nothing = fit_grades(edge_docs, labels.where("doc_id = -1"))
    assert {r.tail_probability for r in grade(edge_docs, nothing).collect()} == {1.0}


def test_levels_and_thresholds():
    rng = np.random.default_rng(2)
    texts, grades = [], []
    for _ in range(400):
        g = int(rng.integers(0, 4))
        texts.append(features(" ".join([f"grade{g}", *[f"n{rng.integers(0, 50)}" for _ in range(10)]])))
        grades.append(g)
    model = Grades.fit(texts, np.array(grades), 4)
    scores = [model.score(f"grade{g}") for g in range(4)]
    assert scores == sorted(scores)
    assert list(model.thresholds) == sorted(model.thresholds)
    assert model.above(np.array([1e9, -1e9])).sum(1) == pytest.approx([3, 0])


def test_grades_of_labels(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (None, 0), (1, None), (None, 1)], "q int, t int")
    assert [r[0] for r in rows.select(quality_grade(F.col("q"), F.col("t"))).collect()] == [1, 2, 0, 0, None, None, 0]


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(4)
    n, width, levels = 60, 9, 4
    row, at = np.nonzero(rng.random((n, width)) < 0.4)
    grades, weights, thresholds = rng.integers(0, levels, n), rng.normal(size=width), np.array([-1.0, 0.2, 1.5])
    _, by_weight, by_threshold = loss(row, at, grades, weights, thresholds)
    step = 1e-6
    for given, found in ((weights, by_weight), (thresholds, by_threshold)):
        for i in range(len(given)):
            sides = []
            for sign in (1, -1):
                moved = given.copy()
                moved[i] += sign * step
                sides.append(loss(row, at, grades, *((moved, thresholds) if given is weights else (weights, moved)))[0])
            assert found[i] == pytest.approx((sides[0] - sides[1]) / (2 * step), abs=1e-7)


def test_loss_against_the_definition():
    weights, thresholds = np.array([0.5, -1.0, 2.0]), np.array([-0.5, 1.0])
    rows, grades = [[0], [0, 1], [2], []], np.array([0, 1, 2, 1])
    total = 0.0
    for own, g in zip(rows, grades, strict=True):
        score = sum(weights[i] for i in own)
        below = [0.0, *[1 / (1 + math.exp(score - t)) for t in thresholds], 1.0]
        total -= math.log(below[g + 1] - below[g])
    row, at = np.repeat(np.arange(4), [len(r) for r in rows]), np.array([i for r in rows for i in r])
    assert loss(row, at, grades, weights, thresholds)[0] == pytest.approx(total / 4)


def test_grades_of_documents_against_the_definition(spark):
    """Every row's two numbers, from weights of single words."""
    weight = {"good": 1.5, "bad": -2.0, "fine": 0.25}
    hashes = np.array([xxhash.xxh32_intdigest(w) for w in weight], np.uint32)
    order = np.argsort(hashes)
    model = Grades(hashes[order], np.array(list(weight.values()))[order], np.array([-1.0, 0.5]))
    texts = ["good", "Good, good bad.", "nothing", "", None, "fine\tBAD! " + "word " * 5000, "fine good bad"]
    for r in grade(make(spark, texts), model).select("text", "expected_grade", "tail_probability").collect():
        score = sum(weight.get(w, 0) for w in {t.strip("!,.").lower() for t in (r.text or "").split()})
        above = [1 / (1 + math.exp(t - score)) for t in (-1.0, 0.5)]
        assert (r.expected_grade, r.tail_probability) == (pytest.approx(sum(above)), pytest.approx(above[1]))


@pytest.mark.parametrize("kinds", [1, 19, 20, 31])
def test_share_of_bare_words_counts_words_however_many_kinds_there_are(kinds):
    text = " ".join(["-" * (k + 1) for k in range(kinds)] + ["!"] * 10 + [f"w{k}" for k in range(300)])
    share = (kinds + 10) / (kinds + 310)
    own = set(features(text).tolist())
    for step in (0.02, 0.05, 0.1, 0.2, 0.4):
        assert (xxhash.xxh32_intdigest(f"\x011 {step}") in own) == (share >= step)
