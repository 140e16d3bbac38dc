"""Tiled correlations: brute force with gaps, passes, few shuffled rows for many columns."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscout.functions import gram
from tabscout.operators import utility
from tabscout.table import LabelledTable


def brute(x):
    out = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            flat = both.sum() < 2 or np.ptp(a) == 0 or np.ptp(b) == 0
            out[i, j] = (int(both.sum()), None if flat else float(np.corrcoef(a, b)[0, 1]))
    return out


def frame(spark, x):
    rows = [(k, [None if np.isnan(c) else float(c) for c in v]) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "k int, v array<double>").repartition(5)


@pytest.mark.parametrize(("tile", "most"), [(128, 1024), (3, 1024), (3, 5)], ids=["one tile", "tiles", "passes"])
def test_against_brute_force(spark, monkeypatch, tile, most):
    monkeypatch.setattr(gram, "TILE", tile)
    monkeypatch.setattr(gram, "PASS", most)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 11))
    x[:, 4] = 3 * x[:, 1] - 1
    x[:, 9] = -x[:, 2] + 0.1 * x[:, 3]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 6], x[:, 7] = 0.0, np.nan
    cells = [F.get("v", F.lit(i)) for i in range(11)]
    want = brute(x)
    got = {(r.i, r.j): (r.n, r.correlation) for r in gram.strong_pairs(frame(spark, x), cells).collect()}
    assert set(got) == set(want)
    for pair, (n, r) in want.items():
        assert got[pair][0] == n and (got[pair][1] is None) == (r is None)
        assert r is None or got[pair][1] == pytest.approx(r, abs=1e-12)
    strong = gram.strong_pairs(frame(spark, x), cells, 0.9).collect()
    assert {(r.i, r.j) for r in strong} == {p for p, (_, r) in want.items() if r is not None and abs(r) >= 0.9}


def test_a_thousand_columns_shuffle_few_rows(spark):
    """10,000 rows of 1,000 columns with ten planted pairs: tiles move, pairs do not."""
    column = lambda i: F.rand(i) if i >= 10 else F.col(f"v{i + 500}") * 2 + F.rand(i) * 0.01
    base = spark.range(10_000, numPartitions=8).select("id", *[F.rand(i).alias(f"v{i}") for i in range(10, 1000)])
    wide = base.select("*", *[column(i).alias(f"v{i}") for i in range(10)])
    moved = spark.sparkContext.accumulator(0)
    plain = gram._partial

    def counted(*args):
        add = plain(*args)

        def run(batches):
            for batch in add(batches):
                moved.add(len(batch))
                yield batch

        return run

    gram._partial = counted
    try:
        rows = gram.strong_pairs(wide, [F.col(f"v{i}") - 0.5 for i in range(1000)], 0.95).collect()
    finally:
        gram._partial = plain
    assert {(r.i, r.j) for r in rows} == {(i, i + 500) for i in range(10)}
    blocks = -(-1000 // gram.TILE)
    assert 0 < moved.value <= 8 * blocks * (blocks + 1) // 2  # not 499,500 pairs a task


def test_findings(spark):
    pdf = pd.DataFrame({"a": [1.0, 2, 3, 4], "b": [2.0, 4, 6, 8.1], "c": [4.0, 1, 3, 2], "one": [1.0] * 4, "y": [0, 1, 0, 1]})
    t = LabelledTable(spark.createDataFrame(pdf), "y")
    found = utility.flag_pairs(utility.measure_pairs(t, 0.95)).collect()
    assert [json.loads(r.evidence)["feature2"] for r in found] == ["b"]
    every = utility.measure_pairs(t).collect()
    assert len(every) == 6 and all(r.correlation is None for r in every if "one" in (r.feature1, r.feature2))
