"""Near rows by centres: brute force, work saved on clustered vectors, hot cells spread over tasks."""

import numpy as np
import pytest

from tabscout.functions.metric import Limits, near_rows
from tabscout.operators import contamination

SMALL = Limits(cell=100, centres=8, block=50)


def unit(rows):
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def frames(spark, known, sought):
    a = spark.createDataFrame([(v.tolist(),) for v in known], "u array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(sought)], "id bigint, u array<double>")
    return a.repartition(3), b.repartition(3)


def found(df):
    rows = df.collect()
    return {r.id for r in rows if r.id is not None}, sum(r.pairs for r in rows)


@pytest.mark.parametrize(
    ("kind", "threshold", "limits"),
    [
        ("clustered", 0.95, Limits()),
        ("clustered", 0.9, SMALL),
        ("random", 0.95, Limits(cell=60, centres=3, block=40, rounds=3)),
        ("line", 0.9999, SMALL),
        ("copies", 0.5, SMALL),
    ],
)
def test_against_brute_force(spark, kind, threshold, limits):
    rng = np.random.default_rng(2)
    if kind == "clustered":
        centres = rng.normal(size=(12, 10))
        known, sought = (unit(centres[rng.integers(0, 12, n)] + 0.15 * rng.normal(size=(n, 10))) for n in (600, 300))
    elif kind == "random":
        known, sought = (unit(rng.normal(size=(n, 5))) for n in (500, 200))
    elif kind == "line":
        turns = rng.random((700, 1)) * 6
        known, sought = (unit(np.hstack([np.cos(t), np.sin(t)])) for t in (turns[:400], turns[400:]))
    else:
        base = unit(rng.normal(size=(3, 4)))
        known = unit(base[rng.integers(0, 3, 500)] + 1e-7 * rng.normal(size=(500, 4)))
        sought = unit(np.vstack([base, rng.normal(size=(100, 4))]))
    truth = {int(i) for i in np.flatnonzero(((sought @ known.T) >= threshold).any(1))}
    assert found(near_rows(*frames(spark, known, sought), threshold, limits))[0] == truth


def test_clustered_vectors_are_mostly_not_compared(spark):
    """64 dimensions, 200 clusters: centres and their cells replace most of the n x m comparisons."""
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(200, 64)))
    known, sought = (unit(centres[rng.integers(0, 200, n)] + 0.06 * rng.normal(size=(n, 64))) for n in (12_000, 6_000))
    limits = Limits(cell=1000, block=1000)
    ids, pairs = found(near_rows(*frames(spark, known, sought), 0.95, limits))
    assert ids == {int(i) for i in np.flatnonzero(((sought @ known.T) >= 0.95).any(1))}
    assert pairs < 0.1 * len(known) * len(sought)


def test_vectors_of_other_lengths_are_never_near(spark):
    a = spark.createDataFrame([([1.0, 0.0],), ([0.6, 0.8, 0.0],)], "u array<double>")
    b = spark.createDataFrame([(1, [1.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8, 0.0])], "id bigint, u array<double>")
    assert found(near_rows(a, b, 0.99))[0] == {3}
    assert found(near_rows(a.limit(0), b, 0.99)) == (set(), 0)
    assert found(near_rows(a, b.limit(0), 0.99)) == (set(), 0)


def test_odd_vectors_count_as_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, [])]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    got = contamination.measure_near_duplicates(df, df, vector="v").first()
    assert (got.total, got["count"]) == (8, 3)


def test_cells_are_cut_until_they_are_small(spark):
    """A hot region of half of the rows is cut again; what one task compares stays within the block."""
    rng = np.random.default_rng(4)
    hot = unit(np.array([1.0, 0, 0]) + 0.3 * rng.normal(size=(2000, 3)))
    known = np.vstack([hot, unit(rng.normal(size=(2000, 3)))])
    sought = unit(rng.normal(size=(500, 3)))
    limits = Limits(cell=200, centres=16, block=128)
    ids, pairs = found(near_rows(*frames(spark, known, sought), 0.9995, limits))
    assert ids == {int(i) for i in np.flatnonzero(((sought @ known.T) >= 0.9995).any(1))}
    assert pairs < 0.2 * len(known) * len(sought)


def test_a_routed_row_carries_its_vector_once():
    """Vectors that the triangle inequality excludes nothing for: as many rows come out as went in, and one count."""
    import pyarrow as pa

    from tabscout.functions import metric

    rng = np.random.default_rng(5)
    centres, sought = unit(rng.normal(size=(32, 64))), unit(rng.normal(size=(500, 64)))
    sought[7] = centres[3]
    rows = pa.table({"id": pa.array(range(500), pa.int64()), "u": pa.array(sought.tolist(), pa.list_(pa.float64()))})
    own = {
        "cell": "64",
        "centres": [{"slot": 2 * i, "u": c.tolist()} for i, c in enumerate(centres)],
        "rings": [{"cell": f"64.{2 * i}", "least": 0.0, "most": 2.0} for i in range(32)],
    }
    got = metric._routing(0.7)(rows, pa.Table.from_pylist([own]))
    assert got.num_rows == 501
    slots = got.column("slots").to_pylist()
    assert slots[7] is None and slots[500] is None
    assert all(s == list(range(0, 64, 2)) for i, s in enumerate(slots[:500]) if i != 7)
    assert sum(got.column("pairs").to_pylist()) == 500 * 32
