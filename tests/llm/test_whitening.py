"""Whitening: refined axes against plain eigenvectors, exact sums, odd vectors."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from tabscout.llm.whitening import Axes, refined_eigenvectors, whiten


def check_axes(a, residual=1e-15):
    values, vectors = refined_eigenvectors(a)
    scale = max(np.abs(values).max(), 1e-300)
    wide = a.astype(np.longdouble)
    assert (np.diff(values) <= 0).all()
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * scale
    assert float(np.abs(wide @ vectors - vectors.astype(np.longdouble) * values).max()) <= residual * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() <= 1e-14
    return values, vectors


def rotated(spectrum, seed=2):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(spectrum), len(spectrum))))[0]
    m = (q * np.asarray(spectrum, float)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "spectrum",
    [
        np.arange(1, 33),
        np.r_[np.ones(10), 2 * np.ones(10), np.arange(3, 9)],  # equal eigenvalues
        1 + 1e-9 * np.arange(24),  # one cluster, below single precision
        np.r_[1 + 1e-12 * np.arange(6), 1e-8 * np.ones(4), np.zeros(10)],
        np.zeros(3),
        [5.0],
        1e-30 * np.arange(1, 7),
        1e30 * np.arange(1, 7),
    ],
    ids=["apart", "equal", "cluster", "low-rank", "zero", "one", "tiny", "huge"],
)
def test_refinement(spectrum):
    check_axes(rotated(spectrum))


def test_single_precision_alone_is_far_worse():
    a = rotated(np.r_[1.0, 1.0001, 1.0002, np.arange(2, 12)])
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    rough_error = np.abs(a @ rough - rough * np.diag(rough.T @ a @ rough)).max()
    _, fine = check_axes(a)
    assert rough_error > 1e6 * np.abs(a @ fine - fine * np.diag(fine.T @ a @ fine)).max()


def test_a_cluster_is_told_apart():
    """Eigenvalues 1e-9 apart: the axes still agree with those of the shifted matrix, where they are plain."""
    spread = 1e-9 * np.arange(1, 9)
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(8, 8)).astype(np.longdouble).astype(float))[0]
    a = np.eye(8) + (q * spread) @ q.T
    a = (a + a.T) / 2
    _, fine = check_axes(a)
    _, plain = np.linalg.eigh((a - np.eye(8)) * 1e9)
    cosines = np.abs((fine * plain[:, ::-1]).sum(0))
    assert cosines.min() > 1 - 1e-12


def rows_of(rng):
    base = (rng.normal(size=(200, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # one vector is most of the table
    rows += [(5, rows[9][1]), (None, rows[3][1]), (2000, [0.0] * 6)]
    rows += [(3000, None), (3001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (3002, [float("nan")] * 6), (3003, [float("inf")] * 6), (3004, [])]
    rows += [(4000 + i, [float(i), 1.0]) for i in range(5)]  # another width, one direction only
    rows += [(5000, [0.25, 0.5, 0.75])]  # a width with one vector
    return rows


def brute(rows, k):
    fine = [(key, [floor(256 * float(c)) for c in v]) for key, v in rows if v and all(c is not None and isfinite(c) for c in v)]
    out = {}
    for width in {len(v) for _, v in fine}:
        own = [(key, v) for key, v in fine if len(v) == width]
        fit = sorted({tuple(v) for _, v in own})
        n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
        centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in fit])
        values, vectors = np.linalg.eigh(centred.T @ centred / n)
        for key, v in own:
            deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))
            at = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)])
            for j in range(min(k, width)):
                e = values[-1 - j]
                real = e > max(values[-1], 0) * 1e-12
                white = abs(at @ vectors[:, -1 - j]) / np.sqrt(e) if real else None
                out.setdefault((key, j + 1, n, deviation), []).append((white, e / values.sum() if real else 0.0))
    return out


def test_against_brute_force(spark):
    rows = rows_of(np.random.default_rng(11))
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id bigint, embedding array<float>, n int, x string").repartition(4)
    got = whiten(df, 4).collect()
    want = brute(rows, 4)
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.component, r.n, r.deviation), []).append(r)
    assert {k: len(v) for k, v in seen.items()} == {k: len(v) for k, v in want.items()}
    for key, found in seen.items():
        for r, (white, share) in zip(found, want[key], strict=True):
            assert (r.whitened is None) == (white is None)
            assert white is None or abs(r.whitened) == pytest.approx(white, rel=1e-9, abs=1e-9)
            assert r.explained == pytest.approx(share, rel=1e-9)
    assert {r.identity_error for r in got if r.n == 1} == {None}
    assert all(r.identity_error < 1e-12 for r in got if r.n > 1)


def test_one_sign_for_all_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 5)))]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    one = {(r.vec_id, r.component): r.whitened for r in whiten(df.repartition(7)).collect()}
    other = {(r.vec_id, r.component): r.whitened for r in whiten(df.coalesce(1)).collect()}
    assert one == pytest.approx(other, abs=1e-12)
    white = np.array([[one[i, j] for j in range(1, 5)] for i in range(400)])
    assert np.abs(np.cov(white.T, bias=True) - np.eye(4)).max() < 1e-12


def test_large_numbers_stay_exact():
    own = Axes(3, (2**60, -5), np.eye(2), np.ones(2), 2.0)
    x = np.array([[2**55, 1], [-(2**61), 7]], np.int64)
    assert own.deviations(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(v, own.sums, strict=True)) for v in x]


def test_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(1, [2.0**40]), (2, [-(2.0**40)])], "vec_id bigint, embedding array<double>")
    rows = whiten(df).collect()
    assert [r.deviation for r in rows] == [None, None] and [abs(r.whitened) for r in rows] == pytest.approx([1, 1])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert whiten(df).count() == 0
