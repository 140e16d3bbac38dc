"""Vantage-point trees: exact with factor 1, recall beyond it."""

import numpy as np
import pytest

from tabscout.llm.vantage import Tree, inner_products, nearest


def brute(rows, queries, k):
    fine = {}
    for key, v in rows:
        if key is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        fine.setdefault(key, []).append(np.array(v, np.float64))
    out = set()
    for q in queries:
        for own in fine.get(q, []):
            scored = []
            for key, many in fine.items():
                for v in many:
                    if key != q and len(v) == len(own):
                        score = 0.0
                        for a, b in zip(own, v, strict=True):
                            score += a * b
                        scored.append((-score, key))
            out |= {(q, i + 1, key, -s) for i, (s, key) in enumerate(sorted(scored)[:k])}
    return out


def test_exact_on_edges(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]  # very many equal vectors
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] * 4), (404, [float("nan")] * 8), (None, rows[1][1]), (420, [float("inf")] * 8), (440, [2.0, 1.0]), (441, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "vec_id bigint, embedding array<float>, shard int, id string").repartition(3)
    for shard, block in ((8192, 8192), (64, 10)):
        found = nearest(df, df.where("vec_id % 20 = 0"), 7, shard=shard, block=block).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == brute(rows, range(0, 441, 20), 7)
    assert nearest(df.where("vec_id = -1"), df, 7).count() == 0
    assert nearest(df.where("vec_id < 3"), df.where("vec_id = 0"), 7).count() == 2


def test_repeated_rows(spark):
    """A repeated query is one query; ids with two vectors ask twice, and each answer has its own ranks."""
    rng = np.random.default_rng(8)
    vectors = [rng.normal(size=4).tolist() for _ in range(41)]
    rows = [*enumerate(vectors), (20, vectors[20]), (20, vectors[20]), (40, vectors[3]), (7, vectors[7])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, digest int").repartition(3)
    for shard in (8192, 8):
        found = nearest(df, df.where("vec_id % 20 = 0"), 6, shard=shard, block=2).collect()
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
        assert len(got) == 6 * 4  # queries 0, 20 and twice 40
        assert set(got) == brute([(i, v) for i, v in rows], [0, 20, 40], 6)
        assert [r[1] for r in got if r[0] == 20] == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize(("factor", "least"), [(1.0, 1.0), (1.5, 0.99), (2.0, 0.9)])
def test_recall_of_relaxed_pruning(factor, least):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16))
    vectors = centres[rng.integers(0, 20, 4000)] + 0.3 * rng.normal(size=(4000, 16))
    norm = float(np.sqrt((vectors**2).sum(1).max()))
    tree = Tree.build(np.arange(4000), vectors, norm)
    queries = vectors[::40]
    best, _ = tree.search(np.arange(0, 4000, 40), queries, norm, 10, factor)
    scores = queries @ vectors.T
    scores[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    truth = np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best, truth, strict=True)]) >= least
    with pytest.raises(ValueError):
        tree.search(np.arange(1), queries[:1], norm, 10, 0.5)


@pytest.mark.parametrize("length", [1e12, 1e160])
def test_exact_beside_one_very_long_vector(length):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(2000, 8))
    vectors[7] = 0
    vectors[7, 0] = length
    with np.errstate(over="ignore"):
        norm = float(np.sqrt((vectors**2).sum(1).max())) * (1 + 1e-12)
    tree = Tree.build(np.arange(2000), vectors, norm, leaf=16)
    asked = np.setdiff1d(np.arange(0, 2000, 40), [7])
    best, _ = tree.search(asked, vectors[asked], norm, 5, 1.0)
    scores = inner_products(np.repeat(vectors[asked], 2000, 0), np.arange(2000 * len(asked)), np.tile(vectors, (len(asked), 1)), np.arange(2000 * len(asked)))
    scores = scores.reshape(len(asked), 2000)
    scores[np.arange(len(asked)), asked] = -np.inf
    assert (best == np.argsort(-scores, axis=1, kind="stable")[:, :5]).all()
