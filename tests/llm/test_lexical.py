"""Ranked lexical search: exact scores and ranks by brute force, bounds that hold, pruning that saves work."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from planted import make, prose

from tabscout.llm.lexical import BallTree, Best, Items, Sparse, search, search_shard, terms


def split(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, k):
    """Sorted rows (item, rank, doc, score); equal scores by id, nulls last."""
    counted = [(key, Counter(split(t))) for key, t in docs if split(t)]
    n_docs, total = len(counted), sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for key, c in counted:
            m = 100 - 90 + (90 * c.total() * n_docs) // total
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(split(text)) if t in c)
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=repr)


def pairs(texts):
    return [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]


def sparse(matrix):
    rows, columns = np.nonzero(matrix)
    return Sparse(np.concatenate([[0], np.cumsum((matrix != 0).sum(1))]), columns, matrix[rows, columns])


def test_terms():
    text = "Ab1_c é-É x\x7f\t— 12A ÄB　中文"
    assert [t.decode() for t in terms(text.encode())] == split(text)
    assert terms(None) == terms(b"") == []


def test_edges(spark, edge_texts, edge_docs, no_docs):
    texts = [*edge_texts, *[prose(50, 30)] * 40, (7, "w1 w2"), (7, "w1 w2")]
    items = [(1, prose(1, 30)), (2, None), (3, ""), (4, "nothing of this"), (5, "É ü ß ONE two"), (1, "w1 w2"), (None, "w5 w6"), (6, prose(50, 10))]
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, doc_id int")
    for k, size in ((10, 1 << 20), (3, 60)):  # the second makes many blocks of items
        got = search(make(spark, texts), asked, k, item_bytes=size).collect()
        assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(pairs(texts), items, k)
    assert search(no_docs, asked).count() == 0
    assert search(edge_docs, asked.where("item_id > 99")).count() == 0


def test_many_documents_in_small_trees(spark, monkeypatch):
    monkeypatch.setattr("tabscout.llm.lexical.SHARD", 64)
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(300)]
    texts = [" ".join(rng.choices(vocabulary, range(300, 0, -1), k=rng.randrange(1, 60))) for _ in range(1500)]
    texts += [texts[3]] * 700
    items = [(i, " ".join(rng.choices(vocabulary, k=12))) for i in range(30)]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    got = search(make(spark, texts), asked, 10).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr) == brute(pairs(texts), items, 10)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-3])
def test_bounds_hold(scale):
    """No inner product exceeds the bound of any ball that holds the row, in exact arithmetic."""
    rng = np.random.default_rng(1)
    matrix = np.where(rng.random((500, 40)) < 0.2, rng.integers(1, 10**6, (500, 40)), 0) * scale
    matrix[100:300] = matrix[100]
    matrix[7] = 0
    tree = BallTree(sparse(matrix), 40, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(500))
    leaves = [i for i, child in enumerate(tree.left) if child < 0]
    assert max(tree.last[i] - tree.first[i] for i in leaves) <= 8
    for _ in range(20):
        query = np.where(rng.random(40) < 0.3, rng.random(40) * scale, 0)
        exact = matrix.astype(np.longdouble) @ query.astype(np.longdouble)
        for node, bound in enumerate(tree.bounds(query)):
            inside = tree.order[tree.first[node] : tree.last[node]]
            assert (exact[inside] <= bound).all()


def test_pruning_saves_work_and_loses_nothing():
    """Documents about different things: a search scores a small part of them."""
    rng = np.random.default_rng(3)
    groups, width = 40, 400
    matrix = np.zeros((4000, width), np.int64)
    for i in range(4000):
        own = (i % groups) * 10 + np.arange(10)
        matrix[i, own] = rng.integers(4 * 10**5, 5 * 10**5, 10)
    weights = rng.integers(3000, 5000, width)
    items = [np.arange(g * 10, g * 10 + 8) for g in range(groups)]
    best = Best(groups, 10)
    scored = search_shard(np.arange(4000), np.zeros(4000, bool), sparse(matrix), Items(list(range(groups)), items, weights), best)
    assert scored < 0.2 * groups * 4000
    for i, own in enumerate(items):
        exact = matrix[:, own] @ weights[own]
        top = np.lexsort((np.arange(4000), -exact))[:10]
        assert sorted((-s, -d) for s, _, d in best.found[i]) == [(-exact[t], t) for t in top]


def test_scores_beyond_the_precision_of_doubles():
    """Sums above 2^53 that differ by one are still told apart."""
    base = np.full((20, 30), 2**48, np.int64)
    base[np.arange(20), 0] += np.arange(20)
    best = Best(1, 5)
    search_shard(np.arange(20), np.zeros(20, bool), sparse(base), Items([0], [np.arange(30)], np.full(30, 977)), best, leaf=4)
    assert sorted(-d for _, _, d in best.found[0]) == [15, 16, 17, 18, 19]
