"""Near-duplicate groups against all pairs."""

import random

import numpy as np
import pytest
from planted import make, prose
from pyspark.sql import functions as F

from tabscout.llm import minhash
from tabscout.llm.components import components
from tabscout.llm.minhash import near_duplicates


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in parent}


def check(docs, n):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    group = brute(rows, n)
    got = near_duplicates(docs, n).collect()
    assert len(got) == len(rows)
    sizes = {(i, len(shingles(t, n))) for i, t in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == group[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
            assert (r.doc_id, r.n_shingles) in sizes


@pytest.mark.parametrize("n", [2, 5])
def test_edges(edge_docs, n):
    check(edge_docs, n)


def test_chains_and_strays_in_one_bucket(spark):
    """Documents each like the next, but the ends unlike; and a bucket with several components."""
    words = prose(1, 200).split()
    chain = []
    for k in range(12):
        words = words[:]
        words[k * 15 : k * 15 + 4] = [f"x{k}{j}" for j in range(4)]
        chain.append(" ".join(words))
    half = [prose(1, 100) + " " + prose(50 + k, 45) for k in range(15)]
    check(make(spark, [*half, *chain, chain[0].upper(), chain[5]]), 2)


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_estimate_is_close(spark):
    a, b = prose(1, 1000).split(), prose(1, 1000).split()
    b[:100] = prose(2, 100).split()
    one, two = (minhash.packed(minhash.minima(minhash.shingle_set(" ".join(x), 1))) for x in (a, b))
    truth = len(set(a) & set(b)) / len(set(a) | set(b))
    row = spark.createDataFrame([(one, two)], "a array<bigint>, b array<bigint>").select(minhash.estimate(F.col("a"), F.col("b"))).first()
    assert abs(row[0] - truth) < 0.1
    assert minhash.least_estimate(0.8) < 0.65


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(159, 200), (40, 41)]
    found = {r.id: r.label for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(42)} | {i: 100 for i in [*range(100, 160), 200]}


def edited(words, share, seed):
    rng = random.Random(seed)
    words = list(words)
    for at in rng.sample(range(len(words)), int(share * len(words))):
        words[at] = f"y{seed}_{at}"
    return " ".join(words)


def test_many_strays_beside_a_large_group(spark, monkeypatch):
    """A group of near copies and 150 documents that resemble all of it, though none enough for a link.

    Of two more chains one hangs on the group by a single document, one by none.
    Blocks of 32 documents, so that documents that belong together lie in several blocks.
    """
    monkeypatch.setattr(minhash, "BLOCK", 32)
    compared, links = [], []
    confirmed, tiled = minhash.confirmed, minhash.tiled_links

    def counted_pairs(pairs, *rest):
        compared.append(pairs.count())
        return confirmed(pairs, *rest)

    def counted_links(*given):
        found = tiled(*given)
        links.append(found.count())
        return found

    monkeypatch.setattr(minhash, "confirmed", counted_pairs)
    monkeypatch.setattr(minhash, "tiled_links", counted_links)
    base = prose(1, 200).split()
    group = [edited(base, 0.01, k) for k in range(200)]
    strays = [edited(base, 0.07 + 0.05 * (k % 5) / 4, 1000 + k) for k in range(150)]
    bridge = edited(base, 0.05, 5000).split()
    chain = [edited(bridge, 0.02, 5001 + k) for k in range(10)]
    apart = [edited(edited(base, 0.12, 6000).split(), 0.02, 6001 + k) for k in range(10)]
    texts = [*strays, *group, *chain, *apart]
    random.Random(3).shuffle(texts)
    check(make(spark, texts), 2)
    assert sum(compared) < 15 * len(texts)  # some 30,000 pairs of a stray and a member
    assert links[0] <= 2 * len(texts)


def test_sets_of_a_tile_against_all_pairs():
    rng = np.random.default_rng(5)
    core = np.sort(rng.choice(1 << 40, 300, replace=False)).astype(np.uint64)

    def near(share):
        kept = core[rng.random(len(core)) >= share]
        return np.unique(np.concatenate([kept, rng.integers(1 << 41, 1 << 42, int(share * 300)).astype(np.uint64)]))

    ones = [near(s) for s in rng.uniform(0, 0.3, 40)] + [core[:1], core, core[:240]]
    others = [near(s) for s in rng.uniform(0, 0.1, 30)] + [core]
    truth = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in others] for a in ones])
    assert truth.any() and not truth.all() and truth[-1, -1]
    assert (minhash.linked(ones, others, 80, 64) == truth).all()
    assert not minhash.linked(ones, [], 80).any()
    assert not minhash.linked([core[:5]], [core[200:]], 80).any()


def test_links_of_a_tile_span_its_groups():
    ones, others = np.array([7, 3, 9, 4]), np.array([1, 8, 6, 4])
    found = np.zeros((4, 4), bool)
    found[[0, 0, 1, 3, 2], [0, 1, 1, 3, 2]] = True  # 7-1, 7-8, 3-8; 9-6; 4 with itself
    a, b = minhash.spanning_links(ones, others, found)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 3), (1, 7), (1, 8), (6, 9)]
