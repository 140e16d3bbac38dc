"""Pieces inside texts: brute force, filters of any size, very long texts, many equal windows."""

import random

import pandas as pd
import pytest

from tabscout.functions.rolling import _hashing, contained_pieces
from tabscout.operators import leakage
from tabscout.table import LabelledTable


def frames(spark, values, pieces):
    a = spark.createDataFrame(values, "feature string, value string").repartition(3)
    return a, spark.createDataFrame([(p,) for p in pieces], "piece string")


def brute(values, pieces):
    return {(f, p) for f, v in values for p in pieces if v and p and p in v}


@pytest.mark.parametrize("bits", [4, 25], ids=["full filter", "wide filter"])
def test_against_brute_force(spark, bits):
    rng = random.Random(1)
    letters = "abé😀 1"
    values = [(rng.choice("xyz"), "".join(rng.choices(letters, k=rng.randrange(0, 30)))) for _ in range(400)]
    values += [("x", None), ("y", ""), ("z", "aaaaaaaaaa")]
    pieces = {"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(120)} | {"", None, "aaaaaaaaaaa"}
    got = contained_pieces(*frames(spark, values, pieces), bits=bits, chunk=7).collect()
    assert len(got) == len({(r.feature, r.piece) for r in got})
    assert {(r.feature, r.piece) for r in got} == brute(values, pieces)


def test_hashes_depend_on_the_window_alone():
    """Equal windows at different places, and in different chunks, have equal hashes; others differ."""
    import numpy as np

    text = "the cat the dog the cat"
    for chunk in (4, 1000):
        seen = {}
        for k, start, h in _hashing(chunk)(text, np.array([1, 3, 7])):
            for i, x in enumerate(h.tolist()):
                seen.setdefault(text[start + i : start + i + k], set()).add(x)
        assert all(len(v) == 1 for v in seen.values())
        assert len({next(iter(v)) for v in seen.values()}) == len(seen)
        assert set(seen) == {text[i : i + k] for k in (1, 3, 7) for i in range(len(text) - k + 1)}


def test_very_long_values(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh", k=200_000))
    values = [("a", long), ("b", "1" * 200_000), ("c", long[:50])]
    pieces = {long[150_000:150_020], long[-9:], "1", "11111", "zz", long[40:60], "h" * 30}
    got = contained_pieces(*frames(spark, values, pieces))
    assert {(r.feature, r.piece) for r in got.collect()} == brute(values, pieces)


def test_nothing_to_find(spark):
    values, pieces = frames(spark, [("a", "x")], ["", None])
    assert contained_pieces(values, pieces).count() == 0
    assert contained_pieces(values.limit(0), frames(spark, [("a", "x")], ["x"])[1]).count() == 0


def test_a_long_text_gives_the_target_away(spark):
    noise = "".join(random.Random(3).choices("uvwxyz", k=200_000))
    pdf = pd.DataFrame({"log": [noise + "yes" + noise, noise], "plain": ["a", "b"], "y": ["yes", "no"]})
    rows = leakage.measure_encoded_target(LabelledTable(spark.createDataFrame(pdf), "y")).collect()
    assert {(r.feature, r.distinct_values, r.matched_targets) for r in rows} == {("log", 2, 1), ("plain", 2, 0)}
