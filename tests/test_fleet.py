"""Fleet statistics over long histories in blocks, and similar tables by cells, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.operators import fleet


@pytest.fixture(scope="module")
def long_history(spark):
    """One owner with a million audits, one with three, one with none but nulls elsewhere."""
    hot = spark.range(1_000_000, numPartitions=8).select(
        F.lit("hot").alias("owner"), F.col("id").alias("audit"), (F.floor(F.rand(5) * 11) / 10).alias("empty_share"), F.rand(6).alias("value")
    )
    few = spark.createDataFrame([("few", 1, 0.5, 0.25), ("few", 2, 0.0, 0.5), ("few", 3, 1.0, 1.0), (None, 7, 0.9, 0.125)], "owner string, audit bigint, empty_share double, value double")
    return fleet.stored(hot.union(few))


def rows_of(history, column):
    out = {}
    for r in history.orderBy("owner", "audit").select("owner", column).toLocalIterator():
        out.setdefault(r.owner, []).append(r[column])
    return out


@pytest.mark.parametrize("from_first", [True, False])
def test_running_effectiveness_of_a_million_audits(spark, long_history, from_first):
    got = {r.owner: r.effectiveness for r in fleet.running_effectiveness(long_history, ["owner"], ["audit"], from_first, 16).collect()}
    for owner, values in rows_of(long_history, "value").items():
        e = values[0] if from_first else values[0] / 2
        for v in values[1:]:
            e = (e + v) / 2
        assert got[owner] == pytest.approx(e, rel=1e-12)


def test_threshold_of_a_million_audits(spark, long_history):
    got = {r.owner: (r.audits, r.steps) for r in fleet.tune_threshold(long_history, ["owner"], 16).collect()}
    for owner, shares in rows_of(long_history, "empty_share").items():
        level = 0
        for i in range(2, len(shares)):
            recent = sum(shares[max(0, i - 9) : i + 1]) / min(10, i + 1)
            level = max(-3, min(3, level + (1 if recent > 0.4 else -1 if recent < 0.1 else 0)))
        assert got[owner] == (len(shares), level)


def test_a_history_is_spread_over_blocks(spark, long_history):
    sizes = [r["count"] for r in fleet.in_blocks(long_history, ["owner"], ["audit"], 16).where("owner = 'hot'").groupBy("_block").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 200_000


@pytest.mark.parametrize("blocks", [1, 3, 40])
def test_recent_shares_do_not_depend_on_blocks(spark, blocks):
    rng = random.Random(1)
    rows = [(o, a, rng.random()) for o in ("a", "b", None) for a in range(rng.randrange(1, 60))]
    df = spark.createDataFrame(rows, "owner string, audit int, empty_share double")
    got = {(r.owner, r.audit): (r.seen, r.recent_empty_share) for r in fleet.recent_empty_share(df, ["owner"], blocks=blocks).collect()}
    assert len(got) == len(rows)
    for owner in ("a", "b", None):
        own = [s for o, _, s in rows if o == owner]
        for i in range(len(own)):
            seen, share = got[owner, i]
            assert seen == i + 1 and share == pytest.approx(np.mean(own[max(0, i - 9) : i + 1]), rel=1e-12)


@pytest.mark.parametrize("by", [[], ["owner"]])
def test_similar_tables_by_cells(spark, by):
    """The whole fleet at once, and per owner; sizes, features and complexities on the limits included."""
    rng = random.Random(4)
    sizes, features = [0, 1, 2, 5, 10, 100, 150, 199, 200, 201, 1000, 10**6], [0, 1, 2, 3, 4, 6, 8, 20, 40]
    tables = [(rng.choice("xy"), i, rng.choice(sizes), rng.choice(features), rng.randrange(0, 11) / 10) for i in range(300)]
    profiles = spark.createDataFrame(tables, "owner string, audit int, num_rows bigint, num_features int, complexity_score double")
    ran = [(o, a, t, rng.random() * 3, rng.randrange(0, 4)) for o, a, *_ in tables for t in rng.sample(["t1", "t2", "t3"], 2)]
    steps = spark.createDataFrame(ran, "owner string, audit int, tool string, seconds double, criticals int")
    if not by:
        profiles, steps = profiles.drop("owner"), steps.drop("owner")
    wanted = profiles.where("audit < 60")
    got = {(tuple(r[c] for c in by), r.audit, r.tool): r.effectiveness for r in fleet.similar_effectiveness(wanted, profiles, steps, by).collect()}

    def close(a, b):
        return max(a, b) > 0 and abs(a - b) / max(a, b) <= 0.5

    expected = {}
    for o, a, n, f, c in tables[:60]:
        for (po, _, pn, pf, pc), own in ((t, [r for r in ran if r[1] == t[1]]) for t in tables):
            if (not by or o == po) and close(n, pn) and close(f, pf) and abs(c - pc) <= 0.3:
                for _, _, tool, seconds, criticals in own:
                    expected.setdefault(((o,) if by else (), a, tool), []).append(min(1.0, criticals / max(1.0, seconds)))
    assert set(got) == set(expected)
    for k, gains in expected.items():
        assert got[k] == pytest.approx(sum(gains) / len(gains), rel=1e-9)
