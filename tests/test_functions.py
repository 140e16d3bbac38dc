import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabscout.functions.frequency import rank_buckets, rank_sums
from tabscout.functions.hashing import first_by_hash
from tabscout.functions.quantiles import order_statistics, quantile_values
from tabscout.functions.stats import chi2_sf


def test_chi2_tail_matches_closed_forms(spark):
    rows = [(x, k) for x in (0.0, 0.1, 1.0, 3.0, 10.0, 80.055402, 199.0) for k in (1, 2, 4)]
    df = spark.createDataFrame(rows, "x double, k int")
    for r in df.select("x", "k", chi2_sf(F.col("x"), F.col("k")).alias("p")).collect():
        y = r.x / 2
        want = {1: math.erfc(math.sqrt(y)), 2: math.exp(-y), 4: math.exp(-y) * (1 + y)}[r.k]
        assert r.p == pytest.approx(want, rel=1e-9)


def test_chi2_tail_with_very_many_classes(spark):
    """Of an even number of degrees of freedom the tail is a Poisson sum."""
    cases = [(x, k) for k in (2000, 20_000) for x in (0.9 * k, k - 2.0, 1.0 * k, 1.05 * k)]
    for r in spark.createDataFrame(cases, "x double, k int").select("x", "k", chi2_sf(F.col("x"), F.col("k")).alias("p")).collect():
        y = r.x / 2
        want = math.fsum(math.exp(i * math.log(y) - y - math.lgamma(i + 1)) for i in range(r.k // 2))
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-12)


def linear_quantile(values, p):
    values = sorted(values)
    rank = p * (len(values) - 1)
    low = math.floor(rank)
    high = math.ceil(rank)
    return values[low] + (values[high] - values[low]) * (rank - low)


@pytest.mark.parametrize("bracket", [10**6, 50])
def test_quantiles_are_exact(spark, bracket):
    rng = random.Random(7)
    data = [(rng.lognormvariate(0, 3), float(rng.randint(0, 3)), 5.0) for _ in range(20_000)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    from tabscout.functions import quantiles as module

    probs = [0.1, 0.25, 0.5, 0.75, 0.9]
    found = {}
    rows = module.quantiles(
        df, {c: F.col(c) for c in "abc"}, dict.fromkeys("abc", len(data)), probs, bracket
    ).collect()
    for r in rows:
        found[r["feature"], r["prob"]] = r["value"]
    for i, name in enumerate("abc"):
        for p in probs:
            assert found[name, p] == pytest.approx(linear_quantile([d[i] for d in data], p), rel=1e-12)


@pytest.mark.parametrize("bracket", [100_000, 40, 1])
def test_order_statistics_of_odd_columns(spark, bracket):
    """Frequent values side by side, infinities, a huge range, few distinct values, all equal; every rank asked is exact."""
    rng = random.Random(9)
    data = []
    for _ in range(6000):
        tied = rng.choice([0.0, 0.0, 0.0, 1.0, 1.0, 1.0, rng.random(), None])
        wide = rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)
        ends = rng.choice([math.inf, -math.inf, 0.0, 5e-324, 1.5])
        data.append((tied, wide, ends, 7.0, float(rng.randint(0, 1))))
    names = ("tied", "wide", "ends", "same", "two")
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(4)
    columns = {n: sorted(d[i] for d in data if d[i] is not None) for i, n in enumerate(names)}
    ranks = {n: [0, 1, len(c) // 3, len(c) // 2, len(c) // 2 + 1, len(c) - 1] for n, c in columns.items()}
    got = order_statistics(df, {n: F.col(n) for n in names}, ranks, {n: len(c) for n, c in columns.items()}, bracket)
    assert got == {(n, r): columns[n][r] for n in names for r in ranks[n]}


def test_quantiles_take_as_many_jobs_for_200_columns_as_for_5(spark):
    context = spark.sparkContext

    def jobs(width):
        df = spark.range(30_000, numPartitions=4).select(*[F.rand(i).alias(f"c{i}") for i in range(width)])
        names = [f"c{i}" for i in range(width)]
        context.setJobGroup(f"width {width}", "")
        quantile_values(df, {n: F.col(n) for n in names}, dict.fromkeys(names, 30_000), [0.1, 0.5, 0.9], bracket_rows=1000)
        context.setLocalProperty("spark.jobGroup.id", None)
        return len(context.statusTracker().getJobIdsForGroup(f"width {width}"))

    few, many = jobs(5), jobs(200)
    assert few <= 12 and many <= few + 1  # adaptive execution makes a job of every exchange


def test_quantile_values_skip_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double")
    got = quantile_values(df, {"a": F.col("a"), "b": F.col("b")}, {"a": 2, "b": 0}, [0.5])
    assert got == {"a": [2.0]}


@pytest.mark.parametrize("kind", ["smooth", "ties", "tail"])
def test_rank_buckets_hold_a_counted_number_of_rows(spark, kind):
    """Buckets ascend, keep equal values together and are cut until each is small or a single value."""
    draw = {
        "smooth": "rand(1)",
        "ties": "CASE WHEN id % 3 = 0 THEN 5.0 ELSE floor(rand(1) * 2000) END",
        "tail": "pow(10.0, 300 * rand(1) - 150)",
    }[kind]
    rows = spark.range(60_000, numPartitions=4).selectExpr("concat('f', id % 2) AS feature", f"CAST({draw} AS DOUBLE) AS value", "id")
    got = rank_buckets(rows, 100)
    assert got.count() == 60_000
    sizes = got.groupBy("feature", "bucket").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    found = sorted((r.feature, r.bucket, r.n, r.low, r.high) for r in sizes.collect())
    assert all(n <= 100 or low == high for _, _, n, low, high in found)
    for a, b in zip(found, found[1:]):
        assert a[0] != b[0] or a[4] < b[3]


@pytest.mark.parametrize("sigma", [0.2, 3.0])
def test_rank_sums_match_brute_force(spark, sigma):
    rng = random.Random(3)
    # A third of all rows share one value; with the larger sigma the tail is very long.
    rows = [(7.0 if rng.random() < 0.33 else round(rng.lognormvariate(1, sigma), 2), rng.choice("xyz")) for _ in range(3000)]
    df = spark.createDataFrame(rows, "v double, y string")
    got = {
        r["class"]: (r["n"], r["rank_sum"], r["tie_sum"])
        for r in rank_sums(df, [df.schema["v"]], F.col("y")).collect()
    }
    counts = Counter(v for v, _ in rows)
    below, mid = 0, {}
    for v in sorted(counts):
        mid[v] = below + (counts[v] + 1) / 2
        below += counts[v]
    for c in "xyz":
        mine = [v for v, k in rows if k == c]
        assert got[c][0] == len(mine)
        assert got[c][1] == pytest.approx(sum(mid[v] for v in mine))
        assert got[c][2] == pytest.approx(sum(counts[v] ** 2 - 1 for v in mine))


def test_first_by_hash_is_exact_and_independent_of_partitioning(spark):
    import hashlib

    rows = [(i, "hot" if i % 3 else f"g{i % 2}") for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, stratum string")
    quotas = spark.createDataFrame([("hot", 50), ("g0", 10_000), ("g1", 1)], "stratum string, quota bigint")
    picks = [
        {
            (r["stratum"], r["id"])
            for r in first_by_hash(df.repartition(n), F.col("id").cast("string"), quotas, 42, F.col("stratum")).collect()
        }
        for n in (1, 7)
    ]
    want = set()
    for stratum, quota in (("hot", 50), ("g0", 10_000), ("g1", 1)):
        ids = sorted((i for i, s in rows if s == stratum), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        want |= {(stratum, i) for i in ids[:quota]}
    assert picks[0] == picks[1] == want


def test_ordered_buckets_stay_even_on_a_long_tail(spark):
    from tabscout.functions import frequency

    rng = random.Random(5)
    values = [rng.lognormvariate(0, 4) for _ in range(20_000)]
    edges = [sorted(values)[min(len(values) - 1, i * len(values) // 256)] for i in range(257)]
    df = spark.createDataFrame([(v, edges) for v in values[:4000]], "value double, edges array<double>")
    bucket = frequency._below(F.col("value"), F.lit(0), 16) * 16
    counted = df.withColumn("coarse", bucket).withColumn("b", F.col("coarse") + frequency._below(F.col("value"), F.col("coarse"), 1))
    rows = counted.orderBy("value").select("b").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert max(Counter(r.b for r in rows).values()) < 60


def test_hash_sample_of_half_the_rows_keeps_user_columns(spark):
    df = spark.createDataFrame([(i, f"s{i}", i % 5, "q", i) for i in range(4000)], "id int, stratum string, quota int, prefix string, rank int")
    quotas = spark.createDataFrame([(0, 2000)], "stratum int, quota bigint")
    got = first_by_hash(df, F.col("id").cast("string"), quotas, 1, F.lit(0))
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == 2000 and all(r.stratum == f"s{r.id}" and r.quota == r.id % 5 for r in rows)


def test_hash_sample_does_not_shuffle_rows_by_stratum(spark):
    """All rows are of one stratum: the cuts travel to the rows, also where Spark would not broadcast them by itself."""
    df = spark.range(1000).select("id")
    quotas = spark.createDataFrame([(0, 10)], "stratum int, quota bigint")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = first_by_hash(df, F.col("id").cast("string"), quotas, 1, (F.col("id") % 1).cast("int"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and got.count() == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_order_statistics_count_and_do_not_sketch(spark, monkeypatch):
    """NaN is the greatest value, the zeros are one, and no pass over the rows sorts them into a sketch."""

    def sketch(*_):
        raise AssertionError("sketched")

    monkeypatch.setattr(F, "percentile_approx", sketch)
    values = [-math.inf, -1.5, -0.0, 0.0, 5e-324, 0.1, 0.1, 0.2, 1e300, math.inf, math.nan, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values for _ in range(50)], "v double").repartition(3)
    size = 50 * 12
    for bracket in (10, 120, 1000):
        got = order_statistics(df, {"v": F.col("v")}, {"v": range(0, size, 25)}, {"v": size}, bracket)
        assert [repr(got["v", r] + 0.0) for r in range(0, size, 25)] == [repr(values[r // 50] + 0.0) for r in range(0, size, 25)]


def test_order_statistics_cut_between_the_ends_of_a_column(spark, monkeypatch):
    """Rounds cut between the named ends: exact for any column within them, and in fewer rounds."""
    from tabscout.functions import quantiles as module

    rng = random.Random(5)
    data = [(rng.uniform(900, 1000), rng.choice([-1, 1]) * rng.random(), 3.0, rng.choice([math.nan, math.inf, 2.0])) for _ in range(8000)]
    names = ("near", "signed", "same", "odd")
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(3)
    order = {n: sorted((d[i] for d in data), key=lambda x: (math.isnan(x), x)) for i, n in enumerate(names)}
    ranks = {n: [0, 799, 4000, 7999] for n in names}
    ends = {n: (c[-1], c[0], c[4000]) for n, c in order.items()}
    sizes = dict.fromkeys(names, len(data))
    rounds = []
    cut = module._cut
    monkeypatch.setattr(module, "_cut", lambda df, cells, searches, *rest: rounds.append(len(searches)) or cut(df, cells, searches, *rest))
    got = order_statistics(df, {n: F.col(n) for n in names}, ranks, sizes, 10, ends)
    assert {k: repr(v) for k, v in got.items()} == {(n, r): repr(order[n][r]) for n in names for r in ranks[n]}
    rounds.clear()
    order_statistics(df, {"near": F.col("near")}, {"near": [4000]}, sizes, 10, ends)
    assert sum(map(bool, rounds)) == 1
    order_statistics(df, {"same": F.col("same")}, {"same": [4000]}, sizes, 10, ends)
    assert sum(map(bool, rounds)) == 1


def test_bins_of_many_columns_compile(spark):
    """Bins are told by a few comparisons, so that forty columns stay within what the JVM compiles; a null has no bin."""
    from tabscout.operators.binning import bin_number

    edges = [0.5, 1.0, 1.0, 2.5, 4.0, 7.0, 7.5, 8.0, 9.0]
    values = [-math.inf, 0.5, 0.6, 1.0, 1.1, 2.5, 3.0, 7.0, 7.2, 9.0, 9.5, math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [None if v is None else sum(math.isnan(v) or v > e for e in edges) for v in values]
    for some in (edges, edges[:4], edges[:1], []):
        got = [r[0] for r in df.select(bin_number(F.col("v"), some)).collect()]
        assert got == ([0] * len(values) if not some else [None if v is None else sum(math.isnan(v) or v > e for e in some) for v in values])
    assert want[-2] == len(edges)


def test_measures_of_an_empty_table_and_of_odd_names(spark):
    from tabscout.schema import measure_cells

    measures = lambda v: {"n": F.count(v), "most": F.max(v)}
    df = spark.createDataFrame([(1.0, None, 2.0), (3.0, None, math.nan)], "a double, `b.c` double, `value` double")
    cells = {n: F.col(f"`{n}`") for n in df.columns} | {f"x{i}": F.col("a") + i for i in range(6)}
    got = {r.feature: (r.n, r.most) for r in measure_cells(df, cells, measures, "n bigint, most double").collect()}
    assert repr(got.pop("value")) == "(2, nan)"
    assert got == {"a": (2, 3.0), "b.c": (0, None)} | {f"x{i}": (2, 3.0 + i) for i in range(6)}
    assert measure_cells(df.where("a > 5"), cells, measures, "n bigint, most double").collect() == []
