"""Every query with an SQL twin gives the same rows in DuckDB on sf0.001."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
# The rest runs in the driver's own comparison; these cover each kind of work.
SAMPLE = sorted(
    "leak_corr leak_encoded_target contam_exact contam_cosine contam_cosine_rows kruskal missing_chi2 sample_quantile "
    "single_feature_binned redundant_pairs low_information critic_assessment readiness learned_plan threshold_tuning "
    "position_effectiveness contingency_triggers generate_wide".split()
)


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("shared tables not available")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(value):
    return f"{round(value + 0.0, 5):.5f}" if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    want = sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
