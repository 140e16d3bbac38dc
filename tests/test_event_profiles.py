"""Profiles derived from days whose amounts are all 0, or at most 0, against the SQL twins."""

import datetime as dt

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
NAMES = (
    "audit_performance check_plan best_sequences fleet_types history_round_trip learned_boosts learned_plan mean_effectiveness "
    "mined_patterns position_effectiveness profile_variety relevance_scores similar_effectiveness strategy_effectiveness tool_ranking"
).split()


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("zero"))
    days = [
        (1, [("view", 0.0)]),
        (1, [("click", 0.004), ("error", 0.0)]),
        (1, [("view", 30.0), ("error", 120.0)]),
        (2, [("error", -2.0), ("click", 0.0)]),
        (2, [("purchase", 200.0)]),
        (2, [("signup", None)]),
        (3, [("signup", 0.0)]),
    ]
    rows = [
        (10 * i + j, dt.datetime(2024, 3, 1 + i, 10, j), user, kind, value, "{}")
        for i, (user, day) in enumerate(days)
        for j, (kind, value) in enumerate(day)
    ]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def normal(value):
    return f"{round(value + 0.0, 5):.5f}" if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_days_without_amounts(spark, events, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{events}/events.parquet/*.parquet'")
    df = entry.queries()[name](spark, events)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
