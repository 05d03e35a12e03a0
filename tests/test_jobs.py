"""Queries over jobs on made events, against their SQL."""

import datetime as dt

import duckdb

from placeflow import plans


def test_sweep_rounds_minutes_half_to_even(spark, tmp_path):
    """Jobs of the last half hour, whose minutes decide by their fraction."""
    now = dt.datetime(2024, 1, 15)
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    values = (6.4, 6.5, 6.6, 7.0, 7.5, 7.6, 8.5, 0.5, 29.9)
    rows = [(i * 100 + s, now - dt.timedelta(minutes=9, seconds=30 * s), 1, "view", v) for i, v in enumerate(values) for s in range(6)]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = sorted(r[0] for r in con.execute(plans.ORACLE["job_sweep"]).fetchall())
    assert sorted(r.job_id for r in plans.QUERIES["job_sweep"](spark, str(tmp_path)).collect()) == want
    assert 0 < len(want) < len(rows)


def test_stage_failures_once_each_without_pairs(spark):
    """Equal failures go before they are gathered; array_distinct compares every pair of a job's."""
    from placeflow.operators import jobs as J

    rows = [("J1", "b", "timeout", 2), ("J1", "a", "x" * 600, 2), ("J1", "a", "x" * 600, 2), ("J1", "a", None, 1), ("J1", "a", None, 1), ("J1", None, "x", None), ("J2", "a", "x" * 501, 3), ("J2", "a", "x" * 502, 3)]
    out = J.stage_failures(spark.createDataFrame(rows, "job_id string, stage string, message string, at long"))
    assert "array_distinct" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.job_id: [(f.at, f.stage, f.message) for f in r.failures] for r in out.collect()}
    assert got == {"J1": [(None, None, "x"), (1, "a", None), (2, "a", "x" * 500), (2, "b", "timeout")], "J2": [(3, "a", "x" * 500)]}


def test_a_page_is_cleaned_once(spark):
    from pyspark.sql import functions as F

    from placeflow.functions import taxonomy as T

    rows = spark.createDataFrame([("Joe", "12 Main Street", 101, 1, "Joe's on main", "", "yelp"), ("Joe", "12 Main Street", 1, 2, "x", "by the STREET", "blog"), ("Joe", None, 1, 0, "Joe", "", "yelp")], "n string, a string, r long, k long, t string, d string, s string")
    score = rows.select(T.confidence(*map(F.col, "narktds"[:4]), F.col("t"), F.col("d"), F.col("s")).alias("x"))
    assert [r.x for r in score.collect()] == [100, 20, 0]
    shown = score._jdf.queryExecution().analyzed().toString()
    assert shown.count("coalesce(t#") == 1 and shown.count("coalesce(d#") == 1
