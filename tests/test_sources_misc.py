"""Dataset publish, audit append/release, series table."""

import datetime as dt

import pytest

from tallyhouse.operators import audit, series
from tallyhouse.sources.operational_store import LoadRefused, current_tables, publish_dataset

def test_publish_dataset(spark, scratch, f1):
    with pytest.raises(LoadRefused):
        publish_dataset(spark, f1, scratch, environment="production")
    bad = spark.createDataFrame([("quantity_positive", 1)], "rule string, affected long")
    with pytest.raises(LoadRefused):
        publish_dataset(spark, f1, scratch, validation=bad)
    assert current_tables(spark, scratch) is None
    publish_dataset(spark, f1, scratch)
    assert current_tables(spark, scratch)["order_items"].count() == 4


def test_append_and_release_stale(spark, scratch):
    t0 = dt.datetime(2026, 5, 3, 10, 0, 0)
    log = scratch + "/audit"
    audit.append_events(audit.event(spark, "r1", "running", t0), log)
    audit.append_events(audit.event(spark, "r2", "running", t0 + dt.timedelta(hours=5)), log)
    events = spark.read.parquet(log)
    released = audit.release_stale_runs(events, t0 + dt.timedelta(hours=6), dt.timedelta(hours=2))
    assert [r.run_id for r in released.collect()] == ["r1"]
    audit.append_events(released, log)
    states = {r.run_id: r.status for r in audit.run_state(spark.read.parquet(log)).collect()}
    assert states == {"r1": "failed", "r2": "running"}


def test_series_table(spark):
    df = spark.createDataFrame([(f"2026-01-{d:02d}", float(d)) for d in range(1, 31)] * 3,
                               "date string, revenue double")
    assert series.series_table(df).count() == 60


def test_edge_text_ignores_session_time_zone(spark):
    """Wall-clock times keep their text (even inside a daylight-saving gap of
    the session zone); instants are rendered in UTC."""
    from tallyhouse.functions.edge import to_edge
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.sql("SELECT timestamp_ntz'1995-04-02 02:21:00' AS w, "
                       "timestamp'2024-01-01 00:00:07.5Z' AS i, "
                       "timestamp'1969-12-31 23:59:59Z' AS e, "
                       "CAST(NULL AS TIMESTAMP) AS n")
        r = to_edge(df).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert (r.w, r.i, r.e, r.n) == ("1995-04-02 02:21:00", "2024-01-01 00:00:07",
                                    "1969-12-31 23:59:59", None)
