"""Streams against batches: order of arrival, late and repeated events, restarts."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, day
from tillwork.plans.stream_queries import alerts, ingested
from tillwork.sources.scratch import new_path
from tillwork.sources.star import TABLE_SCHEMAS, Star
from tillwork.streaming import ingest, kpis
from tillwork.streaming.events import (
    beat, drain, drained, read_events, snapshot, upsert, upserted, with_event_time, with_heartbeats,
)


def write_events(spark, path, *rows):
    events = [(i, day(ts), 1, kind, value, "{}") for i, ts, kind, value in rows]
    spark.createDataFrame(events, TABLE_SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return read_events(spark, path, "*.parquet")


def test_stream_is_batch_for_the_closed_days(spark):
    star = Star(spark, SMALL)
    batch = {r["day"]: tuple(r) for r in kpis.daily_kpis(with_event_time(star.table("events"))).collect()}
    streamed = [tuple(r) for r in drained(kpis.daily_kpis(read_events(spark, SMALL)), "kpis").collect()]
    assert len(streamed) >= len(batch) - 2
    assert all(batch[row[0]] == row for row in streamed)


def test_snapshot_has_open_days_and_every_file(spark):
    path = new_path(spark, "parts")
    for hour in (10, 12, 11):
        write_events(spark, f"{path}/events.parquet", (hour, f"2024-01-0{hour - 9} {hour}:00:00", "purchase", 1.0))
    for per_trigger in (1, 1000):
        rows = snapshot(kpis.daily_kpis(read_events(spark, path, files_per_trigger=per_trigger)), "days").collect()
        assert sorted(str(r["day"]) for r in rows) == ["2024-01-01", "2024-01-02", "2024-01-03"]


def test_days_are_held_against_earlier_ones_only(spark):
    rows = [(datetime.date(2024, 1, d), float(d % 2), 1, 1, 1) for d in range(1, 10)]
    rows.append((datetime.date(2024, 1, 10), 100.0, 1, 1, 1))
    days = spark.createDataFrame(rows, "day DATE, revenue DOUBLE, purchases BIGINT, views BIGINT, errors BIGINT")
    (alert,) = kpis.alerts_against_earlier_days(days, 3.0).collect()
    assert alert["day"] == datetime.date(2024, 1, 10) and alert["z_score"] > 100


def test_days_are_utc_days_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        path = new_path(spark, "zone")
        write_events(spark, path, (1, "2024-03-10 02:30:00", "purchase", 1.0),
                     (2, "2024-03-10 23:59:59", "view", 1.0), (3, "2024-03-12 01:30:00", "view", 1.0))
        rows = drained(kpis.daily_kpis(stream(spark, path)), "zone-kpis").collect()
        assert [(r["day"], r["purchases"], r["views"]) for r in rows] == [(datetime.date(2024, 3, 10), 1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_late_events_are_dropped_and_a_restart_goes_on(spark):
    path, out, checkpoint = (new_path(spark, n) for n in ("in", "out", "checkpoint"))
    write_events(spark, path, (1, "2024-01-01 10:00:00", "purchase", 5.0),
                 (2, "2024-01-03 12:00:00", "view", 1.0))
    drain(kpis.daily_kpis(stream(spark, path)), out, checkpoint)
    # The first day is closed; the second batch brings one event too late for it.
    write_events(spark, path, (3, "2024-01-01 11:00:00", "purchase", 7.0),
                 (4, "2024-01-03 13:00:00", "purchase", 2.0), (5, "2024-01-05 00:00:00", "view", 1.0))
    drain(kpis.daily_kpis(stream(spark, path)), out, checkpoint)
    rows = {str(r["day"]): float(r["revenue"]) for r in spark.read.parquet(out).collect()}
    assert rows == {"2024-01-01": 5.0, "2024-01-03": 2.0}


def test_ingest_splits_and_removes_repeats(spark):
    path = new_path(spark, "raw")
    write_events(spark, path, (1, "2024-01-01 10:00:00", "purchase", 5.0),
                 (1, "2024-01-01 10:00:00", "purchase", 5.0), (2, "2024-01-01 10:05:00", "refund", 5.0),
                 (3, "2024-01-01 10:06:00", "view", -1.0), (None, "2024-01-01 10:07:00", "view", 1.0),
                 (None, "2024-01-01 10:08:00", "oops", None))
    valid = drained(ingest.valid_events(stream(spark, path)), "valid").collect()
    assert [r["event_id"] for r in valid] == [1]
    rejected = drained(ingest.rejected_events(stream(spark, path)), "rejected").collect()
    assert sorted(tuple(r["broken_rules"]) for r in rejected) == [
        ("has_id",), ("has_id", "known_type", "valid_value"), ("known_type",), ("valid_value",)]


def test_repeats_are_removed_across_batches(spark):
    path, out, checkpoint = (new_path(spark, n) for n in ("in", "out", "checkpoint"))
    for i in (1, 2):
        write_events(spark, path, (7, "2024-01-01 10:00:00", "purchase", 5.0),
                     (10 + i, f"2024-01-01 10:0{i}:00", "view", 1.0))
        drain(ingest.valid_events(stream(spark, path)), out, checkpoint)
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [7, 11, 12]


def test_alerts(spark):
    rows = [(datetime.date(2024, 1, d), 10.0, 1, 1, 1) for d in range(1, 10)]
    rows.append((datetime.date(2024, 1, 10), 100.0, 1, 1, 1))
    days = spark.createDataFrame(rows, "day DATE, revenue DOUBLE, purchases BIGINT, views BIGINT, errors BIGINT")
    (alert,) = kpis.kpi_alerts(days, kpis.baseline(days), 2.0).collect()
    assert (alert["metric"], alert["direction"]) == ("revenue", "high")
    assert alert["z_score"] == pytest.approx((100 - 19) / 28.46, abs=0.01)
    low = kpis.threshold_alerts(days, "revenue", low=50.0).collect()
    assert len(low) == 9 and low[0]["direction"] == "low"


def test_no_event_is_lost_in_a_backlog_of_many_batches(spark):
    """Part files in shuffled time order, one in each batch, against one batch of all."""
    path = new_path(spark, "backlog")
    for i in (5, 1, 6, 2, 4, 3):
        write_events(spark, f"{path}/events.parquet", (i, f"2024-01-0{i} 10:00:00", "purchase", 5.0),
                     (10 + i, f"2024-01-0{i} 11:00:00", "view", 500.0), (20 + i, f"2024-01-0{i} 12:00:00", "view", 1.0))
    # Repeated in another batch, days behind the latest event.
    write_events(spark, f"{path}/events.parquet", (1, "2024-01-01 10:00:00", "purchase", 5.0))
    for per_trigger in (1, 1000):
        rows = ingested(read_events(spark, path, files_per_trigger=per_trigger)).collect()
        assert sorted((r["event_id"], r["broken_rules"]) for r in rows) == [
            (k + i, "value_in_range" if k == 10 else "") for k in (0, 10, 20) for i in range(1, 7)]
        valid = drained(ingest.valid_events(read_events(spark, path, files_per_trigger=per_trigger)), "valid")
        assert sorted(r["event_id"] for r in valid.collect()) == [k + i for k in (0, 10, 20) for i in range(1, 7)]
        days = snapshot(kpis.daily_kpis(read_events(spark, path, files_per_trigger=per_trigger)), "days").collect()
        assert sorted((r["purchases"], r["views"]) for r in days) == [(1, 2)] * 5 + [(2, 2)]


def test_a_kill_between_the_two_writes_and_a_restart(spark, monkeypatch):
    from pyspark.sql.readwriter import DataFrameWriter

    path, folder = new_path(spark, "killed"), new_path(spark, "ingest")
    for i in range(1, 5):
        # One good event repeated in every file, one of its own, and a bad one twice.
        write_events(spark, path, (7, "2024-01-01 10:00:00", "purchase", 5.0), (10 + i, f"2024-01-0{i} 11:00:00", "view", 1.0),
                     (20 + i, "2024-01-01 10:00:00", "refund", 1.0), (20 + i, "2024-01-01 10:00:00", "refund", 1.0))
    real, killed = DataFrameWriter.parquet, []

    def dying(self, to, *args, **options):
        if "rejected/batch=1" in to and not killed:
            killed.append(to)
            raise RuntimeError("killed")
        return real(self, to, *args, **options)

    def events():
        return read_events(spark, path, "*.parquet", files_per_trigger=1)

    monkeypatch.setattr(DataFrameWriter, "parquet", dying)
    with pytest.raises(Exception, match="killed"):
        ingest.ingest(events(), folder)
    # Its valid part was written; the restart must not add to it.
    assert spark.read.parquet(f"{folder}/valid/batch=1").count() > 0
    valid, rejected = ingest.ingest(events(), folder)
    assert killed and sorted(r["event_id"] for r in valid.collect()) == [7, 11, 12, 13, 14]
    assert sorted(r["event_id"] for r in rejected.collect()) == [21, 21, 22, 22, 23, 23, 24, 24]
    # A file that comes later goes on from there.
    write_events(spark, path, (7, "2024-01-09 10:00:00", "purchase", 5.0), (19, "2024-01-09 11:00:00", "view", 1.0))
    valid, rejected = ingest.ingest(events(), folder)
    assert sorted(r["event_id"] for r in valid.collect()) == [7, 11, 12, 13, 14, 19] and rejected.count() == 8


def test_ingest_of_nothing(spark):
    path = new_path(spark, "nothing")
    write_events(spark, path)
    valid, rejected = ingest.ingest(stream(spark, path), new_path(spark, "ingest"))
    assert valid.count() == rejected.count() == 0 and "broken_rules" in rejected.columns


def test_streams_keep_their_state_in_rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    path, folder = new_path(spark, "state"), new_path(spark, "ingest")
    write_events(spark, path, (1, "2024-01-01 10:00:00", "purchase", 5.0), (2, "2024-01-01 10:00:00", "oops", 5.0))
    ingest.ingest(stream(spark, path), folder)
    held = spark.read.format("statestore").load(f"{folder}/checkpoint")
    assert held.count() == 2
    offsets = spark.read.text(f"{folder}/checkpoint/offsets/0")
    assert offsets.where(F.col("value").contains("RocksDBStateStoreProvider")).count() == 1
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_upsert_replaces_changed_days_and_state_shrinks(spark):
    path, out, checkpoint = (new_path(spark, n) for n in ("in", "kpis", "checkpoint"))

    def run():
        upsert(kpis.daily_kpis(stream(spark, path), "2 days"), out, checkpoint, "day")
        rows = spark.read.parquet(out).select("*", F.col("_metadata.file_name").alias("file")).collect()
        return {str(r["day"]): (float(r["revenue"]), r["file"]) for r in rows}

    write_events(spark, path, (1, "2024-01-01 10:00:00", "purchase", 5.0), (2, "2024-01-02 12:00:00", "purchase", 1.0))
    first = run()
    assert {d: v for d, (v, _) in first.items()} == {"2024-01-01": 5.0, "2024-01-02": 1.0}
    # A late event within the watermark changes its day only.
    write_events(spark, path, (3, "2024-01-01 11:00:00", "purchase", 7.0), (4, "2024-01-03 13:00:00", "purchase", 2.0))
    second = run()
    assert {d: v for d, (v, _) in second.items()} == {"2024-01-01": 12.0, "2024-01-02": 1.0, "2024-01-03": 2.0}
    assert second["2024-01-02"] == first["2024-01-02"] and second["2024-01-01"] != first["2024-01-01"]
    write_events(spark, path, (5, "2024-02-01 00:00:00", "view", 1.0))
    assert set(run()) == {*second, "2024-02-01"}
    assert spark.read.format("statestore").load(checkpoint).count() == 1


def many_days(spark, path):
    """A file for each of 20 days, in shuffled order."""
    for i in [7, 3, 20, 1, 15, 9, 2, 18, 4, 12, 6, 10, 5, 19, 8, 11, 13, 17, 14, 16]:
        write_events(spark, f"{path}/events.parquet", *(
            (100 * i + k, f"2024-01-{i:02d} 1{k}:00:00", ("purchase", "view", "error")[(i + k) % 3], float(i * i % 17))
            for k in range(1 + i % 5)))


def test_alerts_of_a_stream_are_those_of_the_batch(spark):
    path = new_path(spark, "days")
    many_days(spark, path)
    table = spark.read.schema(TABLE_SCHEMAS["events"]).parquet(f"{path}/events.parquet")
    days = kpis.daily_kpis(with_event_time(table))
    expected = kpis.alerts_against_earlier_days(days, 1.5).collect()
    rounded = sorted((str(r["day"]), r["metric"], r["value"], round(r["z_score"], 9), r["direction"]) for r in expected)
    assert rounded
    for per_trigger in (1, 1000):
        found = alerts(read_events(spark, path, files_per_trigger=per_trigger), table).collect()
        assert rounded == sorted(
            (str(r["day"]), r["metric"], r["value"], round(r["z_score"], 9), r["direction"]) for r in found)
    upserts = upserted(kpis.daily_kpis(read_events(spark, path, files_per_trigger=3), "90 days"), "kpis", "day")
    assert sorted(map(tuple, upserts.collect())) == sorted(map(tuple, days.collect()))


def test_alerts_go_on_from_their_state(spark):
    path, folder = new_path(spark, "days"), new_path(spark, "alerts")
    for i in range(1, 8):
        write_events(spark, path, (i, f"2024-01-0{i} 10:00:00", "purchase", 5.0 + i % 2))
    assert kpis.drain_alerts(stream(spark, path), folder).count() == 0
    write_events(spark, path, (8, "2024-01-08 10:00:00", "purchase", 50.0), (9, "2024-01-10 10:00:00", "view", 1.0))
    found = kpis.drain_alerts(stream(spark, path), folder)
    assert [(str(r["day"]), r["metric"], r["direction"]) for r in found.collect()] == [("2024-01-08", "revenue", "high")]
    kpis.drain_alerts(stream(spark, path), folder)
    assert found.count() == 1


def test_heartbeats_close_days_and_are_none(spark):
    path, folder, out, checkpoint = (new_path(spark, n) for n in ("in", "beats", "out", "checkpoint"))
    write_events(spark, path, (1, "2024-01-01 10:00:00", "purchase", 5.0), (2, "2024-01-01 11:00:00", None, 5.0))
    days = kpis.daily_kpis(with_heartbeats(stream(spark, path), folder))
    drain(days, out, checkpoint)
    assert spark.read.schema(days.schema).parquet(out).count() == 0
    for at in ("2024-01-02 02:00:00", "2024-01-09 00:00:00"):
        beat(spark, folder, day(at))
        drain(days, out, checkpoint)
    assert [(str(r["day"]), r["purchases"]) for r in spark.read.parquet(out).collect()] == [("2024-01-01", 1)]
