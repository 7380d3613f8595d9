"""Streams against their batch twins over the same files."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gavelspark.plans.adapt import bids
from gavelspark.streaming import bids as B
from gavelspark.streaming import watch

from .support import SMALL, rows_of


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Events in time order over several files, then one far ahead that pushes the watermark past all windows."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts")
    rows = events.collect()
    size = len(rows) // 4 + 1
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], events.schema).coalesce(1).write.mode("append").parquet(folder)
    late = rows[-1].asDict() | {"event_id": -1, "user_id": -1, "ts": rows[-1].ts.replace(year=2030)}
    spark.createDataFrame([late], events.schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, events.schema


def run(spark, files, make, name, tmp_path, mode="append"):
    folder, schema = files
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    query = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def same(got, want):
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect())


@pytest.mark.parametrize("name,make,own", [
    ("s_tumbling", lambda e: B.tumbling(e), "start < '2030-01-01'"),
    ("s_sliding", lambda e: B.sliding(e), "start < '2029-12-31'"),
    ("s_sessions", lambda e: B.sessions(e), "user_id >= 0"),
])
def test_windows(spark, files, tmp_path, name, make, own):
    got = run(spark, files, make, name, tmp_path)
    same(got.filter(own), make(spark.read.parquet(files[0])).filter(own))


def test_dedup(spark, files, tmp_path):
    got = run(spark, files, lambda e: B.dedup_events(e.unionByName(e)), "s_dedup", tmp_path)
    assert got.count() == spark.read.parquet(files[0]).count()


def test_running_bids(spark, files, tmp_path):
    as_bids = lambda e: e.select(F.col("user_id").alias("item_id"), "value")
    got = run(spark, files, lambda e: B.current_bids(as_bids(e)), "s_bids", tmp_path, "update")
    last = got.groupBy("item_id").agg(F.max("current_bid").alias("current_bid"), F.max("bid_count").alias("bid_count"))
    same(last, B.current_bids(as_bids(spark.read.parquet(files[0]))))


def test_soft_close(spark, files, tmp_path):
    as_bids = lambda e: e.filter("user_id >= 0 OR user_id = -1").select(F.col("event_id").alias("bid_id"), F.col("user_id").alias("item_id"), "value", F.col("ts").alias("created_at"))
    kw = {"run": 60 * 24 * 40, "extend": 240}
    got = run(spark, files, lambda e: B.soft_close_stream(as_bids(e), **kw), "s_close", tmp_path)
    same(got.filter("item_id >= 0"), B.soft_close_batch(as_bids(spark.read.parquet(files[0])), **kw).filter("item_id >= 0"))


def test_soft_close_stream_with_late_bids_and_bids_after_the_close(spark, tmp_path):
    """Bids in other order than their times, over many files, with several after the close: one row for each item, the
    batch twin's; a closed item is not opened again."""
    files = [
        [(1, 1, 10.0, "10:00"), (2, 2, 5.0, "10:00"), (3, 3, 7.0, "10:10")],
        [(4, 1, 20.0, "10:30"), (5, 2, 6.0, "11:01")],
        [(6, 2, 8.0, "10:55"), (7, 1, 15.0, "10:20"), (8, 3, 9.0, "11:12")],
        [(9, 2, 9.0, "11:03"), (10, 3, 11.0, "11:09")],
        [(11, 9, 1.0, "12:00")],
        [(12, 9, 2.0, "12:30")],
        [(13, 1, 99.0, "15:00"), (14, 2, 98.0, "12:40"), (15, 9, 3.0, "15:00")],
        [(16, 1, 97.0, "19:00"), (17, 3, 96.0, "20:00"), (18, 9, 4.0, "21:00")],
        [(19, 8, 1.0, "23:00")],
    ]
    folder, all_rows = tmp_path / "bids", []
    schema = "bid_id long, item_id long, value double, created_at timestamp_ntz"
    make = lambda rows: spark.createDataFrame([(b, i, v, datetime.fromisoformat(f"2024-01-01 {t}:00")) for b, i, v, t in rows], schema)
    for k, rows in enumerate(files):
        make(rows).coalesce(1).write.mode("append").parquet(str(folder))
        all_rows += rows
        written = max(folder.glob("part-*"), key=lambda p: p.stat().st_mtime_ns)
        os.utime(written, (10**9 + k, 10**9 + k))
    got = run(spark, (str(folder), schema), B.soft_close_stream, "s_late", tmp_path / "state")
    want = B.soft_close_batch(make(all_rows))
    assert {r.item_id for r in got.collect()} == {1, 2, 3, 9}
    same(got, want.filter("item_id != 8"))
    assert {r.item_id: (r.final_bid, r.bid_count) for r in want.collect()}[1] == (20.0, 3)


def test_soft_close_extends_and_ends(spark):
    rows = [(1, 7, 10.0, "2024-01-01 10:00:00"), (2, 7, 12.0, "2024-01-01 10:59:00"), (3, 7, 15.0, "2024-01-01 11:01:30"), (4, 7, 99.0, "2024-01-01 11:05:00"), (5, 8, 1.0, "2024-01-01 10:00:00")]
    df = spark.createDataFrame(rows, "bid_id long, item_id long, value double, t string").selectExpr("bid_id", "item_id", "value", "CAST(t AS TIMESTAMP_NTZ) AS created_at")
    got = {r.item_id: (r.final_bid, r.bid_count, r.ended_at.strftime("%H:%M:%S")) for r in B.soft_close_batch(df).collect()}
    assert got == {7: (15.0, 3, "11:04:30"), 8: (1.0, 1, "11:00:00")}


def test_transitions_fire_once(spark):
    schema = "house string, external_id string, status string, reserve_status string, ends_at timestamp_ntz, soon_sent boolean"
    at = lambda t: f"CAST('2026-01-01 {t}' AS TIMESTAMP_NTZ)"
    make = lambda rows: spark.createDataFrame([(h, i, s, r, None, x) for h, i, s, r, _, x in rows], schema).drop("ends_at").join(spark.createDataFrame([(i, e) for _, i, _, _, e, _ in rows], "external_id string, e string"), "external_id").withColumn("ends_at", F.to_timestamp_ntz("e")).drop("e")
    before = make([("h", "a", "active", "not_met", "2026-01-01 12:00:00", False), ("h", "b", "active", "met", "2026-01-01 12:00:00", True)])
    after = make([("h", "a", "active", "met", "2026-01-01 12:00:00", False), ("h", "b", "ended", "met", "2026-01-01 12:00:00", True), ("h", "c", "ended", "met", "2026-01-01 12:00:00", True)])
    told = watch.transitions(before, after, F.expr(at("11:30:00")), ["house", "external_id"])
    assert sorted(r.dedup_key for r in told.collect()) == ["h:a:ending_soon", "h:a:reserve_met", "h:b:ended"]


def test_sink_sends_once_even_when_replayed(spark, tmp_path):
    path = str(tmp_path / "sent")
    write = watch.notify_once(spark, path, "dedup_key string")
    batch = lambda *keys: spark.createDataFrame([(k,) for k in keys], "dedup_key string")
    write(batch("a", "b", "b"), 0)
    write(batch("b", "c"), 1)
    write(batch("b", "c"), 1)
    assert sorted(r.dedup_key for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
