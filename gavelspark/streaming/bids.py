"""Bid streams: running state per item, soft-close finalisation, deduplication and windows.

Each operator has a batch twin over the same rows, which is what the oracle queries and the streaming tests compare with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GRACE_MINUTES = 20
EXTEND_MINUTES = 3
RUN_MINUTES = 60
#: How long a closed item is remembered, in minutes of event time.
REMEMBER_MINUTES = 60 * 24 * 30


def event_time(events: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone; the session's is UTC."""
    return events.withColumn(col, F.col(col).cast("timestamp"))


def current_bids(bids: DataFrame) -> DataFrame:
    """Highest bid and number of bids per item; on a stream, in update mode, both only ever grow."""
    return bids.groupBy("item_id").agg(F.max("value").alias("current_bid"), F.count(F.lit(1)).alias("bid_count"))


def dedup_events(events: DataFrame, key: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """First row of each key; on a stream state is kept for the watermark only. Keys that must never repeat go through
    ``watch.notify_once``, which looks them up among all rows sent so far."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return event_time(events).withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def tumbling(events: DataFrame, width: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    rows = event_time(events).withWatermark("ts", watermark)
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "high")


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    out = event_time(events).withWatermark("ts", watermark).groupBy(F.window("ts", width, slide)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "2 hours", watermark: str = "1 hour") -> DataFrame:
    out = event_time(events).withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("stop"), "n")


def over_limit(events: DataFrame, key: str, limit: int, width: str = "1 minute") -> DataFrame:
    """Keys with more than ``limit`` events in a tumbling window."""
    out = event_time(events).withWatermark("ts", width).groupBy(F.window("ts", width), key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    return out.select(key, F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


def soft_close_batch(bids: DataFrame, run: int = RUN_MINUTES, extend: int = EXTEND_MINUTES) -> DataFrame:
    """Final row per item of (item_id, bid_id, value, created_at), all known at once.

    An item opens with its first bid and closes ``run`` minutes later; a bid in the last ``extend`` minutes moves the
    close to ``extend`` minutes after itself; bids after the close do not count. A bid beyond the first close counts iff
    every step from the close's last minutes on is at most ``extend`` minutes, so the chain breaks at the first larger
    gap, which a running window finds without a loop.
    """
    order = Window.partitionBy("item_id").orderBy("created_at", "bid_id")
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = bids.withColumn("t", t).withColumn("close", F.min("t").over(Window.partitionBy("item_id")) + run * 60_000_000)
    reach = extend * 60_000_000
    # the first bid past the close needs a predecessor in reach, and so does every later one
    rows = rows.withColumn("gap", F.col("t") - F.lag("t").over(order))
    broken = (F.col("t") > F.col("close")) & (F.col("gap") > reach)
    counted = rows.withColumn("broken", F.max(broken.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("broken = 0")
    out = counted.groupBy("item_id").agg(F.max("value").alias("final_bid"), F.count(F.lit(1)).alias("bid_count"), F.greatest(F.max("close"), F.max("t") + reach).alias("end"))
    return out.select("item_id", "final_bid", "bid_count", F.timestamp_micros("end").cast("timestamp_ntz").alias("ended_at"))


def _counted(state: tuple, rows: list[tuple], run: int, reach: int) -> tuple[tuple, bool]:
    """(opening, last, high, n) after further bids in time order, and whether one came after the close."""
    opening, last, high, n = state
    for t, _, value in rows:
        if n and t > opening + run and t - last > reach:
            return (opening, last, high, n), True
        opening, last = (opening if n else t), t
        high, n = value if high is None else high if value is None else max(high, value), n + 1
    return (opening, last, high, n), False


def soft_close_stream(bids: DataFrame, run: int = RUN_MINUTES, extend: int = EXTEND_MINUTES, grace: int = GRACE_MINUTES, remember: int = REMEMBER_MINUTES) -> DataFrame:
    """The same on a stream: one row per item, once, when the watermark passes its close. Rows up to ``grace`` minutes
    late are waited for; later ones are dropped.

    State per item: the figures of the bids that the watermark has passed (no earlier one can come any more) and only
    the bids beyond it. A closed item leaves a mark for ``remember`` minutes of event time after its close or its last
    late bid, so that bids after the close neither count nor open the item again.
    """
    run_us, reach_us = run * 60_000_000, extend * 60_000_000

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opening, last, high, n, closed, pending = state.get if state.exists else (None, None, None, 0, False, [])
        if closed and state.hasTimedOut:
            state.remove()
            return
        passed = state.getCurrentWatermarkMs() * 1000
        newest = passed
        rows = [tuple(r) for r in pending]
        for batch in batches:
            micros = batch["created_at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            newest = max([newest, *micros])
            rows += zip(micros, batch["bid_id"].tolist(), batch["value"].tolist())
        if not closed:
            rows.sort(key=lambda r: r[:2])
            known = [r for r in rows if r[0] <= passed]
            rows = rows[len(known) :]
            (opening, last, high, n), closed = _counted((opening, last, high, n), known, run_us, reach_us)
            ahead, _ = _counted((opening, last, high, n), rows, run_us, reach_us)
            end = max(ahead[0] + run_us, ahead[1] + reach_us)
            if closed or end <= passed:
                closed, end = True, max(opening + run_us, last + reach_us)
                yield pd.DataFrame({"item_id": [key[0]], "final_bid": [high], "bid_count": [n], "ended_at": [pd.Timestamp(end, unit="us")]})
        if closed:
            state.update((opening, last, high, n, True, []))
            state.setTimeoutTimestamp(newest // 1000 + remember * 60_000 + 1)
        else:
            state.update((opening, last, high, n, False, rows))
            state.setTimeoutTimestamp(max(end, passed) // 1000 + 1)

    rows = event_time(bids, "created_at").withWatermark("created_at", f"{grace} minutes").select("item_id", "bid_id", "value", "created_at")
    return rows.groupBy("item_id").applyInPandasWithState(
        update,
        "item_id long, final_bid double, bid_count long, ended_at timestamp_ntz",
        "opening bigint, last bigint, high double, n bigint, closed boolean, pending array<struct<t:bigint,bid_id:bigint,value:double>>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
