"""Operators with state by key: news of watched lots, and sweeps that end what they no longer see.

Both hold their rows until the watermark has passed them, so rows that come late or in another order give the same
result, and a restart goes on from the state. Each has a batch twin over the same rows. The state lives in RocksDB
(``STATE_STORE``), which appends to lists and maps without reading them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SOON_MINUTES, LATE_MINUTES = 65, 20
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NEWS = "house string, external_id string, event string, told_at timestamp_ntz, dedup_key string"
KEY = ["house", "external_id"]


def with_state_store(spark: SparkSession) -> SparkSession:
    """The state store that these operators need; Spark reads the option when a stream starts."""
    spark.conf.set(*STATE_STORE)
    return spark


def _micros(values: pd.Series) -> list[int]:
    return values.to_numpy().astype("datetime64[us]").astype("int64").tolist()


class News(StatefulProcessor):
    """For one watched lot: which news it has given, its present state and the rows that the watermark has not passed.

    ``ending_soon`` is not bound to a row: a timer fires it once the watermark comes within ``soon`` minutes of the end,
    so a lot that nobody bids on is told too. A row that moves the end or closes the lot sets the timer anew.
    """

    def __init__(self, soon: int) -> None:
        self.soon = soon * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "soon boolean, reserve boolean, ended boolean")
        self.now = handle.getValueState("now", "status string, ends_at bigint, since bigint")
        self.ahead = handle.getListState("ahead", "t bigint, n bigint, status string, reserve_status string, ends_at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: list[tuple] = []
        for batch in rows:
            if not self.told.exists():
                first = batch.iloc[0]
                self.told.update((False, bool(first.notified_reserve), bool(first.notified_ended)))
            ends = [None if pd.isna(e) else int(m) for e, m in zip(batch["ends_at"], _micros(batch["ends_at"]))]
            new += zip(_micros(batch["observed_at"]), batch["seq"].tolist(), batch["status"].tolist(), batch["reserve_status"].tolist(), ends)
        self.ahead.appendList(new)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._advance(key, passed)
        self._wake(passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._advance(key, passed)
        self._wake(passed)

    def _advance(self, key, passed: int) -> Iterator[pd.DataFrame]:
        """News of everything up to the watermark, in the order of time."""
        rows = sorted(tuple(r) for r in self.ahead.get()) if self.ahead.exists() else []
        known = [r for r in rows if r[0] <= passed]
        soon, reserve, ended = self.told.get()
        status, ends, since = self.now.get() if self.now.exists() else (None, None, 0)
        out: list[tuple[str, int]] = []

        def near(start: int, stop: int) -> None:
            """The lot was as it is from ``start`` to before ``stop``."""
            nonlocal soon
            if not soon and status == "active" and ends is not None:
                at = max(start, ends - self.soon)
                if at < stop and at <= ends:
                    soon = True
                    out.append(("ending_soon", at))

        for t, _, row_status, reserve_status, row_ends in known:
            near(since, t)
            status, ends, since = row_status, row_ends, t
            if reserve_status == "met" and not reserve:
                reserve = True
                out.append(("reserve_met", t))
            if status == "ended" and not ended:
                ended = True
                out.append(("ended", t))
        # rows that come later may still bear an earlier time than this, but not one the watermark has passed
        near(since, passed + 1)
        self.told.update((soon, reserve, ended))
        if status is not None:
            self.now.update((status, ends, since))
        if known:
            left = rows[len(known) :]
            if left:
                self.ahead.put(left)
            else:
                self.ahead.clear()
        if out:
            house, external_id = key
            yield pd.DataFrame([(house, external_id, event, pd.Timestamp(at, unit="us"), f"{event}:{house}:{external_id}") for event, at in out], columns=["house", "external_id", "event", "told_at", "dedup_key"])

    def _wake(self, passed: int) -> None:
        """One timer: at the next row that waits, or when the end comes near."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [r[0] for r in self.ahead.get()] if self.ahead.exists() else []
        if self.now.exists():
            status, ends, _ = self.now.get()
            if status == "active" and ends is not None and not self.told.get()[0] and ends - self.soon > passed:
                times.append(ends - self.soon)
        if times:
            self.handle.registerTimer(-(-min(times) // 1000))

    def close(self) -> None:
        pass


def _watched(states: DataFrame, watches: DataFrame) -> DataFrame:
    told = watches.select(*KEY, "notified_reserve", "notified_ended")
    return states.select(*KEY, "seq", "status", "reserve_status", "ends_at", "observed_at").join(told, KEY)


def watch_news(states: DataFrame, watches: DataFrame, soon: int = SOON_MINUTES, late: int = LATE_MINUTES) -> DataFrame:
    """(house, external_id, event, told_at, dedup_key) from a stream of lot states, each news once a watch: ``ending_soon``,
    ``reserve_met``, ``ended``. ``states``: key, seq (order of rows of one time), status, reserve_status, ends_at,
    observed_at; ``watches`` as ``watch.new_watches`` gives them. Rows over ``late`` minutes late are dropped."""
    with_state_store(states.sparkSession)
    timed = _watched(states, watches).withColumn("observed_at", F.col("observed_at").cast("timestamp")).withColumn("ends_at", F.col("ends_at").cast("timestamp"))
    rows = timed.withWatermark("observed_at", f"{late} minutes").groupBy(*KEY)
    return rows.transformWithStateInPandas(News(soon), NEWS, "Append", "EventTime")


def watch_news_batch(states: DataFrame, watches: DataFrame, upto: Column, soon: int = SOON_MINUTES) -> DataFrame:
    """The same over rows that are all known, as of a time that the watermark has reached."""
    order = Window.partitionBy(*KEY).orderBy("observed_at", "seq")
    rows = _watched(states.filter(F.col("observed_at") <= upto), watches).withColumn("until", F.least(F.coalesce(F.lead("observed_at").over(order), upto), upto))
    at = F.greatest(F.col("observed_at"), F.col("ends_at") - F.expr(f"INTERVAL {soon} MINUTES"))
    last = F.lead("observed_at").over(order).isNull()
    rows = rows.withColumns({"last": last, "soon_at": at})
    at = F.col("soon_at")
    near = (F.col("status") == "active") & (at <= F.col("ends_at")) & ((at < F.col("until")) | (F.col("last") & (at <= upto)))
    told = F.array_compact(
        F.array(
            F.when(near, F.struct(F.lit("ending_soon").alias("event"), at.alias("at"))),
            F.when((F.col("reserve_status") == "met") & ~F.col("notified_reserve"), F.struct(F.lit("reserve_met").alias("event"), F.col("observed_at").alias("at"))),
            F.when((F.col("status") == "ended") & ~F.col("notified_ended"), F.struct(F.lit("ended").alias("event"), F.col("observed_at").alias("at"))),
        )
    )
    found = rows.select(*KEY, F.explode(told).alias("x")).groupBy(*KEY, F.col("x.event").alias("event")).agg(F.min("x.at").alias("told_at"))
    return found.withColumn("dedup_key", F.concat_ws(":", "event", *KEY))


class Sweep(StatefulProcessor):
    """For one bucket of a house's lots: the last sweep that saw each lot, and which lots are over.

    Rows and marks are held until the watermark has passed them. A mark of a complete sweep ends the active lots that it
    did not see; an aborted sweep has no mark and ends nothing; a lot that is seen again is active again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "external_id string", "sweep bigint, over boolean")
        self.ahead = handle.getListState("ahead", "t bigint, mark boolean, sweep bigint, external_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            ids = [None if m else i for m, i in zip(batch["mark"].tolist(), batch["external_id"].tolist())]
            self.ahead.appendList(list(zip(_micros(batch["seen_at"]), batch["mark"].tolist(), batch["sweep"].tolist(), ids)))
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _advance(self, key, passed: int) -> Iterator[pd.DataFrame]:
        rows = sorted((tuple(r) for r in self.ahead.get()), key=lambda r: r[:3]) if self.ahead.exists() else []
        known = [r for r in rows if r[0] <= passed]
        out = []
        for t, mark, sweep, external_id in known:
            if not mark:
                self.seen.updateValue((external_id,), (sweep, False))
                continue
            for (lot,), (last, over) in list(self.seen.iterator()):
                if last < sweep and not over:
                    self.seen.updateValue((lot,), (last, True))
                    out.append((key[0], lot, sweep, pd.Timestamp(t, unit="us")))
        if known:
            left = rows[len(known) :]
            if left:
                self.ahead.put(left)
            else:
                self.ahead.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(rows) > len(known):
            self.handle.registerTimer(-(-rows[len(known)][0] // 1000))
        if out:
            yield pd.DataFrame(out, columns=["house", "external_id", "sweep", "ended_at"])

    def close(self) -> None:
        pass


BUCKETS = 64
ENDED = "house string, external_id string, sweep long, ended_at timestamp_ntz"


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by a hash of the lot; a mark goes to every bucket of its house, so no task holds a whole house."""
    own = F.array(F.pmod(F.xxhash64("external_id"), F.lit(buckets)))
    return rows.withColumn("bucket", F.explode(F.when(F.col("mark"), F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<bigint>")).otherwise(own)))


def stale_sweep(rows: DataFrame, buckets: int = BUCKETS, late: int = LATE_MINUTES) -> DataFrame:
    """(house, external_id, sweep, ended_at) for lots that a complete sweep no longer saw, from a stream of (house,
    external_id, sweep, mark, seen_at). A row is a lot that a sweep saw; one with ``mark`` says that the sweep is
    complete and comes after its rows by ``seen_at``."""
    with_state_store(rows.sparkSession)
    timed = _in_buckets(rows.select("house", "external_id", F.col("sweep").cast("long"), F.coalesce("mark", F.lit(False)).alias("mark"), F.col("seen_at").cast("timestamp")), buckets)
    grouped = timed.withWatermark("seen_at", f"{late} minutes").groupBy("house", "bucket")
    return grouped.transformWithStateInPandas(Sweep(), ENDED, "Append", "EventTime")


def stale_sweep_batch(rows: DataFrame) -> DataFrame:
    """The same over rows that are all known: a lot ends with the first complete sweep after one that saw it and before
    the next that sees it."""
    order = Window.partitionBy("house", "external_id").orderBy("seen_at", "sweep")
    spans = rows.filter(~F.coalesce("mark", F.lit(False))).select("house", "external_id", F.col("sweep").alias("of"), "seen_at", F.lead("seen_at").over(order).alias("next"))
    # a house has few complete sweeps, so each span looks its first one up in the house's list
    marks = rows.filter("mark").groupBy("house").agg(F.sort_array(F.collect_list(F.struct(F.col("seen_at").alias("at"), "sweep"))).alias("marks"))
    ends = lambda m: (m["at"] >= F.col("seen_at")) & (m["sweep"] > F.col("of")) & (F.col("next").isNull() | (m["at"] < F.col("next")))
    found = spans.join(marks, "house").withColumn("x", F.get(F.filter("marks", ends), F.lit(0)))
    return found.filter(F.col("x").isNotNull()).select("house", "external_id", F.col("x.sweep").cast("long").alias("sweep"), F.col("x.at").alias("ended_at"))
