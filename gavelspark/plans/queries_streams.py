"""Streams replayed over the events, each with its batch twin and the SQL that both must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..streaming import keyed, watch
from ..streaming.replay import replayed
from .adapt import table
from .registry import query

_STATES_SQL = """states AS (
  SELECT 'h' || user_id % 5 AS house, user_id::VARCHAR AS external_id, event_id AS seq, CASE WHEN event_id % 41 = 0 THEN 'ended' ELSE 'active' END AS status,
         CASE WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'met' ELSE 'not_met' END AS reserve_status,
         CASE WHEN event_id % 50 <> 7 THEN ts + to_minutes(event_id % 3000) END AS ends_at, ts AS observed_at
  FROM events WHERE user_id % 3 <> 0),
upto AS (SELECT date_trunc('milliseconds', max(observed_at)) - INTERVAL 20 MINUTE AS upto FROM states),
rows_ AS (SELECT s.*, upto, external_id::BIGINT % 7 = 0 AS notified_reserve, external_id::BIGINT % 11 = 0 AS notified_ended,
                 lead(observed_at) OVER (PARTITION BY house, external_id ORDER BY observed_at, seq) AS next FROM states s, upto WHERE observed_at <= upto)"""
_NEWS_SQL = f"""WITH {_STATES_SQL},
found AS (
  SELECT house, external_id, 'ending_soon' AS event, greatest(observed_at, ends_at - INTERVAL 65 MINUTE) AS told_at FROM rows_
  WHERE status = 'active' AND ends_at IS NOT NULL AND greatest(observed_at, ends_at - INTERVAL 65 MINUTE) <= ends_at
    AND CASE WHEN next IS NULL THEN greatest(observed_at, ends_at - INTERVAL 65 MINUTE) <= upto ELSE greatest(observed_at, ends_at - INTERVAL 65 MINUTE) < next END
  UNION ALL SELECT house, external_id, 'reserve_met', observed_at FROM rows_ WHERE reserve_status = 'met' AND NOT notified_reserve
  UNION ALL SELECT house, external_id, 'ended', observed_at FROM rows_ WHERE status = 'ended' AND NOT notified_ended)
SELECT house, external_id, event, min(told_at) AS told_at, event || ':' || house || ':' || external_id AS dedup_key FROM found GROUP BY house, external_id, event"""


def lot_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(states of lots over time, watches): each user's events are one lot's, two thirds of them are watched."""
    e, c = table(spark, sf_dir, "events"), F.col
    states = e.select(
        F.concat(F.lit("h"), c("user_id") % 5).alias("house"), c("user_id").cast("string").alias("external_id"), c("event_id").alias("seq"), F.when(c("event_id") % 41 == 0, "ended").otherwise("active").alias("status"),
        F.when((c("event_type") == "purchase") & (c("event_id") % 5 == 0), "met").otherwise("not_met").alias("reserve_status"),
        F.when(c("event_id") % 50 != 7, c("ts") + F.make_dt_interval(mins=(c("event_id") % 3000).cast("int"))).alias("ends_at"), c("ts").alias("observed_at"))
    lot = c("external_id").cast("long")
    watches = states.select("house", "external_id").distinct().filter(lot % 3 != 0)
    return states, watches.withColumns({"notified_reserve": lot % 7 == 0, "notified_ended": lot % 11 == 0})


@query("watch_news", _NEWS_SQL)
def watch_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, watches = lot_states(spark, sf_dir)
    # what the watermark has passed at the end of the table
    last = states.join(watches, keyed.KEY, "left_semi").agg((F.date_trunc("millisecond", F.max("observed_at").cast("timestamp")) - F.expr("INTERVAL 20 MINUTES")).cast("timestamp_ntz").alias("upto")).first()[0]
    return keyed.watch_news_batch(states, watches, F.lit(last).cast("timestamp_ntz"))


@query("watch_news_stream", _NEWS_SQL)
def watch_news_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same news from a stream with state and timers by lot, three batches of events."""
    states, watches = lot_states(spark, sf_dir)
    return replayed(states, "observed_at", lambda s: keyed.watch_news(s, watches))


_SWEEPS_SQL = """seen AS (
  SELECT 'h' || user_id % 3 AS house, (user_id // 3 % 400)::VARCHAR AS external_id, date_part('day', ts)::BIGINT AS sweep, ts AS seen_at FROM events
  WHERE event_id % 3 = 0 AND (user_id + date_part('day', ts)) % 4 <> 0),
marks AS (SELECT house, sweep, max(seen_at) + INTERVAL 1 SECOND AS marked_at FROM seen WHERE sweep % 5 <> 2 GROUP BY house, sweep)"""
_STALE_SQL = f"""WITH {_SWEEPS_SQL},
upto AS (SELECT date_trunc('milliseconds', greatest((SELECT max(seen_at) FROM seen), (SELECT max(marked_at) FROM marks))) - INTERVAL 20 MINUTE AS upto),
spans AS (SELECT *, lead(seen_at) OVER (PARTITION BY house, external_id ORDER BY seen_at, sweep) AS next FROM seen, upto WHERE seen_at <= upto),
ended AS (SELECT s.house, s.external_id, s.seen_at, m.sweep, m.marked_at, row_number() OVER (PARTITION BY s.house, s.external_id, s.seen_at ORDER BY m.marked_at) AS n
          FROM spans s JOIN marks m ON m.house = s.house AND m.marked_at >= s.seen_at AND m.sweep > s.sweep AND (s.next IS NULL OR m.marked_at < s.next) AND m.marked_at <= s.upto)
SELECT house, external_id, sweep, marked_at AS ended_at FROM ended WHERE n = 1"""


def sweeps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What daily sweeps saw: lots of three houses, some missing each day; every fifth sweep is broken off and has no mark."""
    e, c = table(spark, sf_dir, "events").filter("event_id % 3 = 0"), F.col
    day = F.dayofmonth("ts").cast("long")
    seen = e.filter((c("user_id") + day) % 4 != 0).select(F.concat(F.lit("h"), c("user_id") % 3).alias("house"), F.expr("CAST(user_id DIV 3 % 400 AS STRING)").alias("external_id"), day.alias("sweep"), F.lit(False).alias("mark"), c("ts").alias("seen_at"))
    marks = seen.filter("sweep % 5 != 2").groupBy("house", "sweep").agg((F.max("seen_at") + F.expr("INTERVAL 1 SECOND")).alias("seen_at"))
    return seen.unionByName(marks.select("house", F.lit(None).cast("string").alias("external_id"), "sweep", F.lit(True).alias("mark"), "seen_at"))


@query("stale_sweep", _STALE_SQL)
def stale_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sweeps(spark, sf_dir)
    last = rows.agg((F.date_trunc("millisecond", F.max("seen_at").cast("timestamp")) - F.expr("INTERVAL 20 MINUTES")).cast("timestamp_ntz")).first()[0]
    return keyed.stale_sweep_batch(rows.filter(F.col("seen_at") <= F.lit(last).cast("timestamp_ntz")))


@query("stale_sweep_stream", _STALE_SQL)
def stale_sweep_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replayed(sweeps(spark, sf_dir), "seen_at", lambda s: keyed.stale_sweep(s, buckets=4))


@query("news_sent_stream", "SELECT DISTINCT user_id || ':' || event_type AS dedup_key FROM events")
def news_sent_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by user and kind, each sent once over four batches."""
    rows = table(spark, sf_dir, "events").select("ts", F.concat_ws(":", "user_id", "event_type").alias("dedup_key"))
    return replayed(rows, "ts", lambda s: watch.first_only(s), 4).select("dedup_key")
