"""Keyed stream operators over files: restarts, late and unordered rows, aborted sweeps, cursors."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gavelspark.plans.queries import ORACLE, QUERIES
from gavelspark.plans.queries_streams import lot_states, sweeps
from gavelspark.sources import cursors
from gavelspark.streaming import keyed, replay, watch

from .support import SMALL, assert_same, rows_of

STATES = "house string, external_id string, seq long, status string, reserve_status string, ends_at timestamp_ntz, observed_at timestamp_ntz"
START = datetime(2024, 3, 1, 12)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


@pytest.mark.parametrize("name", ["watch_news", "watch_news_stream", "stale_sweep", "stale_sweep_stream", "keyset_sweep", "offset_sweep", "news_sent_stream"])
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), SMALL, ORACLE[name])


def files(spark, tmp_path, batches, schema):
    """One file a batch, in order."""
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def states(*rows):
    return [("h", lot, k, status, reserve, at(ends), at(t)) for k, (lot, t, status, reserve, ends) in enumerate(rows)]


def told(spark, tmp_path, batches, watches, **kw):
    source = files(spark, tmp_path, batches, STATES)
    replay.run_over(spark, source, STATES, lambda s: keyed.watch_news(s, watches, **kw), str(tmp_path / "out"), str(tmp_path / "state"), 1)
    return sorted((r.external_id, r.event, round((r.told_at - START).total_seconds() / 60)) for r in spark.read.schema(keyed.NEWS).parquet(str(tmp_path / "out")).collect())


def watching(spark, *lots):
    return spark.createDataFrame([("h", *w) for w in lots], "house string, external_id string, notified_reserve boolean, notified_ended boolean")


def test_ending_soon_needs_no_row(spark, tmp_path):
    """Lot a is quiet while its end comes near; b's end is moved away and told later; c closes before it is near; d was
    told already; e is not watched; f was past its end when it was first seen."""
    first = states(("a", 0, "active", "not_met", 300), ("b", 0, "active", "not_met", 100), ("c", 0, "active", "met", 300), ("d", 0, "ended", "met", 10), ("e", 0, "ended", "met", 10), ("f", 0, "active", "not_met", -5))
    second = states(("b", 10, "active", "not_met", 400), ("c", 20, "ended", "met", 300), ("a", 30, "active", "not_met", 300))
    clock = [states(("z", t, "active", "not_met", None)) for t in (120, 290, 380, 700)]
    got = told(spark, tmp_path, [first, second, *clock], watching(spark, ("a", False, False), ("b", False, False), ("c", False, False), ("d", True, True), ("f", False, False), ("z", True, True)))
    assert got == [("a", "ending_soon", 235), ("b", "ending_soon", 335), ("c", "ended", 20), ("c", "reserve_met", 0)]


def test_rows_out_of_order(spark, tmp_path):
    """A row that comes ten minutes late still moves the end before the news of the old one."""
    batches = [states(("a", 0, "active", "not_met", 90)), states(("z", 30, "active", "not_met", None)), states(("a", 22, "active", "met", 500)), states(("a", 40, "active", "not_met", 500)), states(("z", 900, "active", "not_met", None)), states(("z", 990, "active", "not_met", None))]
    got = told(spark, tmp_path, batches, watching(spark, ("a", False, False), ("z", True, True)))
    assert got == [("a", "ending_soon", 435), ("a", "reserve_met", 22)]
    batch = keyed.watch_news_batch(spark.createDataFrame([r for b in batches for r in b], STATES), watching(spark, ("a", False, False)), F.lit(at(970)).cast("timestamp_ntz"))
    assert got == sorted((r.external_id, r.event, round((r.told_at - START).total_seconds() / 60)) for r in batch.collect())


def test_restart_goes_on(spark, tmp_path):
    """Three runs over a growing folder, each a stream of its own on one checkpoint, give what one run gives."""
    rows, watches = lot_states(spark, SMALL)
    watches.write.parquet(str(tmp_path / "watches"))
    watches = spark.read.parquet(str(tmp_path / "watches"))
    source = replay.in_batches(rows, "observed_at", 3, files=1)
    ordered = [r.f for r in spark.read.parquet(source).select(F.input_file_name().alias("f"), "observed_at").groupBy("f").agg(F.min("observed_at").alias("t")).orderBy("t").collect()]
    assert len(ordered) == 3
    growing, out, state = (str(tmp_path / n) for n in ("growing", "out", "state"))
    for part in ordered:
        spark.read.parquet(part).coalesce(1).write.mode("append").parquet(growing)
        replay.run_over(spark, growing, rows.schema, lambda s: keyed.watch_news(s, watches), out, state, 1)
    got, want = spark.read.parquet(out), QUERIES["watch_news"](spark, SMALL)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect())


SEEN = "house string, external_id string, sweep long, mark boolean, seen_at timestamp_ntz"


def swept(spark, tmp_path, batches):
    source = files(spark, tmp_path, [[(h, i, s, m, at(t)) for h, i, s, m, t in b] for b in batches], SEEN)
    replay.run_over(spark, source, SEEN, lambda s: keyed.stale_sweep(s, buckets=3), str(tmp_path / "out"), str(tmp_path / "state"), 1)
    got = sorted((r.house, r.external_id, r.sweep) for r in spark.read.schema(keyed.ENDED).parquet(str(tmp_path / "out")).collect())
    twin = keyed.stale_sweep_batch(spark.read.schema(SEEN).parquet(source).filter(F.col("seen_at") <= at(5000)))
    assert got == sorted((r.house, r.external_id, r.sweep) for r in twin.collect())
    return got


def test_only_a_complete_sweep_ends(spark, tmp_path):
    sweep = lambda n, t, lots, mark=True: [("h", i, n, False, t) for i in lots] + [("h", None, n, True, t + 1)] * mark
    batches = [
        sweep(1, 0, "abcd"),
        sweep(2, 100, "ab", mark=False),  # broken off: c and d stay
        sweep(3, 200, "abd"),  # c ends
        sweep(4, 300, "cb") + [("g", "x", 1, False, 300)],  # c is back, a and d end; another house has no mark
        sweep(5, 400, "b"),  # c ends again
        [("h", None, 6, False, 9000)],
        [("h", None, 7, False, 9900)],
    ]
    assert swept(spark, tmp_path, batches) == [("h", "a", 4), ("h", "c", 3), ("h", "c", 5), ("h", "d", 4)]


def test_lots_of_one_house_lie_in_many_groups(spark):
    rows = sweeps(spark, SMALL)
    parts = keyed._in_buckets(rows, 8)
    assert parts.filter("NOT mark").count() == rows.filter("NOT mark").count() and parts.filter("mark").count() == 8 * rows.filter("mark").count()
    assert parts.select("bucket").distinct().count() == 8


class Counting:
    """A fetch that fails once at a cursor, as a service that breaks off."""

    def __init__(self, n, fail_at):
        self.n, self.fail_at = n, fail_at

    def __call__(self, cursor, limit):
        import os

        if cursor == self.fail_at and not os.path.exists(self.flag):
            open(self.flag, "w").close()
            raise OSError("broken off")
        first = 0 if cursor is None else cursor + 1
        return [{"k": k} for k in range(first, min(first + limit, self.n))]


def test_killed_sweep_reads_each_key_once_a_round(spark, tmp_path):
    fetch = Counting(25, 9)
    fetch.flag = str(tmp_path / "failed")
    cursors.register_cursor(spark, "killed_sweep", "k long", cursors.Cursor(fetch, 5, "k", 2))
    sink, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: spark.readStream.format("killed_sweep").load().writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).start()
    first = run()
    with pytest.raises(Exception, match="broken off"):
        first.processAllAvailable()
    assert 0 < spark.read.parquet(sink).count() < 25
    for _ in range(2):  # done stays done
        again = run()
        again.processAllAvailable()
        again.stop()
    got = sorted((r.sweep, r.mark, -1 if r.k is None else r.k) for r in spark.read.parquet(sink).collect())
    assert got == sorted([(s, False, k) for s in range(2) for k in range(25)] + [(s, True, -1) for s in range(2)])


def test_cursor_by_place_ends_on_a_full_page():
    c = cursors.Cursor(lambda place, limit: [{"k": k} for k in range(place, min(place + limit, 10))], 5, None, 1)
    offset, pages = c.start(), []
    while not offset["done"]:
        rows, offset = c.step(offset)
        pages.append([r.get("k") for r, mark in rows if not mark])
    assert pages == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], []] and c.step(offset) == ([], offset)


def test_news_are_sent_once_over_restarts(spark, tmp_path):
    schema, sink, state = "dedup_key string, n long", str(tmp_path / "sink"), str(tmp_path / "state")
    for batches in ([[("a", 1), ("b", 2), ("b", 2)], [("a", 1), (None, 9)]], [[("b", 2), ("c", 3)]], []):
        source = files(spark, tmp_path, batches, schema) if batches else str(tmp_path / "in")
        replay.run_over(spark, source, schema, watch.first_only, sink, state, files=1)
    assert sorted(map(tuple, spark.read.parquet(sink).collect())) == [("a", 1), ("b", 2), ("c", 3)]
