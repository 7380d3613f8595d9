"""Value ranges under a cap: counts, heavy values, missing values and buckets, and how rows travel."""

from collections import defaultdict

from pyspark.sql import functions as F

from gavelspark.operators import queues


def halved(values, low, high, cap):
    inside = [v for v in values if low <= v <= high]
    if not inside:
        return []
    if len(inside) <= cap or low >= high:
        return [(low, high, len(inside), len(inside) > cap)]
    mid = (low + high) // 2
    return halved(inside, low, mid, cap) + halved(inside, mid + 1, high, cap)


def test_ranges_as_by_hand(spark):
    by = {"a": [i * i for i in range(900)] + [7] * 60, "b": [-5, -4, -3] * 30, None: [2**40 + i for i in range(40)] + [-(2**40)] * 3, "c": [1], "d": [9] * 80}
    rows = spark.createDataFrame([(b, v) for b, vs in by.items() for v in vs] + [("e", None)] * 2, "b string, v long").repartition(4)
    got = defaultdict(list)
    for r in queues.capped_ranges(rows, "b", "v", 10).collect():
        got[r["b"]].append((r["low"], r["high"], r["n"], r["over_cap"]))
    assert got.pop("e") == [(None, None, 2, False)]
    assert {b: sorted(x) for b, x in got.items()} == {b: sorted(halved(v, min(v), max(v), 10)) for b, v in by.items()}


def test_rows_travel_as_counts_of_parts(spark, monkeypatch):
    """What is kept between passes is far less than the distinct values."""
    kept, pinned = [], queues.pinned
    monkeypatch.setattr(queues, "pinned", lambda df: kept.append(pinned(df)) or kept[-1])
    assert queues.capped_ranges(spark.range(40000).select(F.lit("x").alias("b"), F.col("id").alias("v")), "b", "v", 500).agg(F.sum("n")).first()[0] == 40000
    assert sum(k.count() for k in kept) < 5000
