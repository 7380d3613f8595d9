"""Known cases of the fee engine, properties of merges, joins, plans and routes."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelspark.functions.vectors import in_polygon, trigram_similarity
from gavelspark.operators import merge, queues, route
from gavelspark.rules import classify, fees

ITEM = "house string, currency string, current_bid long, min_bid long, fee_value long, vat_rate double"


@pytest.mark.parametrize("house,currency,bid,fee,vat,total", [
    ("auctionet", "SEK", 1000, None, None, 1330), ("auctionet", "GBP", 100, None, None, 139), ("auctionet", "EUR", 100, None, None, 133),
    ("retrade", "SEK", 100, None, None, 100), ("riksauktioner", "SEK", 5000, None, None, 5625), ("riksauktioner", "SEK", 200000, None, 25.0, 262500),
])
def test_fee_cases(spark, house, currency, bid, fee, vat, total):
    df = spark.createDataFrame([(house, currency, bid, None, fee, vat)], ITEM)
    assert fees.with_total(df).first().total_price == total


def test_no_total_without_a_price(spark):
    df = spark.createDataFrame([("tovek", "SEK", None, None, None, None), ("retrade", "SEK", None, None, None, None), ("unknown", None, 100, None, 10, 25.0)], ITEM)
    got = {r.house: (r.total_price, r.total_basis) for r in fees.with_total(df).collect()}
    assert got["tovek"][0] is None and got["retrade"] == (0, "external") and got["unknown"][1] == "source"


def test_item_merge_is_idempotent_and_monotone(spark):
    schema = "house string, external_id string, title string, current_bid long, bid_count int, category string, category_conf string, total_basis string"
    old = spark.createDataFrame([("h", "1", "a", 100, 3, "x/y", "human", "source"), ("h", "2", "b", None, None, None, "none", None)], schema)
    new = spark.createDataFrame([("h", "1", "c", 50, 5, "z/w", "text", "external"), ("h", "3", "d", 7, 1, "q/r", "house", "external")], schema)
    once = merge.merge_items(old, new)
    twice = merge.merge_items(once.drop("inserted"), new)
    assert sorted(map(tuple, once.drop("inserted").collect()), key=repr) == sorted(map(tuple, twice.drop("inserted").collect()), key=repr)
    got = {r.external_id: r for r in once.collect()}
    assert (got["1"].title, got["1"].current_bid, got["1"].bid_count, got["1"].category, got["1"].total_basis) == ("c", 100, 5, "x/y", "source")
    assert (got["2"].title, got["3"].inserted, got["1"].inserted) == ("b", True, False)


def test_trigram_similarity_is_symmetric(spark):
    words = ["guld ring", "Ring i guld", "", "stol", "åland stol"]
    df = spark.createDataFrame(list(itertools.product(words, words)), "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", trigram_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    assert all(got[a, b] == got[b, a] for a, b in got) and all(got[w, w] == (1.0 if w else 0.0) for w in words)


def test_capped_ranges_cover_every_row_once(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("b"), F.when(F.col("id") < 900, 5).otherwise(F.col("id")).alias("v"))
    leaves = queues.capped_ranges(df, "b", "v", 100).collect()
    assert sum(r.n for r in leaves) == 3000
    assert all(r.n <= 100 or r.low == r.high == 5 for r in leaves)
    for b in (0, 1):
        spans = sorted((r.low, r.high) for r in leaves if r.b == b)
        assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_house_and_mixed_classification(spark):
    df = spark.createDataFrame([("fordon/personbilar", "media/vinyl", "Vinyl"), (None, None, None), ("ovrigt/partier", "media/vinyl", "Vinyl"), ("media/film", "media/vinyl", "Övrigt")], "t string, h string, n string")
    got = [tuple(r[0]) for r in df.select(classify.classified(F.col("t"), F.col("h"), F.col("n"))).collect()]
    assert got == [("media/vinyl", "house"), ("ovrigt/diverse", "none"), ("ovrigt/partier", "mixed"), ("media/film", "text")]


def test_tours_are_near_the_best():
    rng = np.random.default_rng(2)
    for _ in range(10):
        d = route.distances(55 + rng.random(7), 12 + rng.random(7))
        length = lambda o: sum(d[a, b] for a, b in zip(o, [*o[1:], o[0]]))
        best = min(length([0, *p]) for p in itertools.permutations(range(1, 7)))
        found = route.tour(d)
        assert sorted(found) == list(range(7)) and found[0] == 0 and length(found) <= 1.1 * best


def test_route_timeline(spark):
    stops = [(1, 0, 57.7, 12.0, 480.0, 1000.0, True), (1, 1, 57.8, 12.1, 600.0, 700.0, False), (1, 2, 57.9, 12.3, 0.0, 10.0, False), (2, 5, 59.0, 18.0, 480.0, 900.0, True)]
    got = route.plan_routes(spark.createDataFrame(stops, "route_id long, stop_id long, lat double, lon double, opens double, closes double, depot boolean")).orderBy("route_id", "place").collect()
    first = [r for r in got if r.route_id == 1]
    assert [r.stop_id for r in first][0] == first[-1].stop_id == 0 and {r.stop_id for r in first} == {0, 1, 2}
    assert all(b.arrival >= a.arrival + a.wait for a, b in zip(first, first[1:]))
    assert [r.late for r in first if r.stop_id == 2] == [True] and not any(r.refused for r in first)
    assert [(r.place, r.refused) for r in got if r.route_id == 2] == [(None, True)]


def test_polygon(spark):
    square = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)]
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0), (9.9, 0.1)], "lat double, lon double")
    assert [r[0] for r in df.select(in_polygon(F.col("lat"), F.col("lon"), square)).collect()] == [True, False, False, True]
