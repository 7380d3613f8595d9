"""Grid joins, neighbours of all vectors, typed values, item pages."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelspark.operators import neighbours, places, search
from gavelspark.plans.queries import ORACLE, QUERIES
from gavelspark.sources.typed import typed_values

from .support import SMALL, assert_same


@pytest.mark.parametrize("name", ["places_in_polygons", "neighbours_of_all", "typed_conversations", "item_details", "search_all_filters", "deals_sorted", "price_samples_all_targets"])
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), SMALL, ORACLE[name])


def inside(lat, lon, corners):
    odd = False
    for (a, b), (c, d) in zip(corners, corners[1:] + corners[:1]):
        if (a > lat) != (c > lat) and lon < (d - b) * (lat - a) / (c - a) + b:
            odd = not odd
    return odd


@pytest.mark.parametrize("step", [0.05, 0.5, 1.0, 20.0, None])
def test_points_in_polygons(spark, step):
    r = random.Random(3)
    shapes = {
        1: [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)],
        2: [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (2.0, 2.0), (3.0, 1.0)],
        3: [(-2.0, -2.0), (5.0, -1.9), (-1.9, 5.0)],
        4: [(2.0, 2.0), (2.0, 2.001), (2.001, 2.0)],
        5: [(0.0, 0.0), (1.0, 1.0)],
        6: [(r.uniform(-3, 6), r.uniform(-3, 6)) for _ in range(9)],  # crosses itself
    }
    points = [(k, r.uniform(-3, 6), r.uniform(-3, 6)) for k in range(400)] + [(1000 + k, float(k % 5), float(k // 5)) for k in range(25)] + [(2000, 2.0004, 2.0004), (2001, None, 1.0), (2002, 1e6, -1e6)]
    polygons = spark.createDataFrame([(k, [{"lat": a, "lon": b} for a, b in s]) for k, s in shapes.items()], "polygon int, corners array<struct<lat:double,lon:double>>")
    got = places.points_in_polygons(spark.createDataFrame(points, "point int, lat double, lon double"), polygons, step)
    want = sorted((p, k) for p, a, b in points if a is not None for k, s in shapes.items() if len(s) > 2 and inside(a, b, s))
    assert sorted((x.point, x.polygon) for x in got.collect()) == want


def test_border_cells_only_are_tested(spark):
    square = spark.createDataFrame([(1, [{"lat": a, "lon": b} for a, b in ((0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0))])], "polygon int, corners array<struct<lat:double,lon:double>>")
    grid = places.cells(square, 1.0)
    assert grid.filter("NOT border").count() == 64 and grid.filter("border").count() <= 121 - 64 + 20


@pytest.mark.parametrize("block", [4096, 7])
def test_neighbours_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "VISITORS", 11)
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 8))
    vectors = [(int(i), (centres[i % 6] + r.normal(size=8) * 0.2).tolist()) for i in range(120)]
    vectors += [(200 + i, vectors[3][1]) for i in range(15)] + [(300, [0.0] * 8), (301, None), (302, []), (303, [float("inf")] * 8), (304, [1.0, None] * 4), (305, [2 * x for x in vectors[4][1]])]
    found, work = neighbours.all_neighbours(spark.createDataFrame(vectors, "id long, embedding array<double>"), "id", k=5, least=0.5)
    sound = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    got = {}
    for x in found.collect():
        got.setdefault(x.id, []).append((x["rank"], x.other, x.score))
    for i, v in sound.items():
        scores = sorted((-float(v @ w), j) for j, w in sound.items() if j != i and v @ w >= 0.5 - 1e-12)[:5]
        mine = sorted(got.get(i, []))
        assert [m[0] for m in mine] == list(range(1, len(scores) + 1))
        assert np.allclose([m[2] for m in mine], [-s for s, _ in scores]) and all(abs(m[2] - float(v @ sound[m[1]])) < 1e-9 for m in mine)
    compared, pairs = work.first()
    assert compared < 0.6 * pairs and set(got) <= set(sound)


def test_vectors_do_not_travel_to_every_cell_in_reach(spark, monkeypatch):
    written, pin = [], neighbours.pinned
    monkeypatch.setattr(neighbours, "pinned", lambda df: written.append(pin(df)) or written[-1])
    r = np.random.default_rng(6)
    vectors = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(300, 16)))] + [(300 + i, [1.0] * 16) for i in range(100)]
    found, _ = neighbours.all_neighbours(spark.createDataFrame(vectors, "id long, embedding array<double>"), "id", k=5, least=-1.0)
    assert found.count() == 5 * len(vectors) and all(df.count() <= 2 * len(vectors) for df in written)
    assert sorted(x.other for x in found.filter("id = 399").collect()) == [300, 301, 302, 303, 304]  # copies tie


def test_no_vectors(spark):
    assert neighbours.all_neighbours(spark.createDataFrame([], "id long, embedding array<double>"), "id")[0].collect() == []


def wrap(x):
    if x is None:
        return {"nullValue": None}
    if isinstance(x, bool):
        return {"booleanValue": x}
    if isinstance(x, int):
        return {"integerValue": str(x)}
    if isinstance(x, float):
        return {"doubleValue": x}
    if isinstance(x, str):
        return {"stringValue": x}
    if isinstance(x, list):
        return {"arrayValue": {"values": [wrap(y) for y in x]}}
    return {"mapValue": {"fields": {k: wrap(v) for k, v in x.items()}}}


def plain(x, path=""):
    if isinstance(x, dict):
        return [p for k, v in x.items() for p in plain(v, f"{path}.{k}" if path else k)]
    if isinstance(x, list):
        return [p for i, v in enumerate(x) for p in plain(v, f"{path}[{i}]")]
    kind = next(iter(wrap(x)))
    return [(path, kind, None if x is None else str(x).lower() if isinstance(x, bool) else str(x))]


def test_typed_values_of_any_depth(spark):
    deep = "bottom"
    for k in range(12):
        deep = {"a": deep} if k % 2 else [deep, k]
    docs = {1: {"title": "x", "n": 5, "half": 0.5, "yes": True, "none": None, "empty": {}, "list": [], "mixed": [1, "two", [3, {"four": [None, False]}]]}, 2: {"deep": deep, "text": 'stringValue "quoted" {"mapValue": 1}'}, 3: {}}
    rows = [(k, json.dumps({n: wrap(v) for n, v in d.items()})) for k, d in docs.items()] + [(4, None), (5, "no json"), (6, '{"odd": {"otherValue": 1}, "kept": {"timestampValue": "2024-01-01T00:00:00Z"}}')]
    got = sorted((r.key, r.path, r.kind, r.value) for r in typed_values(spark.createDataFrame(rows, "key long, payload string"), "key", "payload").collect())
    want = [(k, *p) for k, d in docs.items() for p in plain(d)] + [(6, "kept", "timestampValue", "2024-01-01T00:00:00Z")]
    assert got == sorted(want, key=lambda r: r[:3])


def test_details_of_a_hot_lot(spark):
    lots = spark.createDataFrame([("h", "1", "fordon/x", "ABC 123"), ("h", "2", "smycken", "ABC 123"), ("h", "3", None, None)], "house string, external_id string, category string, title string")
    bids = spark.range(3000).select(F.lit("h").alias("house"), F.lit("1").alias("external_id"), F.col("id").alias("bid_id"), (F.col("id") % 500).alias("value"))
    media = spark.createDataFrame([("h", "1", "b", 2), ("h", "1", "a", 1), ("h", "9", "x", 0)], "house string, external_id string, url string, sort int")
    cars = spark.createDataFrame([("ABC123", "a car")], "plate string, vehicle string")
    got = {r.external_id: r for r in search.details(lots, bids, media, cars, F.regexp_replace("title", " ", "")).collect()}
    best = sorted(((-(i % 500), i) for i in range(3000)))[:100]
    assert [(b.value, b.bid_id) for b in got["1"].bids] == [(-v, i) for v, i in best] and got["1"].media == ["a", "b"]
    assert (got["1"].vehicle, got["2"].vehicle, got["3"].vehicle) == ("a car", None, None) and got["2"].bids == [] and got["3"].media == []
