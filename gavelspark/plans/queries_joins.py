"""Queries over joins of places, vectors and nested payloads, and over everything that a page or a search asks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, vectors
from ..operators import neighbours, places, search
from ..rules import fees
from ..sources import typed
from .adapt import AS_OF, ITEMS_SQL, items, ntz, table
from .queries_items import _ACTIVE, _COS, FEES_SQL
from .queries_prices import deals
from .registry import ORACLE, query

c, lit = F.col, F.lit
#: Corners of a concave outline around (0, 0).
_OUTLINE = ((1.0, 0.0), (0.3, 0.25), (0.1, 0.9), (-0.35, 0.3), (-0.9, 0.45), (-0.3, -0.1), (-0.6, -0.95), (0.2, -0.35), (0.75, -0.7))
_SIZE = "(1.0::DOUBLE + n_nationkey % 4 * 0.5::DOUBLE)"
_POLYGONS_SQL = f"""corners AS (SELECT n_nationkey AS polygon, i, 55.0::DOUBLE + n_nationkey % 5 * 1.5::DOUBLE + x * {_SIZE} AS lat, 12.0::DOUBLE + n_nationkey // 5 * 1.25::DOUBLE + y * {_SIZE} AS lon
  FROM nation, (VALUES {", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, (x, y) in enumerate(_OUTLINE))}) AS o(i, x, y)),
edges AS (SELECT a.polygon, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2 FROM corners a JOIN corners b ON b.polygon = a.polygon AND b.i = (a.i + 1) % {len(_OUTLINE)}),
points AS (SELECT 's' || s_suppkey AS point, 53.5::DOUBLE + s_suppkey * 37 % 1000 * 0.0095::DOUBLE AS lat, 10.5::DOUBLE + s_suppkey * 71 % 997 * 0.0085::DOUBLE AS lon FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 53.5::DOUBLE + c_custkey * 37 % 1000 * 0.0095::DOUBLE, 10.5::DOUBLE + c_custkey * 71 % 997 * 0.0085::DOUBLE FROM customer)"""


@query(
    "places_in_polygons",
    f"""WITH {_POLYGONS_SQL} SELECT point, polygon FROM points, edges
GROUP BY point, polygon HAVING count(*) FILTER (WHERE (lat1 > lat) <> (lat2 > lat) AND lon < (lon2 - lon1) * (lat - lat1) / (lat2 - lat1) + lon1) % 2 = 1""",
)
def places_in_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers, placed by their keys, in a concave polygon for each nation; polygons overlap."""
    size = 1.0 + c("n_nationkey") % 4 * 0.5
    lat, lon = 55.0 + c("n_nationkey") % 5 * 1.5, 12.0 + F.floor(c("n_nationkey") / 5) * 1.25
    corners = F.array(*[F.struct((lat + lit(x) * size).alias("lat"), (lon + lit(y) * size).alias("lon")) for x, y in _OUTLINE])
    polygons = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("polygon"), corners.alias("corners"))
    at = lambda t, key, letter: table(spark, sf_dir, t).select(F.concat(lit(letter), key).alias("point"), (53.5 + c(key) * 37 % 1000 * 0.0095).alias("lat"), (10.5 + c(key) * 71 % 997 * 0.0085).alias("lon"))
    points = at("supplier", "s_suppkey", "s").unionByName(at("customer", "c_custkey", "c"))
    return places.points_in_polygons(points, polygons)


_NEAR_SQL = f"""WITH s AS (SELECT q.vec_id, e.vec_id AS other, {_COS} / (sqrt({_COS.replace('q.', 'e.')}) * sqrt({_COS.replace('e.', 'q.')})) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, other) AS rank FROM s WHERE score >= 0.2)
SELECT vec_id, other, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 12"""


@query("neighbours_of_all", _NEAR_SQL)
def neighbours_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most similar vectors of every vector, by cells of centroids."""
    found = neighbours.all_neighbours(table(spark, sf_dir, "embeddings"), "vec_id", least=0.2)[0]
    return found.select(c("id").alias("vec_id"), "other", F.round("score", 6).alias("score"), "rank")


_TURNS_SQL = """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations),
f AS (
  SELECT conv_id, 'id' AS path, 'integerValue' AS kind, conv_id::VARCHAR AS value FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, 'turns[' || i || '].role', 'stringValue', role FROM t WHERE role IS NOT NULL
  UNION ALL SELECT conv_id, 'turns[' || i || '].text', 'stringValue', text FROM t WHERE text IS NOT NULL
  UNION ALL SELECT conv_id, 'turns[' || i || '].about.number', 'integerValue', turn::VARCHAR FROM t
  UNION ALL SELECT conv_id, 'turns[' || i || '].about.half', 'doubleValue', (turn + 0.5::DOUBLE)::VARCHAR FROM t
  UNION ALL SELECT conv_id, 'turns[' || i || '].about.marks[0]', 'booleanValue', (turn % 2 = 0)::VARCHAR FROM t
  UNION ALL SELECT conv_id, 'turns[' || i || '].about.marks[1].gone', 'nullValue', NULL FROM t)
SELECT * FROM f"""


@query("typed_conversations", _TURNS_SQL)
def typed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of typed values, six levels deep, decoded."""
    wrapped = lambda kind, value: F.struct(value.alias(kind))
    fields = lambda **kw: wrapped("mapValue", F.struct(F.struct(*[v.alias(k) for k, v in kw.items()]).alias("fields")))
    listed = lambda *values: wrapped("arrayValue", F.struct(F.array(*values).alias("values")))
    mark = F.struct((c("turn") % 2 == 0).alias("booleanValue"), lit(None).cast("struct<fields:struct<gone:struct<nullValue:string>>>").alias("mapValue"))
    gone = F.struct(lit(None).cast("boolean").alias("booleanValue"), F.struct(F.struct(F.struct(lit(None).cast("string").alias("nullValue")).alias("gone")).alias("fields")).alias("mapValue"))
    about = fields(number=wrapped("integerValue", c("turn").cast("string")), half=wrapped("doubleValue", c("turn") + 0.5), marks=listed(mark, gone))
    turn = fields(role=wrapped("stringValue", c("role")), text=wrapped("stringValue", c("text")), about=about)
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text", turn.alias("t")))), lambda x: x["t"]).alias("turns"))
    payload = F.to_json(F.struct(wrapped("integerValue", c("conv_id").cast("string")).alias("id"), wrapped("arrayValue", F.struct(c("turns").alias("values"))).alias("turns")), {"ignoreNullFields": "false"})
    return typed.typed_values(rows.select("conv_id", payload.alias("payload")), "conv_id", "payload")


@query(
    "item_details",
    """WITH i AS (SELECT DISTINCT 'h' || user_id % 4 AS house, user_id::VARCHAR AS external_id, CASE WHEN user_id % 3 = 0 THEN 'fordon/personbilar' ELSE 'smycken' END AS category, 'Bil ABC ' || (100 + user_id % 50) AS title FROM events WHERE user_id % 2 = 0),
b AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE event_type <> 'error'),
t AS (SELECT user_id::VARCHAR AS external_id, string_agg(event_id::VARCHAR, ',' ORDER BY r) AS bids, count(*) AS n FROM b WHERE r <= 10 GROUP BY user_id),
m AS (SELECT user_id::VARCHAR AS external_id, string_agg('u' || event_id, ',' ORDER BY CAST(json_extract_string(props, '$.k') AS BIGINT), 'u' || event_id) AS media FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT house, i.external_id, coalesce(bids, '') AS bids, coalesce(n, 0) AS n, coalesce(media, '') AS media, CASE WHEN category LIKE 'fordon%' AND (100 + i.external_id::INT % 50) % 5 > 0 THEN 'car ' || (100 + i.external_id::INT % 50) END AS vehicle
FROM i LEFT JOIN t USING (external_id) LEFT JOIN m USING (external_id)""",
)
def item_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of every second user's lot: its ten highest bids, its pictures in order, the vehicle of its plate."""
    e = table(spark, sf_dir, "events").withColumns({"house": F.concat(lit("h"), c("user_id") % 4), "external_id": c("user_id").cast("string")})
    lots = e.filter("user_id % 2 = 0").select(*search.KEY, F.when(c("user_id") % 3 == 0, "fordon/personbilar").otherwise("smycken").alias("category"), F.concat(lit("Bil ABC "), 100 + c("user_id") % 50).alias("title")).distinct()
    bids = e.filter("event_type != 'error'").select(*search.KEY, c("event_id").alias("bid_id"), "value")
    media = e.filter("event_type = 'view'").select(*search.KEY, F.concat(lit("u"), "event_id").alias("url"), F.get_json_object("props", "$.k").cast("long").alias("sort"))
    known = spark.range(100, 150).filter("id % 5 > 0").select(F.concat(lit("ABC"), "id").alias("plate"), F.concat(lit("car "), "id").alias("vehicle"))
    rows = search.details(lots, bids, media, known, T.plate(c("title")), most=10)
    return rows.select(*search.KEY, F.array_join(F.transform("bids", lambda b: b["bid_id"].cast("string")), ",").alias("bids"), F.size("bids").cast("long").alias("n"), F.array_join("media", ",").alias("media"), "vehicle")


@query(
    "search_all_filters",
    f"""WITH {ITEMS_SQL}, {FEES_SQL},
d AS (SELECT *, CASE WHEN bid_count % 4 = 0 THEN 'red gizmo, ny i kartong' WHEN bid_count % 4 = 1 THEN 'oanvänd' END AS description, bid_count % 40 AS deal_percent, CASE WHEN bid_count % 3 > 0 THEN 'met' END AS reserve_status, bid_count % 5 > 0 AS insolvency FROM totals),
h AS (SELECT *, CASE WHEN title ILIKE '%red gizmo%' THEN 1
  WHEN regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])red') AND regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])gizmo') THEN 2
  WHEN coalesce(description ILIKE '%red gizmo%', false) THEN 3
  WHEN regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(bolt|rin)') THEN 4
  WHEN title ILIKE '%red%' AND title ILIKE '%gizmo%' THEN 5 END AS tier FROM d
  WHERE {_ACTIVE} AND house NOT IN ('bna') AND house IN ('tovek', 'siko', 'bna', 'klaravik', 'auctionet', 'retrade') AND (category = 'economy' OR category LIKE 'economy/%')
    AND coalesce(total_price, current_bid, min_bid) BETWEEN 2000 AND 90000 AND ends_at <= TIMESTAMP '{AS_OF}' + INTERVAL 400 DAY AND deal_percent >= 3 AND reserve_status = 'met' AND insolvency AND regexp_matches(location, '(?i)nation_1')
    AND regexp_matches(coalesce(description, ''), '(?i)oanvänd|ny i kartong'))
SELECT house, external_id, title, tier FROM h WHERE tier IS NOT NULL ORDER BY tier, coalesce(total_price, current_bid, min_bid) * {{rate}} NULLS LAST, house, external_id LIMIT 60""".replace("{rate}", "CASE currency WHEN 'GBP' THEN 12.8 WHEN 'EUR' THEN 11.1 WHEN 'DKK' THEN 1.48 WHEN 'USD' THEN 9.7 WHEN 'NOK' THEN 0.98 WHEN 'CHF' THEN 12.0 ELSE 1 END"),
)
def search_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiered search with every filter of a listing at once, the cheapest first within a tier."""
    n = c("bid_count")
    rows = fees.with_total(items(spark, sf_dir)).withColumns({
        "description": F.when(n % 4 == 0, "red gizmo, ny i kartong").when(n % 4 == 1, "oanvänd"), "deal_percent": n % 40, "reserve_status": F.when(n % 3 > 0, "met"), "insolvency": n % 5 > 0})
    wanted = search.Filters(
        as_of=ntz(AS_OF), hidden=("bna",), houses=("tovek", "siko", "bna", "klaravik", "auctionet", "retrade"), category="economy", min_price=2000, max_price=90000, ends_before=ntz(AS_OF) + F.expr("INTERVAL 400 DAYS"),
        place="NATION_1", min_deal=3, reserve="met", insolvency=True, condition="ny")
    found = search.search(rows, "red gizmo", wanted, "price_low", 60, synonyms=["bolt", "rin"], text_cols=("description",))
    return found.select("house", "external_id", "title", "tier")


@query("deals_sorted", f"WITH d AS ({ORACLE['deals']}), {ITEMS_SQL} SELECT d.house, d.external_id, d.deal_percent, i.ends_at FROM d JOIN items i USING (house, external_id) ORDER BY d.deal_percent DESC, i.ends_at NULLS LAST, house, external_id LIMIT 5")
def deals_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best deals first."""
    rows = deals(spark, sf_dir).join(items(spark, sf_dir).select(*search.KEY, "status", "ends_at"), search.KEY)
    return search.list_items(rows, search.Filters(), "deal", 5).select(*search.KEY, "deal_percent", "ends_at")


@query(
    "vector_codec",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::FLOAT::DOUBLE) AS v FROM embeddings)
SELECT vec_id, (4 * len(v))::INT AS n_bytes, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * i)), 6) AS weighted, true AS stable, CASE WHEN vec_id % 3 > 0 THEN (len(v) - 1)::INT END AS n_cut FROM v""",
)
def vector_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors to bytes and back, weighted by place so that the order counts. Packed again they give the same bytes;
    bytes cut by a whole component make a shorter vector, cut elsewhere none."""
    packed = table(spark, sf_dir, "embeddings").select("vec_id", vectors.vector_bytes(c("embedding")).alias("b"))
    n = F.octet_length("b")
    cut = F.substring("b", lit(1), n - F.when(c("vec_id") % 3 == 0, 3).otherwise(4))
    rows = packed.select("vec_id", "b", n.alias("n_bytes"), vectors.bytes_vector(c("b")).alias("v"), vectors.bytes_vector(cut).alias("short"))
    weighted = F.aggregate(F.transform("v", lambda x, i: x.cast("double") * (i + 1)), lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", "n_bytes", F.round(weighted, 6).alias("weighted"), (vectors.vector_bytes(c("v")) == c("b")).alias("stable"), F.when(c("short").isNotNull(), F.size("short")).alias("n_cut"))
