"""Queries over texts, aggregates, fused search, review cards and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, times, vectors
from ..operators import facets, price, queues, search
from ..operators.price import verified_sold
from ..rules import classify
from ..rules.tables import TITLE_RULES
from ..sources import answers, html as H
from ..sources.contract import reserve
from ..streaming import watch
from .adapt import AS_OF, EVENTS_AS_OF, HISTORY_SQL, ITEMS_SQL, LOTS_SQL, history, items, lots, ntz, spread, table
from .queries_items import first_vector
from .registry import query

c, lit = F.col, F.lit


def _key():
    return c("external_id").cast("long")


# Texts


@query("telling_words", "WITH w AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' 12345 ab'), '[^a-z0-9åäöéü]+'), lambda w: length(w) >= 4 AND NOT regexp_matches(w, '^[0-9]+$'))) AS raw, regexp_split_to_array(lower(p_name || ' ' || p_type || ' 12345 ab'), '[^a-z0-9åäöéü]+') AS l FROM part) SELECT p_partkey, array_to_string(list_transform(list_sort(list_transform(raw, lambda w: {'n': -length(w), 'i': list_position(l, w), 'w': w})), lambda s: s.w)[1:5], ' ') AS words FROM w")
def telling_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_type", lit("12345 ab"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.telling_words(title), " ").alias("words"))


@query("place_spellings", "WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Copenhagen K' WHEN 1 THEN 'KÖPENHAMN' WHEN 2 THEN 'Kobenhavn' ELSE c_name END AS place FROM customer) SELECT c_custkey, c_custkey % 4 < 2 AS hit FROM c")
def place_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place is found under its foreign spellings too, but not under one that nobody listed."""
    from ..functions.text import location_pattern

    k = c("c_custkey") % 4
    place = F.when(k == 0, "Copenhagen K").when(k == 1, "KÖPENHAMN").when(k == 2, "Kobenhavn").otherwise(c("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", place.rlike(location_pattern("Köpenhamn")).alias("hit"))


@query("thing_condition", "SELECT doc_id, CASE WHEN regexp_matches(lower(concat_ws(' ', text, CASE WHEN n_chars % 3 = 0 THEN 'Nytt, från ' END || source)), '(^|[^a-z0-9_])(ny|nytt|nya|unused|new\\s+condition)([^a-z0-9_]|$)') THEN 'new' ELSE 'used' END AS condition FROM documents")
def thing_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.condition(c("text"), F.when(c("n_chars") % 3 == 0, F.concat(lit("Nytt, från "), "source"))).alias("condition"))


@query("stated_brand", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN split_part(p_name, ' ', 1) END AS brand FROM part")
def stated_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(c("p_size") % 3 == 0, F.concat(lit("<p>Fin sak<br>Märke: "), "p_brand", lit(" extra</p>"))).when(c("p_size") % 3 == 1, F.concat(lit("fabrikat = "), "p_name", lit(", röd"))).otherwise("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.stated_brand(said).alias("brand"))


@query("clock_text", "SELECT o_orderkey, lpad((m // 60 % 24)::VARCHAR, 2, '0') || ':' || lpad((m % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT o_orderkey, o_custkey * 7 AS m FROM orders)")
def clock_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", times.clock(c("o_custkey") * 7).alias("clock"))


@query("text_preview", "SELECT doc_id, left(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 160) AS preview FROM documents")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(c("text")).alias("preview"))


@query("text_keys", f"WITH {ITEMS_SQL} SELECT house || '/' || external_id AS key FROM items")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select(T.text_key(c("house"), c("external_id")).alias("key"))


@query("safe_markup", "SELECT p_partkey, '<p>' || p_name || ' </p> <b>x</b>  &lt; 5 <br> ' || p_type AS html FROM part")
def safe_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes go, also one that hides a mark; unknown tags, scripts and comments leave a space."""
    raw = F.concat(lit('<P onclick="a>b" class=x>'), "p_name", lit("<img src='a>b' onerror=x></p><script>x<1</script><B>x</b><!-- <p> --> < 5 <br/> "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", T.allow_tags(raw).alias("html"))


@query("map_points", "SELECT o_orderkey, '3850000,-12020000|' || (3850000 + o_custkey % 16) || ',' || (-12020000 - o_orderkey % 16 - 1) AS points FROM orders")
def map_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed point, and one that lies so many steps north and west of it as the order's keys say."""
    step = lambda n: F.char(lit(63) + n)
    text = F.concat(lit("_p~iF~ps|U"), step(2 * (c("o_custkey") % 16)), step(2 * (c("o_orderkey") % 16) + 1))
    whole = lambda x: F.round(x * 100000).cast("long").cast("string")
    points = vectors.polyline(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(points, lambda p: F.concat_ws(",", whole(p["lat"]), whole(p["lon"]))), "|").alias("points"))


@query("price_ranges", "SELECT p_partkey, (p_size * 1000)::BIGINT AS low, CASE WHEN p_size % 2 = 0 THEN p_size * 1000 + 500 ELSE p_size * 1000 END::BIGINT AS high FROM part WHERE p_size % 3 > 0 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size % 3 = 0")
def price_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    thousands = lambda n: F.regexp_replace(n.cast("string"), r"(\d)(?=(\d{3})+$)", "$1 ")
    told = F.concat(thousands(c("p_size") * 1000), F.when(c("p_size") % 2 == 0, F.concat(lit(" - "), thousands(c("p_size") * 1000 + 500))).otherwise(""))
    page = F.concat(lit("<h4>Privatpris:</h4><p>x</p><em>1 - 2 kr</em><h4>"), F.when(c("p_size") % 3 > 0, "Bilhandlarpris:").otherwise("Annat"), lit("</h4>\n<p><em>"), told, lit(" kr</em>"))
    return table(spark, sf_dir, "part").select("p_partkey", H.price_range(page, "Bilhandlarpris").alias("r")).select("p_partkey", "r.low", "r.high")


@query("vehicle_records", "SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN 'ABC' || (p_partkey % 900 + 100) END AS plate, CASE WHEN p_size % 4 > 0 THEN nullif(p_size * 100, 0) END::BIGINT AS odometer, CASE WHEN p_size % 4 > 0 THEN p_size % 2 = 0 END AS imported, CASE WHEN p_size % 4 > 0 THEN DATE '2001-01-01' + p_size END::DATE AS registered, CASE WHEN p_size % 4 > 0 THEN p_type END AS fuel FROM part")
def vehicle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of markup; of equal labels the first counts; pages of another vehicle give nothing."""
    size = c("p_size")
    plate = F.concat(lit("abc"), (c("p_partkey") % 900 + 100).cast("string"))
    page = F.concat(
        lit("<title>"), F.when(size % 4 > 0, F.upper(plate)).otherwise("Hittade inget"), lit(" - sida</title><table><tr><td>Mätarställning (besiktning)</td><td>"), size, lit(" 00 mil</td></tr><tr><td>Drivmedel</td><td>"), "p_type", lit("</td></tr></table><dl><dt>Import / Införsel</dt><dd>"),
        F.when(size % 2 == 0, "Ja, 2004").otherwise("Nej"), lit("</dd><dt>Först registrerad</dt><dd>den "), F.date_add(F.to_date(lit("2001-01-01")), size).cast("string"), lit("</dd><dt>Drivmedel</dt><dd>annat</dd></dl>"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", H.vehicle(page, plate).alias("v")).select("p_partkey", "v.plate", "v.odometer", "v.imported", "v.registered", "v.fuel")


@query("reserve_states", f"WITH {LOTS_SQL} SELECT external_id, CASE WHEN k % 5 = 0 THEN 'none' WHEN k % 3 = 0 THEN 'met' WHEN k % 3 = 1 THEN 'not_met' END AS state FROM lots")
def reserve_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = F.when(_key() % 3 == 0, True).when(_key() % 3 == 1, False)
    return lots(spark, sf_dir).select("external_id", reserve(met, F.when(_key() % 5 == 0, True)).alias("state"))


@query("json_patch", "SELECT event_id, json_object('k', CAST(json_extract_string(props, '$.k') AS BIGINT) + 1, 'seen', event_id)::VARCHAR AS props FROM events")
def json_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a raw payload changed and one added."""
    raw = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", F.to_json(raw.withField("k", raw["k"] + 1).withField("seen", c("event_id"))).alias("props"))


@query("epoch_times", "SELECT o_orderkey, o_orderdate AS seconds, o_orderdate + to_milliseconds(o_custkey % 1000) AS millis FROM orders")
def epoch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.unix_seconds(c("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select("o_orderkey", times.from_epoch(base).alias("seconds"), times.from_epoch(base * 1000 + c("o_custkey") % 1000, millis=True).alias("millis"))


# Joins and aggregates


@query("history_with_items", f"WITH {HISTORY_SQL}, {ITEMS_SQL} SELECT h.house, h.external_id, h.final_bid, i.currency, i.location FROM history h LEFT JOIN (SELECT * FROM items WHERE bid_count > 10) i ON i.house = h.house AND i.external_id = h.external_id")
def history_with_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = items(spark, sf_dir).filter("bid_count > 10").select("house", "external_id", "currency", "location")
    return price.with_items(history(spark, sf_dir), known).select("house", "external_id", "final_bid", "currency", "location")


@query("places_on_the_map", f"WITH {ITEMS_SQL}, g AS (SELECT lower(n_name) AS place, 55.0 + n_nationkey * 0.4 AS lat FROM nation WHERE n_nationkey % 2 = 0) SELECT i.house, i.external_id, g.lat FROM items i LEFT JOIN g ON g.place = lower(i.location)")
def places_on_the_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("n_nationkey")
    known = table(spark, sf_dir, "nation").filter(n % 2 == 0).select(F.lower("n_name").alias("place"), (lit(55.0) + n * 0.4).alias("lat"), (lit(12.0) + n).alias("lon"))
    rows = items(spark, sf_dir).withColumn("location", F.concat(lit("123 45 "), "location", lit(", Sverige")))
    return facets.located(rows, known).select("house", "external_id", "lat")


@query("distinct_places", f"WITH {ITEMS_SQL} SELECT DISTINCT lower(location) AS place FROM items WHERE location <> ''")
def distinct_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.places(items(spark, sf_dir).withColumn("location", F.concat(lit("9 "), "location")))


@query("unknown_places", f"WITH {ITEMS_SQL} SELECT DISTINCT lower(location) AS place FROM items WHERE lower(location) NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey % 3 = 0)")
def unknown_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places that were looked up in vain are known as such."""
    n = c("n_nationkey")
    known = table(spark, sf_dir, "nation").filter(n % 3 == 0).select(F.lower("n_name").alias("place"), F.when(n % 2 == 0, 55.0).alias("lat"))
    return facets.unknown_places(items(spark, sf_dir), known)


@query("label_coverage", "WITH l AS (SELECT DISTINCT doc_id FROM labels) SELECT source, count(*) AS n, count(l.doc_id) AS covered, round(100.0 * count(l.doc_id) / count(*)) AS percent FROM documents LEFT JOIN l USING (doc_id) GROUP BY source")
def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.coverage(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], "source")


@query("processing_state", f"WITH e AS (SELECT user_id, bool_or(event_id % 5 = 0) AS ok, bool_or(event_id % 5 < 2) AS tried, count(*) FILTER (WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 1 DAY) AS recent FROM events GROUP BY user_id) SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT tried) AS remaining, round(sum(recent) / 60.0, 6)::DOUBLE AS rate FROM e")
def processing_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors: some, tried in vain, not tried; the rate is of the last day here."""
    k = c("event_id") % 5
    vector = F.when(k == 0, F.array(lit(1.0))).when(k == 1, F.array().cast("array<double>"))
    rows = table(spark, sf_dir, "events").select("user_id", vector.alias("v"), "ts")
    out = facets.processing_state(rows, ["user_id"], "v", ntz(EVENTS_AS_OF) - F.expr("INTERVAL 1 DAY"), "ts")
    return out.withColumn("rate", F.round("rate", 6))


@query("soonest_end", f"WITH {ITEMS_SQL} SELECT house, (epoch_ms(min(ends_at)) - epoch_ms(TIMESTAMP '{AS_OF}'))::BIGINT AS ms FROM items WHERE status = 'active' AND ends_at > TIMESTAMP '{AS_OF}' GROUP BY house")
def soonest_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.soonest(items(spark, sf_dir), ntz(AS_OF))


@query("galleries", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def galleries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.galleries(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("class_mix", f"WITH {LOTS_SQL}, n AS (SELECT coalesce(split_part(category, '/', 1), '-') AS main, category_conf AS confidence, count(*) AS n FROM lots GROUP BY ALL) SELECT main, confidence, n, round(100.0 * n / sum(n) OVER (), 2) AS percent FROM n")
def class_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.class_mix(lots(spark, sf_dir))


@query("top_houses", f"WITH {HISTORY_SQL} SELECT house, count(*) AS n FROM history GROUP BY house ORDER BY n DESC, house LIMIT 5")
def top_houses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.top_houses(history(spark, sf_dir), 5)


@query("verified_sales", f"WITH {LOTS_SQL} SELECT external_id, reserve_status IS DISTINCT FROM 'not_met' AND coalesce(coalesce(current_bid, 0) >= reserve_price, true) AS sure FROM lots")
def verified_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lots(spark, sf_dir).select("external_id", verified_sold(F.coalesce("current_bid", lit(0)), c("reserve_price"), c("reserve_status")).alias("sure"))


@query("list_by_condition", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def list_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions that tell of a thing never used; 'oanvändbar' does not."""
    k = c("doc_id") % 3
    told = F.when(k == 0, F.concat(lit("En OANVÄND sak. "), F.coalesce("text", lit("")))).when(k == 1, "Sakerna är oanvändbara")
    return search.Filters(include_ended=True, condition="ny").apply(table(spark, sf_dir, "documents").withColumn("description", told)).select("doc_id")


@query("sharp_images", "SELECT count(*) FILTER (WHERE event_id % 3 > 0) AS n FROM events")
def sharp_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(c("event_id") % 3 == 0, "x_mid.jpg").otherwise("x.jpg")
    return table(spark, sf_dir, "events").select(url.alias("url")).filter(queues.sharp("url")).agg(F.count(lit(1)).alias("n"))


@query("visual_gate", "SELECT e.vec_id, CASE WHEN e.vec_id % 3 = 0 OR e.vec_id % 7 = 0 THEN true ELSE list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) >= 0.3 END AS fine FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id + 1")
def visual_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without both vectors pass."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select("vec_id", F.when(c("vec_id") % 3 > 0, c("embedding")).alias("x"))
    b = e.select((c("vec_id") - 1).alias("vec_id"), F.when((c("vec_id") - 1) % 7 > 0, c("embedding")).otherwise(F.array().cast("array<float>")).alias("y"))
    return a.join(b, "vec_id").select("vec_id", vectors.looks_alike(c("x"), c("y")).alias("fine"))


# Search, cards, sinks

_RING = "CASE WHEN title ILIKE '%ring%' THEN 1 WHEN seller ILIKE '%ring%' THEN 3 END"
_LIVE = f"status = 'active' AND (ends_at IS NULL OR ends_at > TIMESTAMP '{AS_OF}')"
_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_FUSED = f"""WITH {ITEMS_SQL}, x AS (SELECT *, {_RING} AS tier FROM items WHERE {_LIVE}),
lex AS (SELECT house, external_id, tier, row_number() OVER (ORDER BY tier, ends_at, house, external_id) AS lrank FROM (SELECT * FROM x WHERE tier IS NOT NULL ORDER BY tier, ends_at, house, external_id LIMIT 460)),
v AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q), g AS (SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS dev FROM v),
s AS (SELECT vec_id AS part_id, row_number() OVER (ORDER BY score DESC, vec_id) AS srank FROM v, g WHERE n >= 50 AND score >= greatest(0.2, mean + 1.0 * dev) ORDER BY score DESC, vec_id LIMIT 300),
sem AS (SELECT house, external_id, srank FROM (SELECT i.house, i.external_id, s.srank, row_number() OVER (PARTITION BY i.part_id ORDER BY i.house, i.external_id) AS rn FROM items i JOIN s USING (part_id)) WHERE rn = 1),
f AS (SELECT house, external_id, tier, coalesce(1.0 / (60 + lrank), 0) + coalesce(0.5 / (60 + srank), 0) AS rrf FROM lex FULL JOIN sem USING (house, external_id)),
r AS (SELECT i.house, i.external_id, i.ends_at, f.rrf, CASE WHEN tier <= 2 THEN 0 WHEN tier IS NOT NULL THEN 1 ELSE 2 END AS bucket FROM f JOIN items i USING (house, external_id) WHERE {_LIVE})"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors, each standing for one item of its part."""
    top = search.semantic_top(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), ["vec_id"], floor=0.2, z=1.0)
    first = items(spark, sf_dir).groupBy("part_id").agg(F.min(F.struct("house", "external_id")).alias("i"))
    return first.join(top.withColumnRenamed("vec_id", "part_id"), "part_id").select("i.house", "i.external_id", "srank")


def _hybrid(spark: SparkSession, sf_dir: str, semantic: DataFrame | None, sort: str | None) -> DataFrame:
    return search.hybrid(items(spark, sf_dir), "ring", search.Filters(as_of=ntz(AS_OF)), semantic, sort, 60, text_cols=("seller",))


@query("hybrid_search", f"{_FUSED} SELECT house, external_id, round(rrf, 9) AS rrf FROM r ORDER BY r.rrf DESC, house, external_id LIMIT 60")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, _semantic(spark, sf_dir), None).select("house", "external_id", F.round("rrf", 9).alias("rrf"))


@query("hybrid_sorted", f"{_FUSED} SELECT house, external_id, bucket FROM r ORDER BY bucket, ends_at NULLS LAST, r.rrf DESC, house, external_id LIMIT 60")
def hybrid_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, _semantic(spark, sf_dir), "ending").select("house", "external_id", "bucket")


@query("hybrid_without_vectors", f"WITH {ITEMS_SQL}, x AS (SELECT *, {_RING} AS tier FROM items WHERE {_LIVE}) SELECT house, external_id, tier FROM x WHERE tier IS NOT NULL ORDER BY tier, ends_at NULLS LAST, house, external_id LIMIT 60")
def hybrid_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, _semantic(spark, sf_dir).limit(0), None).select("house", "external_id", "tier")


@query("not_seen_yet", f"WITH {ITEMS_SQL} SELECT house, external_id FROM items WHERE status = 'active' AND bid_count % 5 > 0")
def not_seen_yet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).filter("status = 'active'")
    return search.without(rows, rows.filter("bid_count % 5 = 0"), search.KEY).select(*search.KEY)


@query("next_cards", "SELECT l_orderkey AS target, min(l_linenumber) AS sample, arg_min(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS cmp, arg_min('p' || l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS image FROM lineitem WHERE l_partkey % 3 > 0 AND l_partkey % 2 = 0 GROUP BY l_orderkey")
def next_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("target"), c("l_linenumber").alias("sample"), c("l_partkey").alias("cmp"))
    parts = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(c("p_partkey").alias("cmp"), F.concat(lit("p"), "p_partkey").alias("image"))
    return price.next_cards(samples, samples.filter("cmp % 3 = 0").select("target", "cmp"), parts)


@query("some_of_first", "SELECT o_orderkey, o_orderdate FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50) ORDER BY sha256('5:' || o_orderkey) LIMIT 8")
def some_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.some_of_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [c("o_orderdate"), c("o_orderkey")], 50, 8, 5, ["o_orderkey"])


@query("page_addresses", "SELECT DISTINCT url FROM (SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url FROM pages WHERE page_id % 3 = 0)")
def page_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.filter("page_id % 2 = 0").select("url").union(p.filter("page_id % 3 = 0").select("url")).distinct()


@query("addressed_pages", "SELECT sha256(html) AS sha256, count(*) AS copies, left(sha256(html), 2) || '/' || sha256(html) || '.jpg' AS path FROM pages WHERE html IS NOT NULL GROUP BY html")
def addressed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("html", F.concat(lit("u"), c("page_id")).alias("url"))
    return H.addressed(p, "html", "url").select("sha256", "copies", "path")


@query("url_batch", "WITH p AS (SELECT 'u' || user_id AS url, min(ts) AS seen FROM events GROUP BY user_id), sent AS (SELECT 'u' || user_id AS url FROM events WHERE event_type = 'error' AND user_id % 3 = 0) SELECT url FROM p WHERE url NOT IN (SELECT url FROM sent) ORDER BY seen, url LIMIT 40")
def url_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(lit("u"), c("user_id")).alias("url"), "user_id", c("ts").alias("seen"), "event_type")
    return H.url_batch(e, e.filter("event_type = 'error' AND user_id % 3 = 0").select("url").distinct(), 40).select("url")


@query("unsent_news", "SELECT DISTINCT user_id || ':' || event_type AS dedup_key FROM events WHERE user_id || ':' || event_type NOT IN (SELECT user_id || ':' || event_type FROM events WHERE event_id % 50 = 0)")
def unsent_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws(":", "user_id", "event_type").alias("dedup_key"))
    return watch.unsent(rows, rows.filter("event_id % 50 = 0")).select("dedup_key")


@query("page_tables", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'pie' WHEN 1 THEN 'line' ELSE 'bar' END AS kind, CASE p_size % 3 WHEN 0 THEN 100 WHEN 1 THEN 5000 ELSE 500 END::DOUBLE AS top FROM part")
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of pages as series, and how each would be drawn."""
    kind = c("p_size") % 3
    cell = lambda a, b: f"<tr><td>{a}</td><td>{b}</td></tr>"
    pie, line, bar = cell("Volvo", "60 %") + cell("Saab", "39,5 %"), cell("2001", "1 200 kr") + cell("2002", "2 500 kr"), cell("röd", "120") + cell("blå", "430") + cell("text", "ingen")
    page = F.concat(lit("<table><tr><th>Namn</th><th>Värde</th></tr>"), F.when(kind == 0, pie).when(kind == 1, line).otherwise(bar), lit("</table>"))
    series = H.table_series(table(spark, sf_dir, "part").select("p_partkey", page.alias("html")), "p_partkey")
    return H.series_kind(series, "p_partkey")


# Classification and the answers of services


@query("category_names", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'media/vinyl' WHEN 1 THEN NULL ELSE 'fordon/personbilar' END AS key FROM part")
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's category names; one that says nothing gives none."""
    name = F.when(c("p_size") % 3 == 0, "Musik").when(c("p_size") % 3 == 1, F.concat(lit("qx"), c("p_size").cast("string"))).otherwise(" FORDON ")
    return table(spark, sf_dir, "part").select("p_partkey", classify.by_name(name).alias("key"))


@query("classify_precedence", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'ovrigt/partier' WHEN p_size % 2 = 0 THEN 'a/b' WHEN p_size % 3 = 0 THEN 'c/d' ELSE 'ovrigt/diverse' END AS category, CASE WHEN p_size % 5 = 0 THEN 'mixed' WHEN p_size % 2 = 0 THEN 'house' WHEN p_size % 3 = 0 THEN 'text' ELSE 'none' END AS confidence FROM part")
def classify_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = c("p_size")
    text = F.when(size % 5 == 0, "ovrigt/partier").when(size % 3 == 0, "c/d")
    got = classify.classified(text, F.when(size % 2 == 0, "a/b"), c("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", got.alias("g")).select("p_partkey", "g.category", "g.confidence")


@query("answered_verdicts", "SELECT p_partkey, 0 AS i, 'fordon/personbilar' AS category, p_size AS n FROM part WHERE p_size > 0 UNION ALL SELECT p_partkey, 1, 'smycken', NULL FROM part WHERE p_size > 0 UNION ALL SELECT p_partkey, 0, 'fordon/personbilar', NULL FROM part WHERE p_size = 0 UNION ALL SELECT p_partkey, 1, 'smycken', NULL FROM part WHERE p_size = 0")
def answered_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with a fence, an index out of range, a repeated one, an unknown sub-category and a cut-off end."""
    said = F.concat(lit('```json\n[{"i":0,"k":"fordon/personbilar","n":'), "p_size", lit('},{"i":1,"k":"smycken/okänd"},{"i":0,"k":"smycken"},{"i":9,"k":"smycken"},{"i":2,"k":"påhitt"},{"i":3,"k":"fo'))
    rows = table(spark, sf_dir, "part").select("p_partkey", said.alias("answer"), lit(4).alias("asked"))
    return answers.verdicts(rows, "p_partkey", "answer", "asked").select("p_partkey", "i", "category", "n")


@query("answered_expansions", "SELECT p_partkey, 'smycke,guldring' AS synonyms, 'klocka' AS related, 'smycken' AS categories FROM part")
def answered_expansions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query itself, its bare words, doubles and unknown categories are out."""
    said = F.concat(lit('Svar: {"synonyms":["Smycke"," guldring ","smycke","röd ring","ring"],"related":["klocka","x"],"categories":["smycken","påhitt"],"n":'), c("p_size").cast("string"), lit("}"))
    got = answers.expansion(said, lit("Röd  ring"))
    rows = table(spark, sf_dir, "part").select("p_partkey", got.alias("e"))
    return rows.select("p_partkey", *[F.array_join(c(f"e.{k}"), ",").alias(k) for k in ("synonyms", "related", "categories")])


_RANK = "CASE category_conf WHEN 'llm' THEN 1 WHEN 'learned' THEN 1 WHEN 'human' THEN 1 ELSE 0 END"


@query("answers_written", f"WITH {LOTS_SQL} SELECT external_id, CASE WHEN takes THEN 'smycken' ELSE category END AS category, CASE WHEN takes THEN 'llm' ELSE category_conf END AS category_conf, CASE WHEN takes THEN 3 ELSE 1 END AS lot_count FROM (SELECT *, k % 2 = 0 AND category_conf NOT IN ('llm', 'human') AS takes FROM lots)")
def answers_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a service count where the present confidence ranks lower."""
    kinds = "struct<b:string,m:string,d:string,t:string,mat:string,y:int,reg:string>"
    rows = lots(spark, sf_dir).withColumns({"lot_count": lit(1), "attrs": lit(None).cast(kinds)})
    found = rows.filter(_key() % 2 == 0).select("house", "external_id", lit("smycken").alias("category"), lit(3).alias("n"), lit(None).cast(kinds).alias("attrs"))
    return answers.apply_verdicts(rows, found, ["house", "external_id"])[0].select("external_id", "category", "category_conf", "lot_count")


@query("title_rules_hit", "SELECT p_partkey, p_partkey % 4 < 3 AS hit FROM part")
def title_rules_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of three categories and one that no rule knows."""
    assert TITLE_RULES
    title = F.element_at(F.array(*[lit(t) for t in ("Volvo V70 kombi 2008", "Guldring 18k med safir", "LP-skiva vinyl Abba", "Okänd sak")]), (c("p_partkey") % 4 + 1).cast("int"))
    return spread(table(spark, sf_dir, "part")).select("p_partkey", classify.by_text(title).isNotNull().alias("hit"))
