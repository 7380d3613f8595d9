"""Queries over items: listings, fees, search, facets and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import money, text as T
from ..functions.vectors import dot
from ..operators import facets, search
from ..operators.search import Filters
from ..rules import classify, fees
from ..rules.tables import CITY_NAMES, CONFIDENCE_RANK, FEE_MODELS, TAXONOMY
from .adapt import AS_OF, ITEMS_SQL, items, ntz, table
from .registry import query

_RATE_SQL = "CASE currency WHEN 'GBP' THEN 12.8 WHEN 'EUR' THEN 11.1 WHEN 'DKK' THEN 1.48 WHEN 'USD' THEN 9.7 WHEN 'NOK' THEN 0.98 WHEN 'CHF' THEN 12.0 ELSE 1.0 END"
_num = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE"
FEES_SQL = f"""models(house, currency, kind, rate, lo, hi, lot, pvat, fvat, approx, ext) AS (VALUES
  {", ".join("(" + ", ".join(_num(x) for x in row) + ")" for row in FEE_MODELS)}),
withmodel AS (
  SELECT i.*, coalesce(m.kind, r.kind, 'source') AS kind, CASE WHEN m.house IS NULL THEN r.rate ELSE m.rate END AS rate,
         CASE WHEN m.house IS NULL THEN r.lo ELSE m.lo END AS lo, CASE WHEN m.house IS NULL THEN r.hi ELSE m.hi END AS hi,
         CASE WHEN m.house IS NULL THEN r.lot ELSE m.lot END AS lot, CASE WHEN m.house IS NULL THEN r.pvat ELSE m.pvat END AS pvat,
         CASE WHEN m.house IS NULL THEN r.fvat ELSE m.fvat END AS fvat, coalesce(m.approx, r.approx, false) AS approx,
         coalesce(m.ext, r.ext, false) AS ext, coalesce(current_bid, min_bid, 0)::DOUBLE AS bid
  FROM items i LEFT JOIN models m ON i.house = m.house AND i.currency = m.currency
  LEFT JOIN models r ON i.house = r.house AND r.currency = '*'),
prem AS (
  SELECT *, CASE WHEN hi IS NULL THEN greatest(bid * rate, coalesce(lo, 0)) ELSE least(greatest(bid * rate, coalesce(lo, 0)), hi) END AS premium
  FROM withmodel),
raw AS (
  SELECT *,
    CASE WHEN kind = 'external' OR (kind = 'source' AND ext AND fee_value IS NULL) THEN 'external'
         WHEN kind = 'percentage' THEN 'percentage'
         WHEN (fee_value IS NOT NULL OR vat_rate IS NOT NULL) AND approx THEN 'estimate' ELSE 'source' END AS total_basis,
    CASE WHEN kind = 'percentage' THEN premium + coalesce(lot, 0) WHEN kind = 'source' THEN coalesce(fee_value, 0)::DOUBLE ELSE 0 END AS rawfee,
    CASE WHEN kind = 'percentage' THEN coalesce(pvat, 0) * premium + bid * (coalesce(vat_rate, 0) / 100)
         WHEN kind = 'source' THEN bid * (coalesce(vat_rate, 0) / 100) + coalesce(fee_value, 0) * coalesce(fvat, vat_rate, 0) / 100 ELSE 0 END AS rawvat
  FROM prem),
totals AS (
  SELECT *, CASE WHEN total_basis = 'external' THEN 0 ELSE floor(rawfee + 0.5)::BIGINT END AS fee,
         CASE WHEN total_basis = 'external' THEN 0 ELSE floor(rawvat + 0.5)::BIGINT END AS vat,
         CASE WHEN total_basis = 'external' THEN floor(bid + 0.5)::BIGINT WHEN bid > 0 THEN floor(bid + rawfee + rawvat + 0.5)::BIGINT END AS total_price
  FROM raw)"""
_ACTIVE = f"status = 'active' AND (ends_at IS NULL OR ends_at > TIMESTAMP '{AS_OF}')"


def _active(**kw) -> Filters:
    return Filters(as_of=ntz(AS_OF), **kw)


@query(
    "list_active_ending",
    f"WITH {ITEMS_SQL}, {FEES_SQL} SELECT house, external_id, title, current_bid, fee, vat, total_price, total_basis, ends_at FROM totals WHERE {_ACTIVE} ORDER BY ends_at NULLS LAST, house, external_id LIMIT 100",
)
def list_active_ending(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.list_items(items(spark, sf_dir), _active(), "ending", 100)
    return fees.with_total(page).select("house", "external_id", "title", "current_bid", "fee", "vat", "total_price", "total_basis", "ends_at")


@query(
    "list_price_low",
    f"WITH {ITEMS_SQL}, {FEES_SQL} SELECT house, external_id, currency, total_price FROM totals WHERE {_ACTIVE} AND category LIKE 'economy/%' AND coalesce(total_price, current_bid, min_bid) BETWEEN 1000 AND 60000 ORDER BY coalesce(total_price, current_bid, min_bid) * {_RATE_SQL}, house, external_id LIMIT 50",
)
def list_price_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = fees.with_total(items(spark, sf_dir))
    return search.list_items(priced, _active(category="economy", min_price=1000, max_price=60000), "price_low", 50).select("house", "external_id", "currency", "total_price")


@query("list_fewest_bids", f"WITH {ITEMS_SQL} SELECT house, external_id, bid_count, ends_at FROM items WHERE {_ACTIVE} AND house NOT IN ('bna', 'siko') ORDER BY bid_count NULLS LAST, ends_at NULLS LAST, house, external_id LIMIT 60")
def list_fewest_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.list_items(items(spark, sf_dir), _active(hidden=("bna", "siko")), "fewest", 60).select("house", "external_id", "bid_count", "ends_at")


@query("list_most_bids_page", f"WITH {ITEMS_SQL} SELECT house, external_id, bid_count, ends_at FROM items WHERE {_ACTIVE} AND house IN ('tovek', 'klaravik') AND ends_at <= TIMESTAMP '2001-09-01' AND seller = 'Brand#7' ORDER BY bid_count DESC NULLS LAST, ends_at NULLS LAST, house, external_id LIMIT 20 OFFSET 5")
def list_most_bids_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _active(houses=("tovek", "klaravik"), ends_before=ntz("2001-09-01 00:00:00"), seller="Brand#7")
    return search.list_items(items(spark, sf_dir), chosen, "bids", 20, 5).select("house", "external_id", "bid_count", "ends_at")


@query("list_newest_place", f"WITH {ITEMS_SQL} SELECT house, external_id, location, ends_at FROM items WHERE regexp_matches(location, '(?i)nation_1|NATION_2$') ORDER BY ends_at DESC NULLS LAST, house, external_id LIMIT 40")
def list_newest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).filter(F.col("location").rlike("(?iu)nation_1|NATION_2$")).withColumns({"listed_at": F.col("ends_at"), "first_seen": F.lit(None).cast("timestamp_ntz")})
    return search.list_items(rows, Filters(include_ended=True), "newest", 40).select("house", "external_id", "location", "ends_at")


@query("fee_totals", f"WITH {ITEMS_SQL}, {FEES_SQL} SELECT house, external_id, fee, vat, total_price, total_basis FROM totals")
def fee_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fees.with_total(items(spark, sf_dir)).select("house", "external_id", "fee", "vat", "total_price", "total_basis")


@query("fee_basis_mix", f"WITH {ITEMS_SQL}, {FEES_SQL} SELECT house, total_basis, count(*) AS n, sum(total_price)::BIGINT AS total, sum(fee)::BIGINT AS fees FROM totals GROUP BY house, total_basis")
def fee_basis_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fees.with_total(items(spark, sf_dir)).groupBy("house", "total_basis").agg(F.count(F.lit(1)).alias("n"), F.sum("total_price").alias("total"), F.sum("fee").alias("fees"))


@query("fx_normalised_price", f"WITH {ITEMS_SQL} SELECT currency, count(*) AS n, round(max(coalesce(current_bid, min_bid) * ({_RATE_SQL})::DOUBLE), 4) AS high, round(min(coalesce(current_bid, min_bid) * ({_RATE_SQL})::DOUBLE), 4) AS low FROM items GROUP BY currency")
def fx_normalised_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("sek", money.shown_price(F.col("current_bid"), F.col("min_bid"), F.col("currency")))
    return rows.groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("sek"), 4).alias("high"), F.round(F.min("sek"), 4).alias("low"))


@query("fx_rates_join", f"WITH {ITEMS_SQL}, rates(currency, rate) AS (VALUES ('SEK', 1.0), ('EUR', 11.27), ('GBP', 13.1), ('DKK', 1.51)) SELECT currency, count(*) AS n, sum(round(current_bid * rate * 100)::BIGINT)::BIGINT AS cents FROM items JOIN rates USING (currency) GROUP BY currency")
def fx_rates_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame([("SEK", 1.0), ("EUR", 11.27), ("GBP", 13.1), ("DKK", 1.51)], "currency string, rate double")
    rows = items(spark, sf_dir).join(rates, "currency")
    return rows.groupBy("currency").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("current_bid") * F.col("rate") * 100).cast("long")).alias("cents"))


@query("category_facets", f"WITH {ITEMS_SQL} SELECT category, count(*) AS n FROM items WHERE {_ACTIVE} GROUP BY category")
def category_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.category_counts(_active().apply(items(spark, sf_dir)))


_TREE = ", ".join(f"('{m}', '{s}')" for m, _, s, _ in TAXONOMY)


@query(
    "category_rollup",
    f"""WITH tree(main, sub) AS (VALUES {_TREE}),
keyed AS (SELECT list_extract((SELECT list(main || '/' || sub ORDER BY main, sub) FROM tree), (p_partkey % 50 + 1)::INT) AS category FROM part),
c AS (SELECT category, count(*) AS n FROM keyed GROUP BY category)
SELECT main, sub, coalesce(n, 0) AS n FROM tree LEFT JOIN c ON category = main || '/' || sub
UNION ALL
SELECT main, NULL, coalesce(sum(n), 0)::BIGINT FROM (SELECT DISTINCT main FROM tree) LEFT JOIN c ON split_part(category, '/', 1) = main GROUP BY main""",
)
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = sorted((m, s) for m, _, s, _ in TAXONOMY)
    key = F.element_at(F.array(*[F.lit(f"{m}/{s}") for m, s in keys]), (F.col("p_partkey") % 50 + 1).cast("int"))
    counts = facets.category_counts(table(spark, sf_dir, "part").select(key.alias("category")))
    return facets.rollup_counts(counts, facets.taxonomy(spark).select("main", "sub"))


@query(
    "location_facets",
    f"""WITH {ITEMS_SQL}, p AS (SELECT lower(trim(split_part(regexp_replace(coalesce('123 45 ' || location || ', X', ''), '^[0-9 ]+', ''), ',', 1))) AS place FROM items WHERE {_ACTIVE})
SELECT place, count(*) AS n FROM p WHERE place <> '' GROUP BY place ORDER BY n DESC, place LIMIT 40""",
)
def location_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _active().apply(items(spark, sf_dir)).withColumn("location", F.concat(F.lit("123 45 "), "location", F.lit(", X")))
    return facets.location_counts(rows)


@query("house_counts", f"WITH {ITEMS_SQL} SELECT house, count(*) AS n FROM items WHERE {_ACTIVE} AND house NOT IN ('retrade') GROUP BY house")
def house_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.counts_by(_active(hidden=("retrade",)).apply(items(spark, sf_dir)), "house")


@query("seller_counts", f"WITH {ITEMS_SQL} SELECT house, seller, count(*) AS n FROM items WHERE {_ACTIVE} GROUP BY house, seller")
def seller_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.counts_by(_active().apply(items(spark, sf_dir)), "house", "seller")


@query("house_dashboard", f"WITH {ITEMS_SQL} SELECT house, count(*) AS lots, count(*) FILTER (WHERE status = 'active') AS active, count(*) FILTER (WHERE status = 'active' AND ends_at <= TIMESTAMP '{AS_OF}') AS overdue, round(100.0 * count(fee_value) / count(*), 1) AS fee_percent, round(avg(bid_count), 3) AS avg_bids FROM items GROUP BY house")
def house_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.house_dashboard(items(spark, sf_dir), ntz(AS_OF))


@query("global_counts", f"WITH {ITEMS_SQL} SELECT count(*) AS lots, count(*) FILTER (WHERE status = 'active') AS active, count(DISTINCT house) AS houses, count(DISTINCT category) AS categories FROM items")
def global_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.global_counts(items(spark, sf_dir))


@query("houses_with_counts", f"WITH {ITEMS_SQL}, h(house) AS (VALUES ('tovek'), ('bna'), ('budi'), ('unknown')) SELECT h.house, coalesce(c.n, 0) AS n FROM h LEFT JOIN (SELECT house, count(*) AS n FROM items WHERE status = 'active' GROUP BY house) c USING (house)")
def houses_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("tovek",), ("bna",), ("budi",), ("unknown",)], "house string")
    counts = facets.counts_by(items(spark, sf_dir), "house", only=F.col("status") == "active")
    return known.join(counts, "house", "left").select("house", F.coalesce("n", F.lit(0)).alias("n"))


_HIT = f"WITH {ITEMS_SQL}, t AS (SELECT DISTINCT title FROM items)"


@query(
    "tier_search",
    f"""WITH {ITEMS_SQL}, h AS (SELECT *, CASE WHEN title ILIKE '%red widget%' THEN 1
  WHEN regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])red') AND regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])widget') THEN 2
  WHEN coalesce(seller ILIKE '%red widget%', false) THEN 3
  WHEN regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(scarlet|crims|gizmo)') THEN 4
  WHEN title ILIKE '%red%' AND title ILIKE '%widget%' THEN 5 END AS tier FROM items WHERE {_ACTIVE})
SELECT house, external_id, title, tier FROM h WHERE tier IS NOT NULL ORDER BY tier, ends_at NULLS LAST, house, external_id LIMIT 200""",
)
def tier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(items(spark, sf_dir), "red widget", _active(), limit=200, synonyms=["scarlet", "crims", "gizmo"], text_cols=("seller",))
    return found.select("house", "external_id", "title", "tier")


@query("all_words_search", f"{_HIT} SELECT title FROM t WHERE regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])sma') AND regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])gi')")
def all_words_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = items(spark, sf_dir).select("title").distinct()
    return titles.filter(search.tier("sma gi", text_cols=()) == 2)


@query("phrase_search_wildcards", f"{_HIT} SELECT title, title ILIKE '%d_w%' AS wild, title ILIKE '%d\\_w%' ESCAPE '\\' AS literal FROM t")
def phrase_search_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = items(spark, sf_dir).select("title").distinct()
    both = [F.coalesce(search.tier("d_w", text_cols=(), literal=x) == 1, F.lit(False)) for x in (False, True)]
    return titles.select("title", both[0].alias("wild"), both[1].alias("literal"))


@query("synonym_search_documents", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])(licens|apache)')")
def synonym_search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.regex import any_term, matches

    return table(spark, sf_dir, "documents").filter(matches("text", any_term(["licens", "apache"]))).select("doc_id")


_COS = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"])


_RRF = f"""WITH {ITEMS_SQL}, x AS (SELECT *, CASE WHEN title ILIKE '%ring%' THEN 1 WHEN seller ILIKE '%ring%' THEN 3 END AS tier FROM items WHERE {_ACTIVE}),
lex AS (SELECT part_id, tier, row_number() OVER (ORDER BY tier, ends_at, house, external_id) AS lrank FROM (SELECT * FROM x WHERE tier IS NOT NULL ORDER BY tier, ends_at, house, external_id LIMIT 450)),
l AS (SELECT part_id, min(tier) AS tier, min(lrank) AS lrank FROM lex GROUP BY part_id),
v AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
g AS (SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS dev FROM v),
s AS (SELECT vec_id AS part_id, row_number() OVER (ORDER BY score DESC, vec_id) AS srank FROM v, g WHERE n >= 50 AND score >= greatest(0.2, mean + 1.0 * dev) ORDER BY score DESC, vec_id LIMIT 300)
SELECT part_id, lrank, srank, round(coalesce(1.0 / (60 + lrank), 0) + coalesce(0.5 / (60 + srank), 0), 9) AS rrf,
       CASE WHEN tier <= 2 THEN 0 WHEN tier IS NOT NULL THEN 1 ELSE 2 END AS bucket
FROM l FULL JOIN s USING (part_id)"""


@query("full_outer_rrf", _RRF)
@query("semantic_rrf", _RRF)
def semantic_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical and semantic ranks of parts, fused."""
    hits = search.lexical(items(spark, sf_dir), "ring", _active(), text_cols=("seller",))
    lex = search.ranked(hits, search.KEY, 50 + search.LEXICAL_MARGIN)
    lex = lex.groupBy("part_id").agg(F.min("tier").alias("tier"), F.min("lrank").alias("lrank"))
    sem = search.semantic_top(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), ["vec_id"], floor=0.2, z=1.0)
    sem = sem.select(F.col("vec_id").alias("part_id"), "srank")
    return search.fuse(lex, sem, ["part_id"]).select("part_id", "lrank", "srank", F.round("rrf", 9).alias("rrf"), "bucket")


@query("cosine_topk", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT 25")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.scored(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir)).orderBy(F.desc("score"), "vec_id").limit(25)
    return rows.select("vec_id", F.round("score", 6).alias("score"))


@query(
    "semantic_zgate",
    f"""WITH s AS (SELECT e.vec_id, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
g AS (SELECT count(*) AS n, avg(score) AS mean, stddev_pop(score) AS dev FROM s)
SELECT vec_id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, vec_id) AS srank
FROM s, g WHERE n >= 50 AND score >= greatest(0.2, mean + 1.0 * dev) ORDER BY s.score DESC, vec_id LIMIT 300""",
)
def semantic_zgate(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.semantic_top(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), ["vec_id"], floor=0.2, z=1.0)
    return top.select("vec_id", F.round("score", 6).alias("score"), "srank")


@query("visual_neighbours", f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id <> 7 AND {_COS} >= 0.2 ORDER BY {_COS} DESC, e.vec_id LIMIT 12")
def visual_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", 7, least=0.2).select("vec_id", F.round("score", 6).alias("score"))


@query("pair_match_percent", f"SELECT e.vec_id, q.vec_id AS other, floor(100 * {_COS} + 0.5)::BIGINT AS percent FROM embeddings e JOIN embeddings q ON q.vec_id = e.vec_id + 1")
def pair_match_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.col("embedding").alias("x")), e.select(F.col("vec_id").alias("other"), F.col("embedding").alias("y"))
    return a.join(b, b.other == a.vec_id + 1).select("vec_id", "other", money.half_up(100 * dot(F.col("x"), F.col("y"))).cast("long").alias("percent"))


@query("confidence_rank", "WITH c(confidence) AS (VALUES " + ", ".join(f"('{c}')" for c in [*CONFIDENCE_RANK, "odd"]) + ") SELECT confidence, CASE confidence " + " ".join(f"WHEN '{c}' THEN {r}" for c, r in CONFIDENCE_RANK.items()) + " ELSE 0 END AS rank FROM c")
def confidence_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in [*CONFIDENCE_RANK, "odd"]], "confidence string")
    return rows.select("confidence", classify.confidence_rank(F.col("confidence")).alias("rank"))


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.keyset_page(table(spark, sf_dir, "orders"), "o_orderkey", 500, 100).select("o_orderkey", "o_totalprice")


@query("main_image_top1", "SELECT user_id, arg_min(event_id, value * 1000000000 + event_id) AS event_id, min(value) AS value FROM events WHERE NOT regexp_matches(event_type, '^err') GROUP BY user_id")
def main_image_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(~F.col("event_type").rlike("^err"))
    return facets.first_by(rows, ["user_id"], F.struct("value", "event_id"), "event_id", "value")


@query("latest_event_per_user", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    return latest.select("user_id", "m.event_id", "m.event_type")


@query("running_max_bid", "SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current_bid, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bid_count FROM events")
def running_max_bid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.max("value").over(w).alias("current_bid"), F.count(F.lit(1)).over(w).alias("bid_count"))


@query("city_names", "WITH c(place) AS (VALUES " + ", ".join(f"('{c}')" for c in [*CITY_NAMES, "Uppsala"]) + ") SELECT place, CASE lower(trim(place)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CITY_NAMES.items()) + " ELSE place END AS city FROM c")
def city_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(c,) for c in [*CITY_NAMES, "Uppsala"]], "place string")
    return rows.select("place", T.city_name(F.col("place")).alias("city"))


@query("embedding_progress", "SELECT label, count(*) AS vectors, count(*) FILTER (WHERE vec_id % 3 = 0) AS third, round(100.0 * count(*) FILTER (WHERE vec_id % 3 = 0) / count(*), 2) AS percent FROM embeddings GROUP BY label")
def embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    found = facets.coverage(rows, rows.filter("vec_id % 3 = 0"), ["vec_id"], "label", digits=2)
    return found.select("label", F.col("n").alias("vectors"), F.col("covered").alias("third"), "percent")
