"""Queries over sold history: fuzzy titles, look-ups, comparable sales, deals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import money
from ..functions.vectors import trigram_similarity
from ..operators import facets, fuzzy, price, search
from .adapt import AS_OF, HISTORY_SQL, ITEMS_SQL, LOTS_SQL, history, items, lots, ntz, table
from .registry import query


def _grams(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


def _sim(a: str, b: str) -> str:
    both = f"len(list_intersect({_grams(a)}, {_grams(b)}))"
    return f"({both} / (len({_grams(a)}) + len({_grams(b)}) - {both})::DOUBLE)"


def _stats(by: str, rows: str, value: str) -> str:
    """SQL of order statistics by place."""
    at = lambda q: f"s[least(n - 1, floor({q} * n)::BIGINT) + 1]"
    return f"SELECT {by}, n, {at(0.25)} AS p25, {at(0.5)} AS median, {at(0.75)} AS p75, s[1] AS low, s[n] AS high, floor(m + 0.5)::BIGINT AS mean FROM (SELECT {by}, count({value}) AS n, list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL)) AS s, avg({value}) AS m FROM {rows} GROUP BY {by}) WHERE n > 0"


@query("trigram_similarity", f"SELECT DISTINCT p_name, round({_sim('p_name', chr(39) + 'large red widgets' + chr(39))}, 9) AS similarity FROM part")
def trigram_similarity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select("p_name", F.round(trigram_similarity(F.col("p_name"), F.lit("large red widgets")), 9).alias("similarity"))


_NAMES = "names AS (SELECT DISTINCT p_name AS name FROM part)"


@query("fuzzy_join_parts", f"WITH {_NAMES}, p AS (SELECT x.name AS a, y.name AS b, {_sim('x.name', 'y.name')} AS s FROM names x, names y) SELECT a, b, round(s, 9) AS similarity FROM p WHERE a < b AND s >= 0.45")
def fuzzy_join_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return fuzzy.similar_pairs(names, "name", names, "name").filter("a < b").select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("history_fuzzy", f"WITH {HISTORY_SQL} SELECT house, external_id, title, final_bid FROM history WHERE title ILIKE '%gizmo%' OR {_sim('title', chr(39) + 'gizmos' + chr(39))} >= 0.3 ORDER BY ended_at DESC, house, external_id LIMIT 60")
def history_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir)
    alike = trigram_similarity(F.col("title"), F.lit("gizmos")) >= 0.3
    return rows.filter(F.col("title").ilike("%gizmo%") | alike).orderBy(F.desc("ended_at"), "house", "external_id").limit(60).select("house", "external_id", "title", "final_bid")


_SINCE = "2000-06-01 00:00:00"
_FOUND = f"WITH {HISTORY_SQL}, f AS (SELECT * FROM history WHERE sold AND ended_at <= TIMESTAMP '{AS_OF}' AND ended_at >= TIMESTAMP '{_SINCE}' AND title ILIKE '%red%' AND title ILIKE '%widget%' AND regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])red') AND regexp_matches(title, '(?i)(^|[^\\p{{L}}\\p{{N}}_])widget'))"


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price.lookup(history(spark, sf_dir), ["red", "widget"], ntz(_SINCE), ntz(AS_OF))


@query("price_lookup_stats", f"{_FOUND} SELECT house, round(quantile_cont(final_total, 0.25), 6) AS p25, round(quantile_cont(final_total, 0.5), 6) AS median, round(quantile_cont(final_total, 0.75), 6) AS p75, min(final_total) AS low, max(final_total) AS high, round(avg(final_total), 4) AS mean, count(final_total) AS n FROM f GROUP BY house")
def price_lookup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.percentiles(_found(spark, sf_dir), ["house"], "final_total")


@query("price_lookup_rows", f"{_FOUND} SELECT house, external_id, final_total, ended_at FROM f ORDER BY ended_at DESC, house, external_id LIMIT 30")
def price_lookup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).orderBy(F.desc("ended_at"), "house", "external_id").limit(30).select("house", "external_id", "final_total", "ended_at")


@query("price_lookup_series", f"{_FOUND} SELECT final_total, ended_at FROM f ORDER BY ended_at, final_total LIMIT 800")
def price_lookup_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).orderBy("ended_at", "final_total").limit(800).select("final_total", "ended_at")


@query("price_index_percentiles", f"WITH {HISTORY_SQL}, sales AS (SELECT * FROM history WHERE sold) {_stats('category', 'sales', 'final_total')}")
def price_index_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.index_percentiles(history(spark, sf_dir).filter("sold"), ["category"], "final_total")


_WORDS = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9åäöéü]+'), lambda w: length(w) >= 4)"
_ACTIVE = f"status = 'active' AND (ends_at IS NULL OR ends_at > TIMESTAMP '{AS_OF}')"


_COMPARED = f"""WITH {ITEMS_SQL}, {HISTORY_SQL},
t AS (SELECT DISTINCT title, split_part(category, '/', 1) AS main FROM items WHERE {_ACTIVE}),
x AS (SELECT DISTINCT title AS a FROM t), y AS (SELECT DISTINCT title AS b FROM history WHERE sold),
p AS (SELECT a, b, {_sim('a', 'b')} AS raw, {_WORDS('a')} AS wa,
             len(list_filter({_WORDS('a')}, lambda w: len(list_filter(regexp_split_to_array(lower(b), '[^a-z0-9åäöéü]+'), lambda z: starts_with(z, w))) > 0)) AS shared FROM x, y),
q AS (SELECT *, list_reduce(wa, lambda m, w: CASE WHEN length(w) > length(m) THEN w ELSE m END) AS word FROM p WHERE len(wa) > 0
      UNION ALL SELECT *, NULL FROM p WHERE len(wa) = 0),
g AS (SELECT a, b, CASE WHEN raw >= 0.45 THEN raw ELSE 0 END AS s FROM q
      WHERE (raw >= 0.45 OR coalesce(regexp_matches(b, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || word), false)) AND (raw >= 0.45 OR len(wa) < 2 OR shared >= 2)),
c AS (SELECT t.title, t.main, h.final_total AS price, h.external_id, s,
             row_number() OVER (PARTITION BY t.title, t.main ORDER BY s DESC, ended_at DESC, external_id) AS place
      FROM t JOIN g ON t.title = g.a JOIN history h ON h.title = g.b AND h.sold AND split_part(h.category, '/', 1) = t.main),
k AS (SELECT * FROM c WHERE place <= 250)"""


@query("price_stats_all_targets", f"{_COMPARED} SELECT * FROM ({_stats('title, main', 'k', 'price')}) WHERE n >= 3")
def price_stats_all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = search.Filters(as_of=ntz(AS_OF)).apply(items(spark, sf_dir))
    return price.price_stats(targets, history(spark, sf_dir))


@query("price_samples_all_targets", f"{_COMPARED} SELECT title, main, place::INT AS sample, external_id, round(s, 9) AS similarity, price FROM k WHERE place <= 15 QUALIFY count(*) OVER (PARTITION BY title, main) >= 3")
def price_samples_all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = search.Filters(as_of=ntz(AS_OF)).apply(items(spark, sf_dir))
    return price.price_samples(targets, history(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query(
    "deals",
    f"""WITH {ITEMS_SQL}, {HISTORY_SQL}, sales AS (SELECT * FROM history WHERE sold), e AS ({_stats('category', 'sales', 'final_total')}),
d AS (SELECT house, external_id, current_bid, CASE WHEN n >= 4 AND median > 0 AND p25 > 0 AND p75 <= 2.5 * p25 AND current_bid > 0 AND current_bid < p25
  AND ends_at > TIMESTAMP '{AS_OF}' AND ends_at <= TIMESTAMP '{AS_OF}' + INTERVAL 240 HOUR THEN round((median - current_bid)::DOUBLE / median * 100) END AS deal_percent
  FROM items JOIN e USING (category) WHERE status = 'active')
SELECT * FROM d WHERE deal_percent >= 15""",
)
def deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    estimates = facets.index_percentiles(history(spark, sf_dir).filter("sold"), ["category"], "final_total")
    rows = items(spark, sf_dir).filter("status = 'active'").join(estimates, "category")
    c = F.col
    percent = money.deal_percent(c("current_bid"), c("n"), c("median"), c("p25"), c("p75"), c("ends_at"), ntz(AS_OF), hours=240)
    return rows.withColumn("deal_percent", percent).filter("deal_percent >= 15").select("house", "external_id", "current_bid", "deal_percent")


@query("verdict_overlay", f"WITH v AS (SELECT doc_id, min(quality) AS q FROM labels GROUP BY doc_id), k AS (SELECT source, n_chars FROM documents JOIN v USING (doc_id) WHERE q <> 0) {_stats('source', 'k', 'n_chars')}")
def verdict_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q <> 0")
    return facets.index_percentiles(table(spark, sf_dir, "documents").join(verdicts, "doc_id"), ["source"], "n_chars")


_MODEL = lambda key: f"CASE {key} % 5 WHEN 0 THEN ' \"Nova 300\"' WHEN 1 THEN ', 2 st' WHEN 2 THEN ' \"Fyra Goda Stolar\"' WHEN 3 THEN ' nova fyra goda' ELSE '' END"
_TOKENS = "list_filter(regexp_split_to_array(lower(m), '[^a-z0-9åäöé]+'), lambda w: length(w) >= 3)"
_ALPHA = f"list_filter({_TOKENS}, lambda w: NOT regexp_matches(w, '[0-9]'))"
_HELD = f"(contains(lower(b), lower(m)) OR len(list_filter({_TOKENS}, lambda w: regexp_matches(w, '[0-9]') AND contains(lower(b), w))) > 0 OR len({_ALPHA}) > 0 AND len(list_filter({_ALPHA}, lambda w: contains(lower(b), w))) >= ceil(len({_ALPHA}) * 0.6))"
_COUNT = lambda x: f"TRY_CAST(regexp_extract({x}, '(\\d+) st$', 1) AS BIGINT)"
_MODELS_SQL = f"""WITH {ITEMS_SQL}, {HISTORY_SQL},
i AS (SELECT title || {_MODEL("part_id")} AS title, split_part(category, '/', 1) AS main FROM items WHERE {_ACTIVE}),
h AS (SELECT title || {_MODEL("split_part(external_id, '-', 3)::BIGINT")} AS title, split_part(category, '/', 1) AS main, final_total AS price, ended_at, external_id FROM history WHERE sold),
t AS (SELECT DISTINCT title, main FROM i), x AS (SELECT DISTINCT title AS a FROM t), y AS (SELECT DISTINCT title AS b FROM h),
p AS (SELECT a, b, {_sim('a', 'b')} AS raw, {_WORDS('a')} AS wa, len(list_filter({_WORDS('a')}, lambda w: len(list_filter(regexp_split_to_array(lower(b), '[^a-z0-9åäöéü]+'), lambda z: starts_with(z, w))) > 0)) AS shared,
             list_transform(regexp_extract_all(a, '"([^"]+)"', 1), lambda m: {_HELD}) AS held FROM x, y),
q AS (SELECT *, list_reduce(list_prepend('', wa), lambda m, w: CASE WHEN length(w) > length(m) THEN w ELSE m END) AS word FROM p),
g AS (SELECT a, b, CASE WHEN raw >= 0.45 THEN raw ELSE 0 END AS s, len(held) = 0 OR list_contains(held, true) AS strict FROM q
      WHERE (raw >= 0.45 OR word <> '' AND regexp_matches(b, '(?i)(^|[^\\p{{L}}\\p{{N}}_])' || word)) AND (raw >= 0.45 OR len(wa) < 2 OR shared >= 2)
        AND CASE WHEN {_COUNT('a')} > 1 THEN coalesce({_COUNT('b')} = {_COUNT('a')}, false) ELSE coalesce({_COUNT('b')} <= 1, true) END),
c AS (SELECT t.title, t.main, h.price, g.strict, row_number() OVER (PARTITION BY t.title, t.main ORDER BY s DESC, ended_at DESC, external_id) AS place FROM t JOIN g ON t.title = g.a JOIN h ON h.title = g.b AND h.main = t.main),
k AS (SELECT *, count(*) FILTER (WHERE strict) OVER (PARTITION BY title, main) < 3 AS loose FROM c WHERE place <= 250),
u AS (SELECT * FROM k WHERE strict OR loose)"""


def _with_models(rows: DataFrame, key: F.Column) -> DataFrame:
    """Titles with quoted models, counts and the bare words of a model."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (' "Nova 300"', ", 2 st", ' "Fyra Goda Stolar"', " nova fyra goda", "")]), (key % 5 + 1).cast("int"))
    return rows.withColumn("title", F.concat("title", ends))


@query("price_strict_loose", f"{_MODELS_SQL} SELECT * FROM ({_stats('title, main, loose', 'u', 'price')}) WHERE n >= 3")
def price_strict_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with models: strict comparables where there are three, else all."""
    targets = search.Filters(as_of=ntz(AS_OF)).apply(_with_models(items(spark, sf_dir), F.col("part_id")))
    sales = _with_models(history(spark, sf_dir), F.split_part("external_id", F.lit("-"), F.lit(3)).cast("long"))
    return price.price_stats(targets, sales, loose=True)


_EST = f"""WITH {LOTS_SQL}, l AS (SELECT *, CASE WHEN k % 2 = 0 THEN 1960 + k % 30 END AS y, category AS main, coalesce(category, 'fordon') AS s_main FROM lots),
s AS (SELECT * FROM l WHERE status = 'ended' AND current_bid > 0 AND reserve_status IS DISTINCT FROM 'not_met' AND (reserve_price IS NULL OR current_bid >= reserve_price)),
c AS (SELECT t.house, t.external_id, s.current_bid AS price, s.k AS sk, t.k AS tk, row_number() OVER (PARTITION BY t.k ORDER BY s.ends_at DESC, s.external_id) AS place
      FROM l t JOIN s ON s.title = t.title AND (t.main IS NULL OR t.main = s.s_main) AND s.k <> t.k AND coalesce(abs(s.y - t.y) <= 20, true)),
u AS (SELECT * FROM c WHERE place <= 250 AND NOT (tk % 3 = 0 AND sk = tk + 4)),
e AS (SELECT * FROM ({_stats('house, external_id', 'u', 'price')}) WHERE n >= 3)
SELECT l.house, l.external_id, coalesce(e.n, 0) AS n, e.median, e.p25, e.p75 FROM l LEFT JOIN e USING (house, external_id)"""


@query("item_estimates", _EST)
def item_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An estimate for every lot, without its own sale and the sales a person rejected for it; years must not clash."""
    from ..operators.merge import sales_of

    key = F.col("external_id").cast("long")
    facts = F.struct(*[F.lit(None).cast("string").alias(n) for n in price.ATTRIBUTES], F.when(key % 2 == 0, (1960 + key % 30).cast("int")).alias(price.YEAR))
    rows = lots(spark, sf_dir).withColumn("attrs", facts)
    sold = sales_of(rows.filter("status = 'ended'")).withColumn("final_total", F.col("final_bid")).join(rows.select("house", "external_id", "attrs", "reserve_price", "reserve_status", "category_conf"), ["house", "external_id"])
    others = lots(spark, sf_dir).select(F.col("house").alias("cmp_house"), F.col("external_id").alias("cmp_external_id"))
    rejected = rows.filter(key % 3 == 0).select("house", "external_id", (key + 4).cast("string").alias("cmp_external_id")).join(others, "cmp_external_id")
    return price.estimates(rows, sold, rejected).select("house", "external_id", "n", "median", "p25", "p75")


@query("public_prices", f"{_MODELS_SQL} SELECT title, main, count(price) AS n FROM u GROUP BY title, main HAVING count(price) >= 3")
def public_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What everybody may see: the number behind an estimate, never the sales."""
    return price.public(price_strict_loose(spark, sf_dir)).select("title", "main", "n")


@query(
    "price_model",
    """WITH r AS (SELECT p_type, ln(l_extendedprice) AS y, l_quantity AS a, l_discount * 100 AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT p_type, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS b_y, var_pop(y) AS yy FROM r GROUP BY p_type HAVING count(*) >= 30),
f AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS s1, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS s2 FROM s)
SELECT p_type, n, round(s1, 7) AS by_quantity, round(s2, 7) AS by_discount, round(my - s1 * ma - s2 * mb, 6) AS intercept, round((s1 * ay + s2 * b_y) / yy, 7) AS r2 FROM f""",
)
def price_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price on two features within each kind."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("p_type", F.log("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"))
    fit = price.price_model(rows, ["p_type"], "y", ["a", "b"])
    return fit.select("p_type", "n", F.round(F.col("slopes")[0], 7).alias("by_quantity"), F.round(F.col("slopes")[1], 7).alias("by_discount"), F.round("intercept", 6).alias("intercept"), F.round("r2", 7).alias("r2"))
