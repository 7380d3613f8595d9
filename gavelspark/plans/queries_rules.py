"""Queries of the rule engine: scalar functions, classification, lexicon, work queues."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import money, text as T, times, vectors
from ..operators import price
from ..rules import classify
from ..rules.tables import FEE_KNOTS, STOP_WORDS
from ..sources import html as H
from .adapt import AS_OF, ITEMS_SQL, items, ntz, spread, table
from .registry import query

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOKENS = f"list_filter(regexp_split_to_array(lower(text), '[^a-zåäöéü]+'), lambda w: length(w) >= 3 AND NOT list_contains([{_STOP}], w))"
#: Distinct in order of first appearance, at most twelve.
_FIRST = "array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda z: list_position(l, z[1]) = z[2]), lambda z: z[1])[1:12], ' ')"


_TOKENS_SQL = f"WITH t AS (SELECT doc_id, {_TOKENS} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, {_FIRST} AS tokens FROM t"


@query("tokens", _TOKENS_SQL)
@query("tokens_whole", _TOKENS_SQL)
def tokens_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", F.array_join(T.title_tokens(F.col("text")), " ").alias("tokens"))


_LEX = "seen AS (SELECT DISTINCT w AS token, lower(p_type) AS category, p_partkey FROM part, unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS u(w) WHERE length(w) >= 3 AND w NOT IN ('set', 'par', 'old', 'new') OR w IN ('old', 'new') AND length(w) >= 3), lex AS (SELECT token, category, count(*) AS seen FROM seen GROUP BY token, category)"


def part_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.train_lexicon(table(spark, sf_dir, "part").withColumn("kind", F.lower("p_type")), "p_name", "kind")


@query("lexicon_train", f"WITH {_LEX} SELECT token, category, seen FROM lex")
def lexicon_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_lexicon(spark, sf_dir)


LEXICON_SQL = f"""{_LEX}, w AS (SELECT token, category, seen, seen * (max(seen) OVER (PARTITION BY token) / (sum(seen) OVER (PARTITION BY token))::DOUBLE) AS w FROM lex),
t AS (SELECT DISTINCT p_name, u.x AS token FROM part, unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS u(x)),
s AS (SELECT p_name, category, sum(w) AS w, sum(seen) AS evidence FROM t JOIN w USING (token) GROUP BY p_name, category),
b AS (SELECT *, sum(w) OVER (PARTITION BY p_name) AS total, row_number() OVER (PARTITION BY p_name ORDER BY round(w, 9) DESC, category) AS rn FROM s),
votes AS (SELECT p_partkey, category, evidence::BIGINT AS evidence, round(w / total, 6) AS share FROM part JOIN b USING (p_name) WHERE rn = 1 AND evidence >= 12 AND w / total >= 0.17)"""


@query("lexicon_vote", f"WITH {LEXICON_SQL} SELECT * FROM votes")
def lexicon_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    won = classify.vote(table(spark, sf_dir, "part"), "p_partkey", "p_name", part_lexicon(spark, sf_dir), min_share=0.17)
    return won.select("p_partkey", "category", "evidence", F.round("share", 6).alias("share"))


_MAINS_SQL = """WITH k AS (SELECT *, split_part(p_name, ' ', 1) AS a FROM part),
seen AS (SELECT DISTINCT w AS token, a || '/y' AS category, p_partkey FROM k, unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS u(w) WHERE a <> 'cold' AND length(w) >= 3),
lex AS (SELECT token, category, count(*) AS seen FROM seen GROUP BY token, category),
w AS (SELECT token, category, seen, seen * (max(seen) OVER (PARTITION BY token) / (sum(seen) OVER (PARTITION BY token))::DOUBLE) AS w FROM lex),
sales AS (SELECT p_partkey, CASE WHEN p_size % 7 = 3 THEN 'Guldring 18k med safir' ELSE p_name END AS title, CASE WHEN p_size % 7 = 3 THEN NULL WHEN p_size % 3 > 0 THEN lower(p_type) END AS stored, p_size % 5 = 0 AS trusted FROM part),
t AS (SELECT DISTINCT title, u.x AS token FROM sales, unnest(regexp_split_to_array(lower(title), '[^a-z]+')) AS u(x)),
s AS (SELECT title, category, sum(w) AS w, sum(seen) AS evidence FROM t JOIN w USING (token) GROUP BY title, category),
b AS (SELECT *, sum(w) OVER (PARTITION BY title) AS total, row_number() OVER (PARTITION BY title ORDER BY round(w, 9) DESC, category) AS rn FROM s),
votes AS (SELECT title, split_part(category, '/', 1) AS voted FROM b WHERE rn = 1 AND evidence >= 12 AND w / total >= 0.75)
SELECT p_partkey, coalesce(CASE WHEN trusted THEN stored END, voted, stored, CASE WHEN title LIKE 'Guldring%' OR title LIKE '% ring' THEN 'smycken' END) AS main FROM sales LEFT JOIN votes USING (title)"""


@query("sale_main_categories", _MAINS_SQL)
def sale_main_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main categories of sales by all four sources: a trusted category, the lexicon, the stored one, the title's words.
    The lexicon knows names by their first word, but for one of them; every third stored category is unsorted."""
    parts = table(spark, sf_dir, "part")
    word, size, ring = F.substring_index("p_name", " ", 1), F.col("p_size"), F.col("p_size") % 7 == 3
    lexicon = classify.train_lexicon(parts.filter(word != "cold").withColumn("kind", F.concat(word, F.lit("/y"))), "p_name", "kind")
    category = F.when(ring, F.lit(None).cast("string")).when(size % 3 > 0, F.concat(F.lower("p_type"), F.lit("/x"))).otherwise("ovrigt/partier")
    sales = parts.select("p_partkey", F.when(ring, "Guldring 18k med safir").otherwise(F.col("p_name")).alias("title"), category.alias("category"), F.when(size % 5 == 0, "human").otherwise("house").alias("category_conf"))
    return price.sale_mains(sales, lexicon).select("p_partkey", F.col("s_main").alias("main"))


@query(
    "conflict_flag",
    "SELECT p_partkey, p_partkey % 3 = 0 AND lower(split_part(p_type, ' ', 1)) <> CASE WHEN p_size > 25 THEN 'promo' ELSE 'large' END AS conflict FROM part",
)
def conflict_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    house = F.when(F.col("p_size") > 25, "promo/x").otherwise("large/y")
    confidence = F.when(F.col("p_partkey") % 3 == 0, "text").otherwise("house")
    return table(spark, sf_dir, "part").select("p_partkey", classify.conflict(F.concat(F.lower("p_type"), F.lit("/z")), confidence, house).alias("conflict"))


@query(
    "review_queue",
    f"WITH {ITEMS_SQL}, q AS (SELECT *, flag = 'R' AS conflict, CASE flag WHEN 'N' THEN 3 WHEN 'A' THEN 2 ELSE 0 END AS rank FROM items WHERE status = 'active' AND house NOT IN ('bna')) SELECT house, external_id, conflict, rank FROM q ORDER BY conflict DESC, rank, ends_at NULLS LAST, house, external_id LIMIT 50",
)
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("flag") == "N", "house").when(F.col("flag") == "A", "text").otherwise("none")
    rows = items(spark, sf_dir).filter("status = 'active'").filter(~F.col("house").isin("bna"))
    rows = rows.withColumns({"conflict": F.col("flag") == "R", "rank": classify.confidence_rank(confidence)})
    return rows.orderBy(F.desc("conflict"), "rank", F.col("ends_at").asc_nulls_last(), "house", "external_id").limit(50).select("house", "external_id", "conflict", "rank")


def derived(name: str, fn: Callable[[Column], Column], x: Callable[[], Column], y: str) -> None:
    """A query that applies a scalar function to a text made from the columns of each part; ``y`` is SQL of what it must
    give, from the same columns."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spread(table(spark, sf_dir, "part")).select("p_partkey", fn(x()).alias("y"))

    query(name, f"SELECT p_partkey, {y} AS y FROM part")(run)


def _by(step: int, *texts: str | Column) -> Column:
    """One of the texts, by a part's size."""
    return F.element_at(F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts]), (F.col("p_size") % step + 1).cast("int"))


def _said(*parts: str | Column) -> Column:
    """Column names and columns in brackets of literal text: names start with p_."""
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("p_") else p for p in parts])


_TITLES = {"Volvo V70 kombi 2008": "fordon/personbilar", "Guldring 18k med safir": "smycken/smycken-sub", "Matta, stol och dator": "ovrigt/partier", "Diverse dödsbo": "ovrigt/partier", "Okänd sak": None, "LP-skiva vinyl Abba": "media/vinyl"}
_NUMBER = "lpad((p_partkey % 1000)::VARCHAR, 3, '0')"
derived("keyword_classify", classify.by_text, lambda: _by(6, *_TITLES), "CASE p_size % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(_TITLES.values()) if v) + " END")
derived("lot_count", T.lot_count, lambda: _by(4, _said("p_size", " st ", "p_name"), _said("Ett par ", "p_name"), _said("p_name", ", par"), F.col("p_name")), "CASE p_size % 4 WHEN 0 THEN nullif(p_size, 0) WHEN 1 THEN 2 WHEN 2 THEN 2 END::BIGINT")
derived("plate_regex", T.plate, lambda: _by(3, _said("p_name", " abc ", F.col("p_partkey") % 900 + 100, " röd"), _said("AAA000 ", "p_name"), F.col("p_name")), "CASE WHEN p_size % 3 = 0 THEN 'ABC' || (p_partkey % 900 + 100) END")
derived("swedish_number", T.number, lambda: _by(3, _said("p_size", " ", F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), ",50"), _said("p_size", ".500"), F.col("p_name")), "CASE p_size % 3 WHEN 0 THEN p_size * 1000 + p_partkey % 1000 + 0.5 WHEN 1 THEN p_size * 1000 + 500 END::DOUBLE")
derived("slugify", T.slug, lambda: _said("Åkerö & ", "p_name", ", 2:a "), "'akero-' || replace(p_name, ' ', '-') || '-2-a'")
derived("countdown", times.countdown_seconds, lambda: _by(3, _said(F.col("p_size") % 4, " dygn ", F.col("p_size") % 24, " tim"), _said(F.col("p_partkey") % 60, " minuter"), F.lit("snart")), "CASE p_size % 3 WHEN 0 THEN p_size % 4 * 86400 + p_size % 24 * 3600 WHEN 1 THEN p_partkey % 60 * 60 END::BIGINT")
derived("quoted_models", lambda x: F.array_join(T.quoted_models(x), "|"), lambda: _by(2, _said('Fåtölj "', "p_brand", '" av "', "p_type", '"'), _said("p_name", ' "x" ”Lamino” stol')), "CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_type ELSE 'Lamino' END")
derived("condition_badge", T.condition_badge, lambda: _by(4, _said("p_name", " Ny i kartong"), _said("helt OANVÄND vara ", "p_name"), _said("p_name", " ej testad"), _said("oanvändbar ", "p_name")), "CASE p_size % 4 WHEN 0 THEN 'ny' WHEN 1 THEN 'ny' WHEN 2 THEN 'otestad' END")
derived("normalise_query", T.normalise_query, lambda: _said("  ", F.upper("p_name"), "   STOL "), "p_name || ' stol'")
derived("clock_minutes", times.clock_minutes, lambda: _said(F.col("p_size") % 30, ":", F.lpad((F.col("p_partkey") % 70).cast("string"), 2, "0")), "CASE WHEN p_size % 30 < 24 AND p_partkey % 70 < 60 THEN p_size % 30 * 60 + p_partkey % 70 END::INTEGER")
derived("html_entities", T.strip_html, lambda: _said("<p>", "p_name", " &amp; B</p><script>x</script> <b>&lt;", "p_type", "&gt;</b>"), "p_name || ' & B <' || p_type || '>'")
derived("item_text", lambda x: T.item_text(F.lit("Stol"), x), lambda: _by(2, _said("  ", "p_name", " \n fin "), F.lit(" ")), "CASE WHEN p_size % 2 = 0 THEN 'Stol. ' || p_name || ' fin' ELSE 'Stol' END")
derived("spec_value", lambda x: T.label_value(x, "Höjd", ("Bredd", "Vikt")), lambda: _by(2, _said("p_name", " Höjd: ", "p_size", " cm Bredd: 10"), _said("Vikt: ", "p_size")), "CASE WHEN p_size % 2 = 0 THEN p_size || ' cm' END")
derived("image_url", T.image_url, lambda: _said("https://a/", "p_partkey", _by(3, "_thumb", "-640x480", ""), ".jpg"), "'https://a/' || p_partkey || '.jpg'")
derived("fitted_text", lambda x: T.fitted(x, 10), lambda: F.col("p_name"), "CASE WHEN length(p_name) <= 10 THEN p_name ELSE rtrim(left(p_name, 9)) || '…' END")
derived("worth_expanding", T.worth_expanding, lambda: _by(4, _said(" ", F.upper("p_name")), _said("p_size", " 34"), F.lit("abc"), F.repeat("p_name", 20)), "p_size % 4 = 0 AND regexp_matches(p_name, '[a-z]{4}')")


@query("normalise_location", "SELECT c_custkey, 'nation_' || c_nationkey AS place FROM customer")
def normalise_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("123 45 NATION_"), F.col("c_nationkey").cast("string"), F.lit(", Sverige"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalise_location(raw).alias("place"))


def _steps() -> str:
    out = [f"WHEN x <= {FEE_KNOTS[0][0]} THEN {FEE_KNOTS[0][1]}"]
    for (x0, y0), (x1, y1) in zip(FEE_KNOTS, FEE_KNOTS[1:]):
        cond = f"WHEN x <= {x1} THEN" if (x1, y1) != FEE_KNOTS[-1] else "ELSE"
        out.append(f"{cond} floor({y0} + (x - {x0}) / {float(x1 - x0)} * ({y1 - y0}) + 0.5)")
    return "CASE " + " ".join(out) + " END"


@query("step_interpolation", f"SELECT o_orderkey, {_steps().replace('x ', 'o_totalprice ')}::DOUBLE AS fee FROM orders")
def step_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", money.stepwise(F.col("o_totalprice")).cast("double").alias("fee"))


@query("month_rule_utc", "SELECT o_orderkey, o_orderdate - CASE WHEN month(o_orderdate) BETWEEN 4 AND 10 THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END AS utc FROM orders")
def month_rule_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", times.month_rule_utc(F.col("o_orderdate")).alias("utc"))


@query("age_status", f"SELECT o_orderkey, CASE WHEN m < 45 THEN 'ok' WHEN m < 180 THEN 'slow' ELSE 'stale' END AS status FROM (SELECT o_orderkey, epoch(TIMESTAMP '{AS_OF}' - o_orderdate) / 60 AS m FROM orders)")
def age_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", times.freshness(times.age_minutes(F.col("o_orderdate"), ntz(AS_OF))).alias("status"))


@query("haversine_matrix", "WITH p AS (SELECT n_nationkey AS k, 55.0 + n_nationkey * 0.4 AS lat, 12.0 + n_nationkey * 0.3 AS lon FROM nation) SELECT a.k AS a, b.k AS b, round(1.3 * 2 * 6371000 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))), 3) AS metres FROM p a JOIN p b ON a.k < b.k")
def haversine_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), (55.0 + F.col("n_nationkey") * 0.4).alias("lat"), (12.0 + F.col("n_nationkey") * 0.3).alias("lon"))
    a, b = p.select(*[F.col(c).alias("a_" + c) for c in p.columns]), p.select(*[F.col(c).alias("b_" + c) for c in p.columns])
    metres = 1.3 * vectors.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    return a.join(b, F.col("a_k") < F.col("b_k")).select(F.col("a_k").alias("a"), F.col("b_k").alias("b"), F.round(metres, 3).alias("metres"))


@query("html_title_strip", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"'))::BIGINT AS links FROM pages")
def html_title_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.tag_text(F.col("html"), "h1").alias("title"), H.link_count(F.col("html")).alias("links"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", H.raw_field(F.col("props"), "k", "long").alias("k"))


@query("chart_axis", "SELECT o_orderkey, p * CASE WHEN x / p <= 1 THEN 1 WHEN x / p <= 2 THEN 2 WHEN x / p <= 5 THEN 5 ELSE 10 END AS top FROM (SELECT o_orderkey, o_totalprice AS x, pow(10.0, floor(log10(o_totalprice))) AS p FROM orders)")
def chart_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", money.nice_ceiling(F.col("o_totalprice")).alias("top"))


@query("fee_calibration", "WITH p AS (SELECT l_partkey, min(l_quantity) AS x1, max(l_quantity) AS x2, min(l_extendedprice) AS f1, max(l_extendedprice) AS f2 FROM lineitem GROUP BY l_partkey), s AS (SELECT *, (f2 - f1) / nullif(x2 * 10000 - x1 * 10000, 0) AS a FROM p) SELECT l_partkey, CASE WHEN a BETWEEN 0 AND 1 AND f1 - a * x1 * 10000 >= 0 THEN round(a, 9) END AS slope FROM s")
def fee_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_quantity").alias("x1"), F.max("l_quantity").alias("x2"), F.min("l_extendedprice").alias("f1"), F.max("l_extendedprice").alias("f2"))
    line = money.calibrated(F.col("x1") * 10000, F.col("f1"), F.col("x2") * 10000, F.col("f2"))
    return probes.select("l_partkey", F.round(line["slope"], 9).alias("slope"))


@query("point_in_polygon", "SELECT n_nationkey, n_nationkey BETWEEN 5 AND 14 AS inside FROM nation")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    square = [(4.5, -1.0), (4.5, 1.0), (14.5, 1.0), (14.5, -1.0)]
    return table(spark, sf_dir, "nation").select("n_nationkey", vectors.in_polygon(F.col("n_nationkey").cast("double"), F.lit(0.0), square).alias("inside"))


@query("route_plan")
def route_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A round trip for each region over the suppliers' nations."""
    from ..operators.route import plan_routes

    n = F.col("n_nationkey")
    stops = table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").cast("long").alias("route_id"), n.cast("long").alias("stop_id"), (55.0 + n * 0.4).alias("lat"), (12.0 + n * n % 7 * 0.3).alias("lon"),
        F.lit(480.0).alias("opens"), F.lit(1020.0).alias("closes"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) == 1).alias("depot"))
    return plan_routes(stops)


@query("html_fields", "SELECT page_id, html LIKE '%<nav>%' AS nav, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.contains("html", F.lit("<nav>")).alias("nav"), H.tag_text(F.col("html"), "title").alias("title"))




@query("attributes_agree", "SELECT part_a, part_b, (contains(x, y) OR contains(y, x)) AND abs(za - zb) <= 20 AS agree FROM (SELECT a.p_partkey AS part_a, b.p_partkey AS part_b, replace(lower(a.p_name), ' ', '') AS x, replace(lower(b.p_name), ' ', '') AS y, a.p_size AS za, b.p_size AS zb FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 64)")
def attributes_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.price import attributes_agree as agree

    p = table(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("part_a"), F.col("p_name").alias("x"), F.col("p_size").alias("za")), p.select(F.col("p_partkey").alias("part_b"), F.col("p_name").alias("y"), F.col("p_size").alias("zb"))
    test = agree({"m": F.col("x")}, {"m": F.col("y")}, F.col("za"), F.col("zb"))
    return a.join(b, F.col("part_b") == F.col("part_a") + 64).select("part_a", "part_b", test.alias("agree"))


@query("price_regression", "SELECT p_type, count(*) AS n, round(regr_slope(ln(l_extendedprice), l_quantity), 9) AS slope, round(regr_r2(ln(l_extendedprice), l_quantity), 9) AS r2 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type HAVING count(*) >= 30")
def price_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log price against one feature per group of 30 or more."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("y", F.log("l_extendedprice"))
    out = rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("y", "l_quantity"), 9).alias("slope"), F.round(F.regr_r2("y", "l_quantity"), 9).alias("r2"))
    return out.filter("n >= 30")


@query("future_biased_dates", f"WITH m AS (SELECT o_orderkey, month(o_orderdate) AS m, least(day(o_orderdate), 28) AS d FROM orders) SELECT o_orderkey, CASE WHEN make_date(2001, m, d) < DATE '2001-05-31' THEN make_date(2002, m, d) ELSE make_date(2001, m, d) END AS future, CASE WHEN make_date(2001, m, d) > DATE '2001-06-02' THEN make_date(2000, m, d) ELSE make_date(2001, m, d) END AS past FROM m")
def future_biased_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates without a year, around the first of June 2001."""
    month, day = F.month("o_orderdate"), F.least(F.dayofmonth("o_orderdate"), F.lit(28))
    return table(spark, sf_dir, "orders").select("o_orderkey", times.future_biased(month, day, ntz(AS_OF)).alias("future"), times.past_biased(month, day, ntz(AS_OF)).alias("past"))


@query("residual_vat", "SELECT o_orderkey, CASE WHEN o_totalprice * (1 + (o_custkey % 3) * 0.15) - o_totalprice - 100 - 25 > 0.05 * o_totalprice THEN 25 ELSE 0 END AS vat FROM orders")
def residual_vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bid = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", money.residual_vat(bid * (1 + (F.col("o_custkey") % 3) * 0.15), bid, F.lit(100.0)).alias("vat"))


@query("best_price", f"WITH {ITEMS_SQL} SELECT house, external_id, CASE WHEN fee_value > 50 THEN fee_value WHEN current_bid > 0 THEN current_bid WHEN min_bid > 0 THEN min_bid END AS price FROM items")
def best_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.when(F.col("fee_value") > 50, F.col("fee_value"))
    return items(spark, sf_dir).select("house", "external_id", money.best_price(total, F.col("current_bid"), F.col("min_bid")).alias("price"))


def over_rows(name: str, fn, source: str, key: str, text: Callable[[], Column], sql: str | None = None, given: str | None = None) -> None:
    """A query that applies a scalar function to a text of each row of a table: a column, or one made from the row's own
    columns (``given`` is its SQL, ``x`` in ``sql``)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spread(table(spark, sf_dir, source)).select(key, fn(text()).alias("y"))

    inner = f"(SELECT *, {given} AS x FROM {source})" if given else source
    query(name, sql and f"SELECT {key}, {sql} AS y FROM {inner}")(run)


_SQUEEZED = "trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g'))"
_BODY = "left(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 400)"
_SEGMENTS = {"AUTOMOBILE": ("Volvo V70 kombi", "fordon/personbilar"), "HOUSEHOLD": ("Guldring 18k", "smycken/smycken-sub"), "MACHINERY": ("okänd sak", None), "BUILDING": ("Diverse dödsbo", "ovrigt/partier"), "FURNITURE": ("LP-skiva vinyl", "media/vinyl")}
_DOC = lambda *parts: F.concat(F.coalesce("text", F.lit("")), *parts)
_TEXT = "coalesce(text, '') || "
_N, _ID = (lambda: F.col("n_chars")), (lambda: F.col("doc_id"))
over_rows("keyword_classify_rows", classify.by_text, "customer", "c_custkey", lambda: F.concat("c_name", F.lit(" "), F.coalesce(F.create_map(*[F.lit(x) for k, (t, _) in _SEGMENTS.items() for x in (k, t)])[F.col("c_mktsegment")], F.lit(""))), "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, (_, v) in _SEGMENTS.items() if v) + " END")
over_rows("lot_count_rows", T.lot_count, "documents", "doc_id", lambda: F.when(_ID() % 3 > 0, _DOC(F.lit(" "), _N() % 90 + 1, F.lit(" st kvar"))).otherwise(F.col("text")), "coalesce(nullif(TRY_CAST(nullif(regexp_extract(x, '(?i)(\\d+)\\s*(?:stycken|styck|st)\\.?\\b', 1), '') AS BIGINT), 0), CASE WHEN regexp_matches(x, '(?i)\\bett\\s+par\\b|\\b1\\s+par\\b|,\\s*par\\b|\\bpar,|\\bpar\\s+[”\"“]') THEN 2 END)", f"CASE WHEN doc_id % 3 > 0 THEN {_TEXT} ' ' || (n_chars % 90 + 1) || ' st kvar' ELSE text END")
over_rows("plate_regex_rows", T.plate, "documents", "doc_id", lambda: _DOC(F.when(_ID() % 2 == 0, F.concat(F.lit(" bil abc "), _ID() % 900 + 100, F.lit("."))).otherwise("")), "CASE WHEN p <> '' AND NOT (regexp_matches(p, '^(AAA|BBB|CCC|DDD|EEE|FFF|GGG|HHH|JJJ|KKK|LLL|MMM|NNN|OOO|PPP|RRR|SSS|TTT|UUU|WWW|XXX|YYY|ZZZ)') AND contains(p, '000')) THEN p END", f"upper({_TEXT} CASE WHEN doc_id % 2 = 0 THEN ' bil abc ' || (doc_id % 900 + 100) || '.' ELSE '' END) AS u, regexp_extract(u, '\\b([A-HJ-PR-UW-Z]{{3}})\\s?(\\d{{2}}[\\dA-HJ-PR-UW-Z])\\b', 1) || regexp_extract(u, '\\b([A-HJ-PR-UW-Z]{{3}})\\s?(\\d{{2}}[\\dA-HJ-PR-UW-Z])\\b', 2) AS p, 0")
over_rows("swedish_number_rows", T.number, "documents", "doc_id", lambda: F.when(_ID() % 4 > 0, F.concat(F.regexp_replace(_N().cast("string"), r"(\d)(?=(\d{3})+$)", "$1 "), F.lit(","), _ID() % 10)).otherwise(F.col("text")), "CASE WHEN doc_id % 4 > 0 THEN (n_chars * 10 + doc_id % 10) / 10.0::DOUBLE END")
over_rows("slugify_rows", T.slug, "part", "p_partkey", lambda: F.col("p_name"), "regexp_replace(regexp_replace(translate(lower(p_name), 'åäöéèüàçñóíêß', 'aaoeeuacnoies'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')")
over_rows("countdown_rows", times.countdown_seconds, "documents", "doc_id", lambda: F.when(_ID() % 3 > 0, F.concat(_N() % 6, F.lit(" dygn "), _ID() % 24, F.lit(" tim"))).otherwise(F.concat(_N() % 60, F.lit(" minuter"))), "CASE WHEN doc_id % 3 > 0 THEN n_chars % 6 * 86400 + doc_id % 24 * 3600 ELSE n_chars % 60 * 60 END::BIGINT")
over_rows("quoted_models_rows", lambda x: F.array_join(T.quoted_models(x), "|"), "documents", "doc_id", lambda: _DOC(F.lit(' "'), F.coalesce("source", F.lit("?")), F.lit(" "), _N(), F.lit('" ”x”')), "array_to_string(list_filter(list_transform(regexp_extract_all(x, '[\"”“„]([^\"”“„]{2,40})[\"”“„]', 1), lambda s: trim(s)), lambda s: length(s) >= 2), '|')", f"{_TEXT} ' \"' || coalesce(source, '?') || ' ' || n_chars || '\" ”x”'")
over_rows("condition_badge_rows", T.condition_badge, "documents", "doc_id", lambda: _DOC(F.lit("\n"), F.when(_N() % 3 == 0, "Ny i kartong").when(_N() % 3 == 1, "ej testad").otherwise("oanvändbar")), "CASE n_chars % 3 WHEN 0 THEN 'ny' WHEN 1 THEN 'otestad' END")
over_rows("normalise_query_rows", T.normalise_query, "part", "p_partkey", lambda: F.col("p_name"), _SQUEEZED)
over_rows("clock_minutes_rows", times.clock_minutes, "documents", "doc_id", lambda: F.concat(_N() % 30, F.lit(":"), F.lpad((_ID() % 70).cast("string"), 2, "0")), "CASE WHEN n_chars % 30 < 24 AND doc_id % 70 < 60 THEN n_chars % 30 * 60 + doc_id % 70 END::INTEGER")
over_rows("html_entities_rows", T.strip_html, "pages", "page_id", lambda: F.col("html"))
over_rows("item_text_rows", lambda x: T.item_text(F.lit("Stol"), x), "documents", "doc_id", lambda: F.col("text"), f"CASE WHEN {_BODY} = '' THEN 'Stol' ELSE 'Stol. ' || {_BODY} END")
over_rows("spec_value_rows", lambda x: T.label_value(x, "Höjd", ("Bredd", "Vikt")), "documents", "doc_id", lambda: _DOC(F.when(_ID() % 2 == 0, F.concat(F.lit("\nHöjd: "), _N(), F.lit(" cm Bredd: 10"))).otherwise("")), "CASE WHEN doc_id % 2 = 0 THEN n_chars || ' cm' END")
over_rows("image_url_rows", T.image_url, "pages", "page_id", lambda: F.col("url"), "regexp_replace(url, '(?i)([_-](thumb|small|mid|large|\\d+x\\d+))(\\.(jpe?g|png|webp))', '\\3', 'g')")
over_rows("fitted_text_rows", lambda x: T.fitted(x, 10), "part", "p_partkey", lambda: F.col("p_name"), "CASE WHEN length(p_name) <= 10 THEN p_name ELSE rtrim(left(p_name, 9)) || '…' END")
over_rows("worth_expanding_rows", T.worth_expanding, "part", "p_partkey", lambda: F.col("p_name"), f"length({_SQUEEZED}) BETWEEN 4 AND 60 AND regexp_matches({_SQUEEZED}, '\\p{{L}}{{4,}}')")
