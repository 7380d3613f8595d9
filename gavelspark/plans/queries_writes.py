"""Queries over writes and work queues: upserts, refreshes, finalisation, reviews, flags, what is to be done next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import merge as M, queues
from ..rules import classify
from .adapt import AS_OF, ITEMS_SQL, LOTS_SQL, items, lots, ntz, spread, table
from .queries_items import FEES_SQL
from .queries_rules import LEXICON_SQL, part_lexicon
from .registry import query

c = F.col
_SOLD = "coalesce(current_bid, 0) > 0 AND reserve_status IS DISTINCT FROM 'not_met' AND (reserve_price IS NULL OR current_bid >= reserve_price)"


@query(
    "auction_upsert",
    """WITH o AS (SELECT o_orderkey AS external_id, 'h' || o_custkey % 3 AS house, o_orderpriority AS title, CASE WHEN o_custkey % 2 = 0 THEN 'old' END AS description, o_orderstatus AS contact FROM orders WHERE o_orderkey % 3 <> 0),
n AS (SELECT o_orderkey AS external_id, 'h' || o_custkey % 3 AS house, 'new' AS title, CASE WHEN o_custkey % 5 = 0 THEN 'told' END AS description, CASE WHEN o_custkey % 7 = 0 THEN 'c' END AS contact FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.house, o.house) AS house, coalesce(n.external_id, o.external_id) AS external_id, CASE WHEN n.title IS NULL THEN o.title ELSE n.title END AS title, coalesce(n.description, o.description) AS description, CASE WHEN n.title IS NULL THEN o.contact ELSE n.contact END AS contact
FROM o FULL JOIN n ON o.house = n.house AND o.external_id = n.external_id""",
)
def auction_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = [F.concat(F.lit("h"), c("o_custkey") % 3).alias("house"), c("o_orderkey").alias("external_id")]
    current = o.filter("o_orderkey % 3 != 0").select(*key, c("o_orderpriority").alias("title"), F.when(c("o_custkey") % 2 == 0, "old").alias("description"), c("o_orderstatus").alias("contact"))
    batch = o.filter("o_orderkey % 2 = 0").select(*key, F.lit("new").alias("title"), F.when(c("o_custkey") % 5 == 0, "told").alias("description"), F.when(c("o_custkey") % 7 == 0, "c").alias("contact"))
    return M.merge_auctions(current, batch)


@query(
    "bid_upsert",
    "WITH o AS (SELECT event_id AS bid_id, value, event_type AS type FROM events WHERE event_id % 2 = 0), n AS (SELECT event_id AS bid_id, value + 5 AS value, 'auto' AS type FROM events WHERE event_id % 3 = 0) SELECT coalesce(o.bid_id, n.bid_id) AS bid_id, coalesce(n.type, o.type) AS type, coalesce(o.value, n.value) AS value FROM o FULL JOIN n ON o.bid_id = n.bid_id",
)
def bid_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bid that comes again keeps its value."""
    e = table(spark, sf_dir, "events").select(c("event_id").alias("bid_id"), "value", c("event_type").alias("type"))
    return M.merge_bids(e.filter("bid_id % 2 = 0"), e.filter("bid_id % 3 = 0").withColumns({"value": c("value") + 5, "type": F.lit("auto")}))


_BID = "CASE WHEN bid_count % 3 = 0 THEN current_bid + 20 ELSE current_bid END"


@query(
    "bid_refresh",
    f"""WITH {ITEMS_SQL.replace("items AS", "base AS", 1)}, items AS (SELECT * REPLACE ({_BID} AS current_bid, CASE WHEN bid_count % 3 = 0 THEN 2 ELSE bid_count END AS bid_count) FROM base), {FEES_SQL}
SELECT house, external_id, current_bid, bid_count, fee, total_price, total_basis FROM totals""",
)
def bid_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two new bids on every third lot; the totals follow."""
    rows = items(spark, sf_dir)
    bids = rows.filter("bid_count % 3 = 0").select("house", "external_id", F.explode(F.array(c("current_bid") + 20, c("current_bid") + 10)).alias("value"))
    return M.refresh_items(rows, bids).select("house", "external_id", "current_bid", "bid_count", "fee", "total_price", "total_basis")


@query("move_ends", f"WITH {LOTS_SQL} SELECT house, external_id, CASE WHEN k % 2 = 0 AND k % 6 > 0 THEN ends_at + INTERVAL 3 MINUTE ELSE ends_at END AS ends_at FROM lots")
def move_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir)
    key = c("external_id").cast("long")
    updates = rows.filter(key % 2 == 0).withColumn("ends_at", F.when(key % 6 > 0, c("ends_at") + F.expr("INTERVAL 3 MINUTES")))
    return M.move_ends(rows, updates).select("house", "external_id", "ends_at")


_SALES = f"SELECT l.house, l.external_id, l.title, p.category, coalesce(current_bid, 0) AS final_bid, {_SOLD} AS sold, ends_at AS ended_at FROM lots l LEFT JOIN parts p ON p.house = l.house AND p.part = l.part_external_id"
_PARTS = "parts AS (SELECT DISTINCT house, part_external_id AS part, 'cat' || part_external_id AS category FROM lots WHERE part_external_id::INT % 3 > 0)"
_PAST = f"ends_at <= TIMESTAMP '{AS_OF}' - INTERVAL 600 DAY + INTERVAL 15 MINUTE"


def _finalized(spark: SparkSession, sf_dir: str, times: int) -> tuple[DataFrame, DataFrame]:
    rows, as_of = lots(spark, sf_dir), ntz(AS_OF) - F.expr("INTERVAL 600 DAYS")
    parts = rows.filter(c("part_external_id").cast("int") % 3 > 0).select("house", c("part_external_id").alias("external_id"), F.concat(F.lit("cat"), "part_external_id").alias("category")).distinct()
    kept = rows.filter(c("external_id").cast("long") % 4 == 0).select("house", "external_id", F.lit("old title").alias("title"), F.lit("old").alias("category"), F.lit(1).cast("long").alias("final_bid"), F.lit(None).cast("long").alias("final_total"), F.lit(False).alias("sold"), c("ends_at").alias("ended_at"), F.lit("kept").alias("raw"))
    keys = rows.filter(c("external_id").cast("long") % 2 == 0)
    state = (rows, kept)
    for _ in range(times):
        state = M.finalize_keys(state[0], state[1], keys, as_of, parts)
    return state


_FINAL = f"""WITH {LOTS_SQL}, {_PARTS}, told AS (SELECT * FROM ({_SALES}) s WHERE s.external_id::BIGINT % 2 = 0 AND s.ended_at <= TIMESTAMP '{AS_OF}' - INTERVAL 600 DAY + INTERVAL 15 MINUTE),
old AS (SELECT house, external_id, 'old title' AS title, 'old' AS category, 1::BIGINT AS final_bid, false AS sold, ends_at AS ended_at FROM lots WHERE k % 4 = 0)
SELECT coalesce(o.house, t.house) AS house, coalesce(o.external_id, t.external_id) AS external_id, coalesce(o.title, t.title) AS title, CASE WHEN t.house IS NULL THEN o.category ELSE t.category END AS category,
  CASE WHEN t.house IS NULL THEN o.final_bid ELSE t.final_bid END AS final_bid, CASE WHEN t.house IS NULL THEN o.sold ELSE t.sold END AS sold, coalesce(t.ended_at, o.ended_at) AS ended_at FROM old o FULL JOIN told t ON o.house = t.house AND o.external_id = t.external_id"""
_SALE = ("house", "external_id", "title", "category", "final_bid", "sold", "ended_at")


@query("finalize_history", _FINAL)
def finalize_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the lots are told to be over; those with their end ahead are not."""
    return _finalized(spark, sf_dir, 1)[1].select(*_SALE)


@query("finalize_twice", _FINAL)
def finalize_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finalized(spark, sf_dir, 2)[1].select(*_SALE)


@query("finalize_status", f"WITH {LOTS_SQL} SELECT house, external_id, CASE WHEN k % 2 = 0 AND {_PAST} THEN 'ended' ELSE status END AS status FROM lots")
def finalize_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finalized(spark, sf_dir, 1)[0].select("house", "external_id", "status")


@query(
    "record_sales",
    f"""WITH {LOTS_SQL}, items AS (SELECT * FROM lots WHERE status = 'ended'), {FEES_SQL} SELECT house, external_id, CASE WHEN k % 2 = 0 THEN title ELSE title END AS title, category, coalesce(current_bid, 0) AS final_bid, total_price AS final_total, {_SOLD} AS sold FROM totals""",
)
def record_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots first seen when they were over, onto a history that has some of them under another title."""
    ended = lots(spark, sf_dir).filter("status = 'ended'")
    history = M.sales_of(ended.filter(c("external_id").cast("long") % 2 == 0)).withColumns({"title": F.lit("other"), "final_bid": F.lit(0).cast("long")})
    return M.record_sales(history, ended).select("house", "external_id", "title", "category", "final_bid", "final_total", "sold")


@query(
    "review_decisions",
    f"""WITH {LOTS_SQL}, d AS (SELECT *, CASE k % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'use_house' END AS decision, CASE WHEN k % 10 = 2 THEN 'own' END AS house_key FROM lots)
SELECT house, external_id, CASE WHEN decision = 'use_house' AND house_key IS NOT NULL THEN house_key WHEN decision = 'reject' THEN NULL ELSE category END AS category,
  CASE WHEN decision = 'approve' AND category IS NOT NULL OR decision = 'use_house' AND house_key IS NOT NULL THEN 'human' WHEN decision = 'reject' THEN NULL ELSE category_conf END AS category_conf,
  CASE WHEN decision = 'approve' AND category IS NOT NULL OR decision = 'use_house' AND house_key IS NOT NULL THEN false WHEN decision = 'reject' THEN true ELSE category_conflict END AS category_conflict FROM d""",
)
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("external_id").cast("long")
    rows = lots(spark, sf_dir).withColumn("house_key", F.when(k % 10 == 2, "own"))
    decisions = rows.select("house", "external_id", F.when(k % 5 == 0, "approve").when(k % 5 == 1, "reject").when(k % 5 == 2, "use_house").alias("decision")).filter("decision IS NOT NULL")
    return M.decide(rows, decisions).select("house", "external_id", "category", "category_conf", "category_conflict")


_AUCTIONS = f"auctions AS (SELECT DISTINCT house, auction_external_id AS external_id, CASE auction_external_id::INT % 10 WHEN 0 THEN 'Konkursbo efter X' WHEN 1 THEN 'Likvidation' ELSE 'Auktion' END AS title, CASE auction_external_id::INT % 10 WHEN 2 THEN 'ADVOKATfirman Y' WHEN 3 THEN NULL ELSE 'Kontor' END AS contact FROM lots)"
_FLAG = "CASE WHEN status = 'active' AND insolvency IS NULL THEN auction_external_id::INT % 10 < 3 ELSE insolvency END"


def _auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = c("auction_external_id").cast("int") % 10
    title = F.when(n == 0, "Konkursbo efter X").when(n == 1, "Likvidation").otherwise("Auktion")
    return lots(spark, sf_dir).select("house", c("auction_external_id").alias("external_id"), title.alias("title"), F.when(n == 2, "ADVOKATfirman Y").when(n != 3, "Kontor").alias("contact")).distinct()


@query("insolvent_auctions", f"WITH {LOTS_SQL}, {_AUCTIONS} SELECT house, external_id FROM auctions WHERE title ILIKE '%konkurs%' OR contact ILIKE '%konkurs%' OR contact ILIKE '%advokat%' OR title ILIKE '%likvidation%'")
def insolvent_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _auctions(spark, sf_dir).filter(M.insolvent()).select("house", "external_id")


@query("insolvency_flags", f"WITH {LOTS_SQL} SELECT house, external_id, {_FLAG} AS insolvency FROM lots")
def insolvency_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.flag_insolvency(lots(spark, sf_dir), _auctions(spark, sf_dir)).select("house", "external_id", "insolvency")


@query("list_insolvent", f"WITH {LOTS_SQL}, f AS (SELECT *, {_FLAG} AS flag FROM lots) SELECT house, external_id FROM f WHERE status = 'active' AND flag")
def list_insolvent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots without a flag do not count as insolvent."""
    from ..operators.search import Filters

    flagged = M.flag_insolvency(lots(spark, sf_dir), _auctions(spark, sf_dir))
    return Filters(insolvency=True).apply(flagged).select("house", "external_id")


_OWN = "CASE WHEN k % 2 = 0 THEN 'fordon' ELSE 'elektronik' END"
_TEXT = "CASE k % 4 WHEN 0 THEN 'fordon' WHEN 1 THEN 'smycken' WHEN 2 THEN 'media' END"


@query("conflict_sweep", f"WITH {LOTS_SQL} SELECT external_id, category_conflict OR coalesce(status = 'active' AND category_conf = 'text' AND {_TEXT} <> {_OWN}, false) AS category_conflict FROM lots")
def conflict_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.flag_conflicts(spread(lots(spark, sf_dir)).withColumn("house", F.lit("budi"))).select("external_id", "category_conflict")


@query(
    "house_categories",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'fordon/lastbil-buss' ELSE 'mobler/mobler-sub' END WHEN 1 THEN 'smycken/smycken-sub' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'konst/konst-tavlor' END
  WHEN 3 THEN 'smycken/smycken-sub' WHEN 4 THEN CASE WHEN p_size % 10 = 0 THEN 'klockor' END END AS key, CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'transport' ELSE 'Möbler' END WHEN 1 THEN 'Smycken' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'Konst' ELSE 'Annat' END
  WHEN 3 THEN 'pantbank' WHEN 4 THEN (p_size % 10)::VARCHAR END AS label FROM part""",
)
def house_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five houses, each with its own place and kind of category, and one without."""
    kind, even, lit = c("p_partkey") % 6, c("p_size") % 2 == 0, F.lit
    raw = (
        F.when(kind == 0, F.to_json(F.struct(F.struct(F.when(even, "transport").otherwise("Möbler").alias("category")).alias("item"))))
        .when(kind == 1, F.to_json(F.struct(lit("Smycken").alias("subcategory"), lit("x").alias("category"))))
        .when(kind == 2, F.to_json(F.struct(F.when(even, "Konst").otherwise("Annat").alias("categoryNameLevel1"))))
        .when(kind == 4, F.to_json(F.struct((c("p_size") % 10).alias("category_id"))))
        .otherwise(lit("{}"))
    )
    houses = F.element_at(F.array(*[lit(h) for h in ("budi", "vaxxa", "klaravik", "pantbanken", "auctionet", "siko")]), (kind + 1).cast("int"))
    ids = spark.createDataFrame([("0", "klockor")], "id string, ids string")
    rows = spread(table(spark, sf_dir, "part")).select("p_partkey", houses.alias("house"), raw.alias("raw"))
    rows = rows.join(F.broadcast(ids), F.get_json_object("raw", "$.category_id") == c("id"), "left")
    return rows.select("p_partkey", classify.house_category(c("house"), c("raw"), c("ids")).alias("own")).select("p_partkey", "own.key", "own.label")


_PICTURED = "k % 3 = 0"
_ACTIVE = "status = 'active'"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pictures, one of them small, for every third lot, and only a small one for some others."""
    k = c("external_id").cast("long")
    both = F.when(k % 3 == 0, F.array(F.struct(F.lit("a_mid.jpg").alias("url"), F.lit(1).alias("sort")), F.struct(F.lit("b.jpg").alias("url"), F.lit(2).alias("sort")))).when(k % 3 == 1, F.array(F.struct(F.lit("c_mid.jpg").alias("url"), F.lit(1).alias("sort"))))
    return lots(spark, sf_dir).select("house", "external_id", F.inline(both))


@query("reading_queue", f"WITH {LOTS_SQL} SELECT house, external_id, 'b.jpg' AS image FROM lots WHERE {_ACTIVE} AND {_PICTURED} AND k % 10 > 0 ORDER BY coalesce(category IN ('1-URGENT', '5-LOW'), false) DESC, ends_at, house, external_id LIMIT 300")
def reading_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir).withColumn("ocr_text", F.when(c("external_id").cast("long") % 10 == 0, ""))
    return queues.reading_queue(rows, _images(spark, sf_dir), ("1-URGENT", "5-LOW"), 300).select("house", "external_id", "image")


@query("classification_queue", f"WITH {LOTS_SQL} SELECT house, external_id FROM lots WHERE {_ACTIVE} AND category_conf NOT IN ('llm', 'learned', 'human') AND k % 3 = 2 AND k % 7 > 0 ORDER BY category_conflict DESC, CASE category_conf WHEN 'house' THEN 3 WHEN 'text' THEN 2 ELSE 0 END, ends_at, house, external_id LIMIT 250")
def classification_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir)
    tried = rows.filter(c("external_id").cast("long") % 7 == 0)
    return queues.classification_queue(rows, _images(spark, sf_dir), tried, classify.confidence_rank(c("category_conf")), 250).select("house", "external_id")


@query("reclassify_queue", f"WITH {LOTS_SQL} SELECT house, external_id FROM lots WHERE status <> 'active' AND category_conf <> 'llm' AND k % 7 > 0 ORDER BY ends_at DESC, house, external_id LIMIT 250")
def reclassify_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir)
    return queues.reclassify_queue(rows, rows.filter(c("external_id").cast("long") % 7 == 0), 250).select("house", "external_id")


@query("learned_first", f"WITH {LEXICON_SQL} SELECT p_partkey, coalesce(v.category, NULL) AS category, CASE WHEN v.category IS NULL THEN 'ask' ELSE 'learned' END AS way FROM part LEFT JOIN votes v USING (p_partkey)")
def learned_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lexicon can tell is taken; the rest has to be asked."""
    rows = table(spark, sf_dir, "part")
    return classify.learned_or_ask(rows, "p_partkey", "p_name", part_lexicon(spark, sf_dir), min_share=0.17).select("p_partkey", "category", "way")


@query("estimates_due", f"WITH {LOTS_SQL}, e AS (SELECT *, CASE k % 3 WHEN 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR WHEN 2 THEN TIMESTAMP '{AS_OF}' - INTERVAL 19 HOUR END AS est_at FROM lots) SELECT house, external_id FROM e WHERE {_ACTIVE} AND (est_at IS NULL OR est_at < TIMESTAMP '{AS_OF}' - INTERVAL 18 HOUR) ORDER BY est_at IS NULL DESC, ends_at, house, external_id LIMIT 4000")
def estimates_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("external_id").cast("long") % 3
    hours = lambda n: ntz(AS_OF) - F.expr(f"INTERVAL {n} HOURS")
    return queues.estimates_due(lots(spark, sf_dir).withColumn("est_at", F.when(k == 1, hours(1)).when(k == 2, hours(19))), ntz(AS_OF), limit=4000).select("house", "external_id")


@query("pending_images", f"WITH {LOTS_SQL}, m AS (SELECT house, external_id, k * 2 + s AS image_id, CASE WHEN (k + s) % 4 = 0 THEN 'x' END AS local_path FROM lots, (VALUES (0), (1)) AS v(s)) SELECT image_id FROM m JOIN lots USING (house, external_id) WHERE local_path IS NULL AND {_ACTIVE} ORDER BY image_id LIMIT 500")
def pending_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lots(spark, sf_dir)
    k = c("external_id").cast("long")
    images = rows.select("house", "external_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("s")).select("house", "external_id", (k * 2 + c("s")).alias("image_id"), F.when((k + c("s")) % 4 == 0, "x").alias("local_path"))
    return queues.pending_images(images, rows, 500).select("image_id")


_NEXT = "n AS (SELECT * REPLACE (CASE WHEN k % 2 = 0 THEN current_bid + 50 ELSE current_bid END AS current_bid) FROM lots)"


@query(
    "ingest_chain",
    f"""WITH {LOTS_SQL}, loaded AS (SELECT * REPLACE (CASE WHEN k % 4 = 0 THEN coalesce(current_bid, 0) + 70 WHEN k % 2 = 0 THEN current_bid + 50 ELSE current_bid END AS current_bid) FROM lots WHERE k % 3 > 0 OR k % 2 = 0),
items AS (SELECT *, status = 'active' AND ends_at < TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE AS due FROM loaded), {FEES_SQL}
SELECT house, external_id, current_bid, total_price, CASE WHEN due THEN 'ended' ELSE status END AS status, due AS in_history, CASE WHEN due THEN {_SOLD} END AS sold FROM totals""",
)
def ingest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, lots, bids and finalisation in one load."""
    rows = lots(spark, sf_dir).withColumn("bid_count", F.lit(None).cast("int"))
    k = c("external_id").cast("long")
    none = rows.limit(0)
    parts = rows.select("house", c("part_external_id").alias("external_id"), F.lit("cat").alias("category")).distinct()
    new_items = rows.filter(k % 2 == 0).withColumn("current_bid", c("current_bid") + 50)
    bids = rows.filter(k % 4 == 0).select("house", "external_id", F.concat(F.lit("b"), "external_id").alias("bid_id"), (F.coalesce("current_bid", F.lit(0)) + 70).alias("value"), ntz(AS_OF).alias("created_at"))
    state = {"parts": parts.limit(0), "items": rows.filter(k % 3 > 0), "bids": bids.limit(0), "history": M.sales_of(none)}
    after = M.ingest(state, parts, new_items, bids, ntz(AS_OF))
    told = after["history"].select("house", "external_id", F.lit(True).alias("in_history"), "sold")
    return after["items"].join(told, ["house", "external_id"], "left").select("house", "external_id", "current_bid", "total_price", "status", F.coalesce("in_history", F.lit(False)).alias("in_history"), "sold")


@query("watch_defaults", f"WITH {LOTS_SQL}, w AS (SELECT house, external_id FROM lots WHERE k % 100 = 0 UNION ALL SELECT 'none', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 100 = 1) SELECT w.house, w.external_id, coalesce(l.reserve_status = 'met', false) AS notified_reserve, coalesce(l.status = 'ended', false) AS notified_ended FROM w LEFT JOIN lots l USING (house, external_id)")
def watch_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New watches start from what is known of their lot; a lot that is not known gives false."""
    from ..streaming.watch import new_watches

    rows = lots(spark, sf_dir)
    k = c("external_id").cast("long") % 100
    asked = rows.filter(k == 0).select("house", "external_id").union(rows.filter(k == 1).select(F.lit("none"), "external_id"))
    return new_watches(asked, rows)


@query("watched_order", f"WITH {LOTS_SQL}, w AS (SELECT * FROM lots WHERE k % 100 < 3) SELECT house, external_id, row_number() OVER (ORDER BY status = 'ended', ends_at NULLS LAST, house, external_id) AS place FROM w")
def watched_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watched lots, those that are over last; a list of one user, so it is numbered whole."""
    from ..streaming.watch import watched_first

    rows = lots(spark, sf_dir)
    watched = rows.filter(c("external_id").cast("long") % 100 < 3).select("house", "external_id")
    order = watched_first()
    return rows.join(watched, ["house", "external_id"], "left_semi").select("house", "external_id", F.row_number().over(Window.orderBy(*order)).alias("place"))


@query(
    "settings_overwrite",
    """WITH o AS (SELECT 'job' || user_id % 40 AS name, max(event_id) AS value, max(ts) AS updated_at FROM events WHERE event_id % 2 = 0 AND user_id % 40 < 30 GROUP BY 1),
n AS (SELECT 'job' || user_id % 40 AS name, CASE WHEN user_id % 40 <> 17 THEN max(event_id) END AS value, max(ts) AS updated_at FROM events WHERE event_id % 2 = 1 AND user_id % 40 >= 10 GROUP BY user_id % 40)
SELECT coalesce(n.name, o.name) AS name, CASE WHEN n.name IS NULL THEN o.value ELSE n.value END AS value, coalesce(n.updated_at, o.updated_at) AS updated_at, o.name IS NULL AS added FROM o FULL JOIN n USING (name)""",
)
def settings_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings and states of jobs: what is written last stands, a null too; jobs of users come in two lots."""
    e, job = table(spark, sf_dir, "events"), c("user_id") % 40
    stand = lambda rows, value: rows.groupBy(F.concat(F.lit("job"), job.cast("string")).alias("name"), job.alias("j")).agg(value.alias("value"), F.max("ts").alias("updated_at")).drop("j")
    before = stand(e.filter((c("event_id") % 2 == 0) & (job < 30)), F.max("event_id"))
    batch = stand(e.filter((c("event_id") % 2 == 1) & (job >= 10)), F.max(F.when(job != 17, c("event_id"))))
    return M.merge(before, batch, ["name"], {"value": M.overwrite, "updated_at": M.overwrite}, flag="added")
