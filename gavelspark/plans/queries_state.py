"""Queries over changing state: merges, finalisation, queues, semi- and anti-joins, stream operators' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import merge as M, queues, search
from ..streaming import bids as B, watch
from .adapt import AS_OF, BIDS_SQL, ITEMS_SQL, bids, items, ntz, table
from .registry import query

_CUR = "o AS (SELECT o_orderkey AS k, o_orderpriority AS title, o_totalprice AS current_bid, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus END AS description, CASE WHEN o_custkey % 4 = 0 THEN 'human' ELSE 'text' END AS category_conf, 'a' || o_custkey % 5 AS category, CASE WHEN o_custkey % 3 = 0 THEN 'source' END AS total_basis FROM orders WHERE o_orderkey % 3 <> 0)"
_NEW = "n AS (SELECT o_orderkey AS k, 'new' AS title, o_totalprice * CASE WHEN o_custkey % 2 = 0 THEN 2 ELSE 0.5 END AS current_bid, CASE WHEN o_custkey % 3 = 0 THEN 'd' END AS description, 'llm' AS category_conf, 'b' || o_custkey % 5 AS category, 'external' AS total_basis FROM orders WHERE o_orderkey % 2 = 0)"


@query(
    "item_merge",
    f"""WITH {_CUR}, {_NEW} SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.title ELSE o.title END AS title, greatest(n.current_bid, o.current_bid) AS current_bid,
  coalesce(n.description, o.description) AS description,
  CASE WHEN n.k IS NULL OR (o.k IS NOT NULL AND o.category_conf = 'human') THEN o.category ELSE n.category END AS category,
  CASE WHEN n.k IS NULL OR (o.k IS NOT NULL AND o.category_conf = 'human') THEN o.category_conf ELSE n.category_conf END AS category_conf,
  CASE WHEN n.total_basis IS NULL OR (n.total_basis = 'external' AND o.total_basis IS NOT NULL) THEN o.total_basis ELSE n.total_basis END AS total_basis,
  o.k IS NULL AS inserted FROM o FULL JOIN n ON o.k = n.k""",
)
def item_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), F.col
    current = o.filter("o_orderkey % 3 != 0").select(
        c("o_orderkey").alias("k"), c("o_orderpriority").alias("title"), c("o_totalprice").alias("current_bid"), F.when(c("o_custkey") % 2 == 0, c("o_orderstatus")).alias("description"),
        F.when(c("o_custkey") % 4 == 0, "human").otherwise("text").alias("category_conf"), F.concat(F.lit("a"), c("o_custkey") % 5).alias("category"), F.when(c("o_custkey") % 3 == 0, "source").alias("total_basis"))
    batch = o.filter("o_orderkey % 2 = 0").select(
        c("o_orderkey").alias("k"), F.lit("new").alias("title"), (c("o_totalprice") * F.when(c("o_custkey") % 2 == 0, 2).otherwise(0.5)).alias("current_bid"), F.when(c("o_custkey") % 3 == 0, "d").alias("description"),
        F.lit("llm").alias("category_conf"), F.concat(F.lit("b"), c("o_custkey") % 5).alias("category"), F.lit("external").alias("total_basis"))
    return M.merge_items(current, batch, ("k",))


@query("bid_merge_argmax", f"WITH {BIDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY value DESC, created_at, bid_id) AS rn, count(*) OVER (PARTITION BY item_id) AS bid_count FROM bids) SELECT item_id, value AS current_bid, bid_id AS leader_bid, bid_count FROM r WHERE rn = 1")
def bid_merge_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.leading_bids(bids(spark, sf_dir))


_SYNC = "WITH cur AS (SELECT user_id, event_id, value FROM events WHERE event_id % 2 = 0), new AS (SELECT user_id, event_id, value + 1 AS value FROM events WHERE event_id % 5 = 0) SELECT * FROM cur WHERE user_id NOT IN (SELECT user_id FROM new) UNION ALL SELECT * FROM new"


@query("media_sync", _SYNC)
@query("media_sync_all", _SYNC)
def media_sync_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return M.sync_children(e.filter("event_id % 2 = 0"), e.filter("event_id % 5 = 0").withColumn("value", F.col("value") + 1), ["user_id"], "event_id", ["value"])


@query("verdict_merge", "WITH o AS (SELECT doc_id, quality AS v, CASE WHEN doc_id % 2 = 0 THEN 'human' ELSE 'ai' END AS source FROM (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id)), n AS (SELECT DISTINCT doc_id, 9 AS v, CASE WHEN doc_id % 3 = 0 THEN 'human' ELSE 'ai' END AS source FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL OR (o.source = 'human' AND n.source <> 'human') THEN o.v ELSE n.v END AS v, CASE WHEN n.doc_id IS NULL OR (o.source = 'human' AND n.source <> 'human') THEN o.source ELSE n.source END AS source FROM o FULL JOIN n ON o.doc_id = n.doc_id")
def verdict_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda m: F.when(F.col("doc_id") % m == 0, "human").otherwise("ai").alias("source")
    old = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").cast("int").alias("v")).select("doc_id", "v", kind(2))
    new = table(spark, sf_dir, "documents").filter("doc_id % 5 != 0").select("doc_id", F.lit(9).alias("v"), kind(3)).distinct()
    return M.merge(old, new, ["doc_id"], {"v": M.human_wins(), "source": M.human_wins()})


@query("lexicon_merge", "SELECT p_brand AS token, p_type AS category, 3 * count(*)::BIGINT AS seen FROM part GROUP BY ALL")
def lexicon_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..rules.classify import merge_lexicon

    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("token"), F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("seen"))
    return merge_lexicon(counts, counts.withColumn("seen", 2 * F.col("seen")))


@query("finalize_due", f"WITH {ITEMS_SQL} SELECT house, external_id, title, category, current_bid AS final_bid, current_bid > 0 AS sold, ends_at AS ended_at FROM items WHERE status = 'active' AND ends_at < TIMESTAMP '{AS_OF}' + INTERVAL 30 DAY - INTERVAL 10 MINUTE")
def finalize_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.finalize(items(spark, sf_dir), ntz(AS_OF) + F.expr("INTERVAL 30 DAYS"))[1]


@query("reconcile_missing", f"WITH {ITEMS_SQL} SELECT house, external_id FROM items WHERE status = 'active' AND bid_count % 7 = 0")
def reconcile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return M.missing_from(rows, rows.filter("bid_count % 7 != 0"), ["house", "external_id"]).select("house", "external_id")


@query("insert_absent", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return M.insert_absent(k.filter("k % 2 = 0").withColumn("v", F.lit("old")), k.filter("k % 3 = 0").withColumn("v", F.lit("new")), ["k"])


@query("konkurs_semijoin", "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS insolvent FROM orders")
def konkurs_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return search.marked(table(spark, sf_dir, "orders"), poor, ["o_custkey"], "insolvent").select("o_orderkey", "insolvent")


@query("queue_antijoin", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def queue_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return search.without(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey")


@query("tuple_in_semijoin", "SELECT event_id FROM events WHERE (user_id, event_type) IN ((1, 'view'), (2, 'click'), (3, 'error'))")
def tuple_in_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(1, "view"), (2, "click"), (3, "error")], "user_id long, event_type string")
    return search.among(table(spark, sf_dir, "events"), wanted, ["user_id", "event_type"]).select("event_id")


@query("theta_rules_join", f"WITH {ITEMS_SQL} SELECT r.name AS search, count(*) AS n FROM items i, (VALUES ('cheap'), ('rings'), ('busy')) AS r(name) WHERE CASE r.name WHEN 'cheap' THEN current_bid < 5000 WHEN 'rings' THEN title ILIKE '%ring%' ELSE bid_count > 40 END AND ends_at > TIMESTAMP '2001-06-01' AND ends_at <= TIMESTAMP '2001-08-01' GROUP BY r.name")
def theta_rules_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("cheap", F.col("current_bid") < 5000), ("rings", F.col("title").ilike("%ring%")), ("busy", F.col("bid_count") > 40)]
    rows = watch.match_searches(items(spark, sf_dir), rules, ntz("2001-06-01 00:00:00"), ntz("2001-08-01 00:00:00"), "ends_at", limit=None)
    return rows.groupBy("search").agg(F.count(F.lit(1)).alias("n"))


@query("saved_search_match", f"WITH {ITEMS_SQL}, h AS (SELECT house, external_id, ends_at FROM items WHERE title ILIKE '%gear%' AND ends_at > TIMESTAMP '2001-06-01' AND ends_at <= TIMESTAMP '2001-08-01') SELECT 'gears' AS search, house, external_id FROM h ORDER BY ends_at DESC, house, external_id LIMIT 30")
def saved_search_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = watch.match_searches(items(spark, sf_dir), [("gears", F.col("title").ilike("%gear%"))], ntz("2001-06-01 00:00:00"), ntz("2001-08-01 00:00:00"), "ends_at")
    return rows.select("search", "house", "external_id")


@query(
    "ending_soon_events",
    f"WITH {ITEMS_SQL} SELECT house, external_id, CASE WHEN bid_count % 2 = 0 THEN 'ended' ELSE 'ending_soon' END AS event FROM items WHERE status = 'active' AND (bid_count % 2 = 0 OR (ends_at > TIMESTAMP '{AS_OF}' AND ends_at <= TIMESTAMP '{AS_OF}' + INTERVAL 4320 MINUTE))",
)
def ending_soon_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = items(spark, sf_dir).withColumns({"reserve_status": F.lit("not_met"), "soon_sent": F.lit(False)})
    after = before.withColumn("status", F.when((F.col("status") == "active") & (F.col("bid_count") % 2 == 0), "ended").otherwise(F.col("status")))
    return watch.transitions(before, after, ntz(AS_OF), ["house", "external_id"], soon=4320).select("house", "external_id", "event")


@query("quota_union", "(SELECT vec_id, label FROM embeddings WHERE label < 5 ORDER BY vec_id LIMIT 70) UNION ALL (SELECT vec_id, label FROM embeddings WHERE label >= 5 ORDER BY vec_id LIMIT 30)")
def quota_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return queues.quota_union(e.filter("label < 5"), e.filter("label >= 5"), [F.col("vec_id")], 100)


@query("poll_tiers", f"WITH {ITEMS_SQL} SELECT house, external_id FROM items WHERE status = 'active' AND ends_at >= TIMESTAMP '{AS_OF}' - INTERVAL 20 MINUTE AND ends_at <= TIMESTAMP '{AS_OF}' + INTERVAL 9000 MINUTE ORDER BY ends_at, house, external_id LIMIT 500")
def poll_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("last_seen", ntz("2001-05-31 00:00:00"))
    return queues.poll_tiers(rows, ntz(AS_OF), tiers=((60, 10), (9000, 3600))).select("house", "external_id")


@query("capped_partition_plan", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def capped_partition_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges of a bucket hold all its rows, those over the cap too."""
    return capped_partition_ranges(spark, sf_dir).groupBy("o_orderpriority").agg(F.sum("n").alias("n"))


@query(
    "capped_partition_ranges",
    """WITH RECURSIVE c AS (SELECT o_orderpriority AS p, floor(o_totalprice * 100)::BIGINT AS v, count(*) AS c FROM orders GROUP BY ALL),
r AS (SELECT p, min(v) AS low, max(v) AS high, sum(c)::BIGINT AS n FROM c GROUP BY p
  UNION ALL
  SELECT h.p, h.low, h.high, sum(c.c)::BIGINT AS n
  FROM (SELECT p, CASE side WHEN 0 THEN low ELSE (low + high) // 2 + 1 END AS low, CASE side WHEN 0 THEN (low + high) // 2 ELSE high END AS high
        FROM r, (VALUES (0), (1)) AS sides(side) WHERE n > 500 AND low < high) h
  JOIN c ON c.p = h.p AND c.v BETWEEN h.low AND h.high GROUP BY ALL)
SELECT p AS o_orderpriority, low, high, n, n > 500 AS over_cap FROM r WHERE n <= 500 OR low >= high""",
)
def capped_partition_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = table(spark, sf_dir, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100))
    return queues.capped_ranges(cents, "o_orderpriority", "cents", cap=500)


@query("sitemap_pages", "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 400 AS page FROM customer")
def sitemap_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.numbered_pages(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 400)


@query("current_bids", f"WITH {BIDS_SQL} SELECT item_id, max(value) AS current_bid, count(*) AS bid_count FROM bids GROUP BY item_id")
def current_bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.current_bids(bids(spark, sf_dir))


@query("tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, max(value) AS high FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.tumbling(table(spark, sf_dir, "events"))


@query("sliding_counts", "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS start, count(*) AS n FROM events, range(4) AS r(k) GROUP BY ALL")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sliding(table(spark, sf_dir, "events"))


@query("session_windows", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, s.s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sessions(table(spark, sf_dir, "events"))


@query("rate_limit", "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.over_limit(table(spark, sf_dir, "events"), "user_id", 1, "1 hour")


@query("dedup_events", "SELECT DISTINCT event_id FROM events")
def dedup_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return B.dedup_events(e.unionByName(e)).select("event_id")


@query(
    "soft_close_final",
    f"""WITH RECURSIVE {BIDS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at, bid_id) AS rn FROM bids),
s AS (SELECT item_id, rn, created_at + INTERVAL 400 MINUTE AS close, value AS high FROM r WHERE rn = 1
  UNION ALL SELECT r.item_id, r.rn, greatest(s.close, r.created_at + INTERVAL 240 MINUTE), greatest(s.high, r.value)
  FROM s JOIN r ON r.item_id = s.item_id AND r.rn = s.rn + 1 AND r.created_at <= s.close)
SELECT item_id, max(high) AS final_bid, count(*) AS bid_count, max(close) AS ended_at FROM s GROUP BY item_id""",
)
def soft_close_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.soft_close_batch(bids(spark, sf_dir), run=400, extend=240)
