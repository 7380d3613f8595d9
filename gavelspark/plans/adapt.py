"""The engine's entities as views over the star-schema tables.

An item is a line item with its part, supplier and nation; sold history comes from finished orders; bids are events.
``ITEMS_SQL`` and its siblings state the same views in ANSI SQL, for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = "2001-06-01 00:00:00"
EVENTS_AS_OF = "2024-01-20 00:00:00"
HOUSES = ("tovek", "auctionet", "riksauktioner", "bukowskis", "bna", "klaravik", "psauction", "retrade", "netauktion", "junora", "siko", "budi")
CURRENCIES = ("SEK", "EUR", "GBP", "DKK", "USD", "NOK", "JPY")


def ntz(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over all cores, for work that costs much more than reading: a small file is read by few tasks."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def _pick(values: tuple[str, ...], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item. Dimension tables are joined as Spark sees fit: their sizes decide."""
    line, part, supplier, nation = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation"))
    rows = line.join(part, line.l_partkey == part.p_partkey).join(supplier, line.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey)
    return rows.select(
        _pick(HOUSES, F.col("l_suppkey")).alias("house"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("external_id"),
        F.col("l_orderkey").alias("auction_id"),
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("seller"),
        F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand")).alias("category"),
        F.col("n_name").alias("location"),
        _pick(CURRENCIES, F.col("s_nationkey")).alias("currency"),
        F.when(F.col("l_linestatus") == "O", "active").otherwise("ended").alias("status"),
        F.floor("l_extendedprice").alias("current_bid"),
        F.floor("p_retailprice").alias("min_bid"),
        F.col("l_quantity").cast("int").alias("bid_count"),
        F.col("l_shipdate").alias("ends_at"),
        F.when(F.col("l_tax") > 0, F.floor(F.col("l_tax") * 1000)).alias("fee_value"),
        F.when(F.col("l_discount") > 0.02, F.when(F.col("l_returnflag") == "N", 0.0).otherwise(25.0)).alias("vat_rate"),
        F.col("l_returnflag").alias("flag"),
    )


ITEMS_SQL = f"""items AS (
  SELECT list_extract([{", ".join(f"'{h}'" for h in HOUSES)}], (l_suppkey % {len(HOUSES)} + 1)::INT) AS house,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS external_id,
         l_orderkey AS auction_id, p_partkey AS part_id, p_name AS title, p_brand AS seller,
         lower(p_type) || '/' || lower(p_brand) AS category, n_name AS location,
         list_extract([{", ".join(f"'{c}'" for c in CURRENCIES)}], (s_nationkey % {len(CURRENCIES)} + 1)::INT) AS currency,
         CASE WHEN l_linestatus = 'O' THEN 'active' ELSE 'ended' END AS status,
         floor(l_extendedprice)::BIGINT AS current_bid, floor(p_retailprice)::BIGINT AS min_bid,
         l_quantity::INT AS bid_count, l_shipdate AS ends_at,
         CASE WHEN l_tax > 0 THEN floor(l_tax * 1000)::BIGINT END AS fee_value,
         CASE WHEN l_discount > 0.02 THEN CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE 25.0 END END AS vat_rate,
         l_returnflag AS flag
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold and unsold lots of finished orders."""
    line, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(part, line.l_partkey == part.p_partkey)
    return rows.select(
        _pick(HOUSES, F.col("l_suppkey")).alias("house"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("external_id"),
        F.col("p_name").alias("title"),
        F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand")).alias("category"),
        F.floor("l_extendedprice").alias("final_bid"),
        F.floor(F.col("l_extendedprice") * 1.25).alias("final_total"),
        (F.col("o_orderstatus") == "F").alias("sold"),
        F.col("o_orderdate").alias("ended_at"),
    )


HISTORY_SQL = f"""history AS (
  SELECT list_extract([{", ".join(f"'{h}'" for h in HOUSES)}], (l_suppkey % {len(HOUSES)} + 1)::INT) AS house,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * 100)::BIGINT) AS external_id,
         p_name AS title, lower(p_type) || '/' || lower(p_brand) AS category,
         floor(l_extendedprice)::BIGINT AS final_bid, floor(l_extendedprice * 1.25)::BIGINT AS final_total,
         o_orderstatus = 'F' AS sold, o_orderdate AS ended_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("bid_id"), F.col("user_id").alias("item_id"), F.col("value"), F.col("event_type").alias("type"), F.col("ts").alias("created_at"), F.get_json_object("props", "$.k").cast("long").alias("k")
    )


BIDS_SQL = """bids AS (
  SELECT event_id AS bid_id, user_id AS item_id, value, event_type AS type, ts AS created_at,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""


def lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lot per order, with reserves, classification state and a raw payload; sales and writes work on these."""
    c, key = F.col, F.col("o_orderkey")
    title = F.element_at(F.array(*[F.lit(t) for t in LOT_TITLES]), (key % len(LOT_TITLES) + 1).cast("int"))
    price = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        _pick(HOUSES, c("o_custkey")).alias("house"), key.cast("string").alias("external_id"), (c("o_custkey") % 50).cast("string").alias("auction_external_id"), (c("o_custkey") % 70).cast("string").alias("part_external_id"), title.alias("title"),
        F.lit(None).cast("string").alias("description"), F.when(c("o_orderstatus") == "F", "ended").otherwise("active").alias("status"), c("o_orderdate").alias("ends_at"), F.when(key % 11 > 0, price).alias("current_bid"), F.lit(100).cast("long").alias("min_bid"),
        F.when(key % 5 == 0, "not_met").when(key % 5 == 1, "met").alias("reserve_status"), F.when(key % 7 == 0, price + 1).when(key % 7 == 1, price).alias("reserve_price"), F.when(key % 3 > 0, c("o_custkey") % 200).alias("fee_value"), F.when(key % 2 == 0, 25.0).otherwise(0.0).alias("vat_rate"),
        F.lit("SEK").alias("currency"), F.when(key % 4 > 0, c("o_orderpriority")).alias("category"), F.element_at(F.array(*[F.lit(x) for x in CONFIDENCES]), (key % len(CONFIDENCES) + 1).cast("int")).alias("category_conf"), (key % 9 == 0).alias("category_conflict"),
        F.to_json(F.struct(F.when(key % 2 == 0, "cars").otherwise("it").alias("category"))).alias("raw"), F.when(key % 13 == 0, True).alias("insolvency"))


LOT_TITLES = ("Volvo V70 kombi 2008", "Guldring 18k med safir", "LP-skiva vinyl Abba", "Okänd sak")
CONFIDENCES = ("text", "house", "none", "llm", "human", "learned", "text")
LOTS_SQL = f"""lots AS (
  SELECT list_extract([{", ".join(f"'{h}'" for h in HOUSES)}], (o_custkey % {len(HOUSES)} + 1)::INT) AS house, o_orderkey::VARCHAR AS external_id, (o_custkey % 50)::VARCHAR AS auction_external_id, (o_custkey % 70)::VARCHAR AS part_external_id,
         list_extract([{", ".join(f"'{t}'" for t in LOT_TITLES)}], (o_orderkey % {len(LOT_TITLES)} + 1)::INT) AS title, NULL::VARCHAR AS description, CASE WHEN o_orderstatus = 'F' THEN 'ended' ELSE 'active' END AS status, o_orderdate AS ends_at,
         CASE WHEN o_orderkey % 11 > 0 THEN floor(o_totalprice)::BIGINT END AS current_bid, 100::BIGINT AS min_bid, CASE o_orderkey % 5 WHEN 0 THEN 'not_met' WHEN 1 THEN 'met' END AS reserve_status,
         CASE o_orderkey % 7 WHEN 0 THEN floor(o_totalprice)::BIGINT + 1 WHEN 1 THEN floor(o_totalprice)::BIGINT END AS reserve_price, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 200 END AS fee_value, CASE WHEN o_orderkey % 2 = 0 THEN 25.0 ELSE 0.0 END AS vat_rate, 'SEK' AS currency,
         CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS category, list_extract([{", ".join(f"'{x}'" for x in CONFIDENCES)}], (o_orderkey % {len(CONFIDENCES)} + 1)::INT) AS category_conf, o_orderkey % 9 = 0 AS category_conflict, o_orderkey AS k, o_custkey AS cust, CASE WHEN o_orderkey % 13 = 0 THEN true END AS insolvency
  FROM orders)"""
