"""Queries over what is kept between runs: bucketed tables under merges, the trigram index, searches at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import merge as M, saved
from ..operators.gram_index import GramIndex, rows_with
from ..operators.kept import KeptTable
from ..operators.stable import pinned, shared_path
from . import queries_state  # noqa: F401 (its SQL is used here)
from .adapt import ITEMS_SQL, history, items, lots, ntz, table
from .queries_prices import _sim
from .queries_writes import _SALE, AS_OF
from .registry import ORACLE, query

c = F.col
#: Lots of a step in which a kept table is made.
LOTS_A_STEP = 50_000_000


def _over(name: str, columns: str) -> str:
    return f"SELECT {columns} FROM ({ORACLE[name]})"


@query("item_merge_kept", _over("item_merge", "* EXCLUDE (inserted)"))
def item_merge_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge of ``item_merge`` on a kept table: one batch is merged at once, the other two are logged and settled."""
    o = table(spark, sf_dir, "orders")
    current = o.filter("o_orderkey % 3 != 0").select(
        c("o_orderkey").alias("k"), c("o_orderpriority").alias("title"), c("o_totalprice").alias("current_bid"), F.when(c("o_custkey") % 2 == 0, c("o_orderstatus")).alias("description"),
        F.when(c("o_custkey") % 4 == 0, "human").otherwise("text").alias("category_conf"), F.concat(F.lit("a"), c("o_custkey") % 5).alias("category"), F.when(c("o_custkey") % 3 == 0, "source").alias("total_basis"))
    batch = o.filter("o_orderkey % 2 = 0").select(
        c("o_orderkey").alias("k"), F.lit("new").alias("title"), (c("o_totalprice") * F.when(c("o_custkey") % 2 == 0, 2).otherwise(0.5)).alias("current_bid"), F.when(c("o_custkey") % 3 == 0, "d").alias("description"),
        F.lit("llm").alias("category_conf"), F.concat(F.lit("b"), c("o_custkey") % 5).alias("category"), F.lit("external").alias("total_basis"))
    kept = KeptTable.create(shared_path(spark, "kept"), current, ["k"])
    step = lambda now, new: M.merge_items(now, new, ("k",)).drop("inserted")
    kept.merge(batch.filter("k % 10 = 0"), step)
    kept.log(batch.filter("k % 10 IN (2, 4)"))
    kept.log(batch.filter("k % 10 IN (6, 8)"))
    kept.settle(step)
    return kept.read()


@query("bid_refresh_kept", ORACLE["bid_refresh"])
def bid_refresh_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refresh of ``bid_refresh`` on a kept table with its totals, in a batch for each of two groups of houses."""
    from ..rules.fees import with_total

    # the table holds what the refresh reads and what is asked of it: each merge writes its rows anew
    rows = items(spark, sf_dir).select("house", "external_id", "current_bid", "min_bid", "bid_count", "currency", "fee_value", "vat_rate")
    steps = max(1, -(-table(spark, sf_dir, "lineitem").count() // LOTS_A_STEP))
    kept = KeptTable.create(shared_path(spark, "kept"), with_total(rows), ["house", "external_id"], steps=steps)
    # a lot is in one batch only, so its bids follow from the kept lot, without the joins behind it
    for houses in ("house < 'k'", "house >= 'k'"):
        bids = kept.read().filter(houses).filter("bid_count % 3 = 0").select("house", "external_id", F.explode(F.array(c("current_bid") + 20, c("current_bid") + 10)).alias("value"))
        kept.merge(bids, lambda now, new: M.refresh_items(now, new))
        kept.vacuum(1)  # the files of two versions at a time
    return kept.read().select("house", "external_id", "current_bid", "bid_count", "fee", "total_price", "total_basis")


@query("finalize_history_kept", ORACLE["finalize_history"])
def finalize_history_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of ``finalize_history`` on a kept table; the lots that end are merged into their buckets twice, the
    second time without effect."""
    rows, as_of = lots(spark, sf_dir), ntz(AS_OF) - F.expr("INTERVAL 600 DAYS")
    parts = rows.filter(c("part_external_id").cast("int") % 3 > 0).select("house", c("part_external_id").alias("external_id"), F.concat(F.lit("cat"), "part_external_id").alias("category")).distinct()
    old = rows.filter(c("external_id").cast("long") % 4 == 0).select("house", "external_id", F.lit("old title").alias("title"), F.lit("old").alias("category"), F.lit(1).cast("long").alias("final_bid"), F.lit(None).cast("long").alias("final_total"), F.lit(False).alias("sold"), c("ends_at").alias("ended_at"), F.lit("kept").alias("raw"))
    kept = KeptTable.create(shared_path(spark, "kept"), old, ["house", "external_id"])
    keys = rows.filter(c("external_id").cast("long") % 2 == 0)
    ending = rows.join(keys.select("house", "external_id"), ["house", "external_id"], "left_semi")
    for _ in range(2):
        kept.merge(ending, lambda now, new: M.finalize_keys(new, now, new, as_of, parts)[1])
    return kept.read().select(*_SALE)


def _title_index(spark: SparkSession, titles: DataFrame) -> GramIndex:
    """An index of a third of the titles, to which the others come in two additions, the second after a compaction."""
    titles = pinned(titles.distinct())  # what they come from, often a join, is read once
    part = F.pmod(F.xxhash64(titles.columns[0]), F.lit(3))
    index = GramIndex.build(shared_path(spark, "grams"), titles.filter(part == 0), 16)
    return index.add(titles.filter(part == 1)).compact(1).add(titles.filter(part > 0))


@query("history_fuzzy_kept", ORACLE["history_fuzzy"])
def history_fuzzy_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir)
    index = _title_index(spark, rows.select("title"))
    found = index.search("gizmos", 0.3).select("text").union(index.containing("gizmo")).distinct()
    return rows_with(rows, "title", found).orderBy(F.desc("ended_at"), "house", "external_id").limit(60).select("house", "external_id", "title", "final_bid")


@query("fuzzy_join_kept", f"WITH names AS (SELECT DISTINCT p_name AS name FROM part), asked AS (SELECT DISTINCT p_name || ' ' || lower(p_brand[7:]) AS name FROM part), p AS (SELECT x.name AS a, y.name AS b, {_sim('x.name', 'y.name')} AS s FROM asked x, names y) SELECT a, b, round(s, 9) AS similarity FROM p WHERE s >= 0.6")
def fuzzy_join_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a number behind them, against an index of the names."""
    parts = table(spark, sf_dir, "part")
    index = _title_index(spark, parts.select("p_name"))
    asked = parts.select(F.concat("p_name", F.lit(" "), F.lower(F.substr("p_brand", F.lit(7)))).alias("name"))
    return index.similar(asked, 0.6).select("a", "b", F.round("similarity", 9).alias("similarity"))


_WORDS = ("widget", "ring", "gear", "bolt", "small", "red", "blue", "large", "zeppelin")
_SEARCHES_SQL = f"""vocabulary(v) AS (VALUES ([{", ".join(f"'{w}'" for w in _WORDS)}])),
searches AS (
  SELECT c_custkey AS search, CASE c_custkey % 4 WHEN 0 THEN [v[c_custkey % {len(_WORDS)} + 1]] WHEN 1 THEN [v[c_custkey % {len(_WORDS)} + 1], v[c_custkey // 7 % {len(_WORDS)} + 1]] END AS words,
         CASE WHEN c_custkey % 5 = 0 THEN ['tovek', 'siko'] END AS houses, CASE WHEN c_custkey % 3 = 0 THEN 'economy' WHEN c_custkey % 3 = 1 THEN 'small/brand#' || (c_custkey // 3 % 25 + 1) END AS category,
         CASE WHEN c_custkey % 6 = 0 THEN c_nationkey END AS nation, CASE WHEN c_custkey % 7 < 3 THEN floor(abs(c_acctbal) * 5)::BIGINT END AS low,
         CASE WHEN c_custkey % 7 < 3 THEN floor(abs(c_acctbal) * 5)::BIGINT + 4000 END AS high, c_custkey % 11 = 0 AS insolvent,
         CASE WHEN c_custkey % 13 <> 0 THEN TIMESTAMP '2000-01-01' + to_days((c_custkey % 90)::INT) ELSE TIMESTAMP '1999-12-01' END AS last_checked
  FROM customer, vocabulary)"""
_MATCHED_SQL = f"""WITH {ITEMS_SQL}, {_SEARCHES_SQL},
hits AS (SELECT s.search, i.house, i.external_id, i.title, i.ends_at AS first_seen FROM items i JOIN searches s
  ON i.ends_at > s.last_checked AND i.ends_at <= TIMESTAMP '2000-06-01'
  AND (s.category IS NULL OR i.category = s.category OR starts_with(i.category, s.category || '/')) AND (s.houses IS NULL OR list_contains(s.houses, i.house))
  AND (s.low IS NULL OR (i.current_bid >= s.low AND i.current_bid <= s.high)) AND (NOT s.insolvent OR i.bid_count % 6 = 0)
  AND (s.nation IS NULL OR contains(lower(i.location), lower('NATION_' || s.nation)))
  AND (s.words IS NULL OR (contains(i.title, s.words[1]) AND (s.words[2] IS NULL OR contains(i.title, s.words[2])))))"""


def saved_searches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(items, searches): a search for each customer, its conditions drawn from the customer's columns."""
    k, n = c("c_custkey"), len(_WORDS)
    word = lambda i: F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (i % n + 1).cast("int"))
    searches = table(spark, sf_dir, "customer").select(
        k.alias("search"),
        F.when(k % 4 == 0, F.array(word(k))).when(k % 4 == 1, F.array(word(k), word(F.floor(k / 7)))).alias("words"),
        F.when(k % 5 == 0, F.array(F.lit("tovek"), F.lit("siko"))).alias("houses"),
        F.when(k % 3 == 0, "economy").when(k % 3 == 1, F.concat(F.lit("small/brand#"), (F.floor(k / 3) % 25 + 1).cast("string"))).alias("category"),
        F.when(k % 6 == 0, F.concat(F.lit("NATION_"), c("c_nationkey").cast("string"))).alias("place"),
        F.when(k % 7 < 3, F.floor(F.abs("c_acctbal") * 5)).alias("low"),
        F.when(k % 7 < 3, F.floor(F.abs("c_acctbal") * 5) + 4000).alias("high"),
        (k % 11 == 0).alias("insolvent"),
        F.when(k % 13 != 0, ntz("2000-01-01 00:00:00") + F.make_dt_interval((k % 90).cast("int"))).otherwise(ntz("1999-12-01 00:00:00")).alias("last_checked"),
    )
    rows = items(spark, sf_dir).withColumns({"price": c("current_bid"), "insolvency": c("bid_count") % 6 == 0})
    return rows, searches


@query("saved_searches_all", f"{_MATCHED_SQL} SELECT search, house, external_id, title, first_seen FROM hits")
def saved_searches_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, searches = saved_searches(spark, sf_dir)
    return saved.match_saved(rows, searches, ntz("2000-06-01 00:00:00"), "ends_at", None)


@query("saved_searches_newest", f"{_MATCHED_SQL} SELECT search, house, external_id, title, first_seen FROM hits QUALIFY row_number() OVER (PARTITION BY search ORDER BY first_seen DESC, house, external_id) <= 30")
def saved_searches_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, searches = saved_searches(spark, sf_dir)
    return saved.match_saved(rows, searches, ntz("2000-06-01 00:00:00"), "ends_at")
