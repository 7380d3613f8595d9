"""Merges as pure functions: (current rows, batch) to next rows.

Plain tables have no MERGE, so each policy is one full outer join on the key with a rule per column; the caller writes
the result as the next snapshot. Batches are reduced to one row per key first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..rules.classify import by_text, confidence_rank, conflict, house_category
from ..rules.fees import with_total
from ..rules.tables import INSOLVENCY_WORDS
from .price import verified_sold

Rule = Callable[[str], Column]


def old(c: str) -> Column:
    return F.col(f"o.{c}")


def new(c: str) -> Column:
    return F.col(f"n.{c}")


#: The batch's value where there is a batch row.
overwrite: Rule = lambda c: F.when(F.col("n.__in"), new(c)).otherwise(old(c))
keep_if_null: Rule = lambda c: F.coalesce(new(c), old(c))
keep_first: Rule = lambda c: F.when(F.col("o.__in"), old(c)).otherwise(new(c))
monotone: Rule = lambda c: F.greatest(new(c), old(c))
add: Rule = lambda c: F.coalesce(old(c), F.lit(0)) + F.coalesce(new(c), F.lit(0))


def sticky_basis(c: str) -> Column:
    """'external' never replaces a better basis."""
    return F.when(new(c).isNull() | ((new(c) == "external") & old(c).isNotNull()), old(c)).otherwise(new(c))


def guarded(confidence: str) -> Rule:
    """The old value stays iff its confidence ranks higher than the new one's."""
    return lambda c: F.when(F.col("o.__in") & (~F.coalesce(F.col("n.__in"), F.lit(False)) | (confidence_rank(old(confidence)) > confidence_rank(new(confidence)))), old(c)).otherwise(new(c))


def human_wins(source: str = "source") -> Rule:
    """A human verdict is never overwritten by another kind."""
    return lambda c: F.when(F.col("n.__in") & ~((F.coalesce(old(source), F.lit("")) == "human") & (new(source) != "human")), new(c)).otherwise(old(c))


def merge(current: DataFrame, batch: DataFrame, key: list[str], rules: dict[str, Rule], flag: str | None = None) -> DataFrame:
    """Next rows with the key, the ruled columns and, if asked for, a flag for keys that are new."""
    o, n = current.withColumn("__in", F.lit(True)).alias("o"), batch.withColumn("__in", F.lit(True)).alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    rows = o.join(n, condition, "full")
    picked = [F.coalesce(new(k), old(k)).alias(k) for k in key] + [r(c).alias(c) for c, r in rules.items()]
    if flag:
        picked.append((F.col("n.__in").isNotNull() & F.col("o.__in").isNull()).alias(flag))
    return rows.select(*picked)


ITEM_RULES: dict[str, Rule] = {
    "title": overwrite, "status": overwrite, "ends_at": keep_if_null, "description": keep_if_null, "min_bid": keep_if_null, "seller": keep_if_null,
    "current_bid": monotone, "bid_count": monotone, "total_price": monotone, "total_basis": sticky_basis, "currency": keep_if_null, "fee_value": keep_if_null, "vat_rate": keep_if_null,
    "reserve_status": keep_if_null, "reserve_price": keep_if_null, "part_external_id": keep_if_null, "auction_external_id": keep_if_null, "raw": keep_if_null,
    "category": guarded("category_conf"), "category_conf": guarded("category_conf"), "first_seen": keep_first,
}


def merge_items(current: DataFrame, batch: DataFrame, key: tuple[str, ...] = ("house", "external_id")) -> DataFrame:
    rules = {c: r for c, r in ITEM_RULES.items() if c in current.columns and c in batch.columns}
    return merge(current, batch, list(key), rules, "inserted")


def leading_bids(bids: DataFrame, item: str = "item_id") -> DataFrame:
    """Per item: highest bid, the earliest bid that reached it, and the number of bids."""
    lead = F.max(F.struct("value", (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), (-F.col("bid_id")).alias("b")))
    return bids.groupBy(item).agg(lead.alias("l"), F.count(F.lit(1)).alias("bid_count")).select(item, F.col("l.value").alias("current_bid"), (-F.col("l.b")).alias("leader_bid"), "bid_count")


def sync_children(current: DataFrame, batch: DataFrame, owner: list[str], child: str, keep: list[str]) -> DataFrame:
    """Children of owners in the batch are replaced by the batch's; owners that the batch does not have keep theirs."""
    untouched = current.join(batch.select(*owner).distinct(), owner, "left_anti")
    return untouched.select(*owner, child, *keep).unionByName(batch.select(*owner, child, *keep))


def finalize(items: DataFrame, as_of: Column, grace_minutes: int = 10) -> tuple[DataFrame, DataFrame]:
    """(next items, newly ended history rows): active items past their end by the grace period end."""
    due = (F.col("status") == "active") & (F.col("ends_at") < as_of - F.expr(f"INTERVAL {grace_minutes} MINUTES"))
    after = items.withColumn("status", F.when(F.coalesce(due, F.lit(False)), "ended").otherwise(F.col("status")))
    ended = items.filter(due).withColumn("sold", F.coalesce(F.col("current_bid") > 0, F.lit(False)))
    return after, ended.select("house", "external_id", "title", "category", F.col("current_bid").alias("final_bid"), "sold", F.col("ends_at").alias("ended_at"))


def missing_from(current: DataFrame, sweep: DataFrame, key: list[str]) -> DataFrame:
    """Active rows that a full sweep no longer has."""
    return current.filter("status = 'active'").join(sweep.select(*key).distinct(), key, "left_anti")


def insert_absent(current: DataFrame, batch: DataFrame, key: list[str]) -> DataFrame:
    return current.unionByName(batch.join(current.select(*key), key, "left_anti"), allowMissingColumns=True)


AUCTION_RULES: dict[str, Rule] = {"title": overwrite, "description": keep_if_null, "contact": overwrite, "last_pay_date": overwrite, "source_url": overwrite}
#: A bid's value and time never change once they are known.
BID_RULES: dict[str, Rule] = {"item_id": overwrite, "type": overwrite, "raw": overwrite, "value": keep_first, "created_at": keep_first}
#: A sale keeps its title, and its payload where the new one has none.
SALE_RULES: dict[str, Rule] = {"title": keep_first, "category": overwrite, "final_bid": overwrite, "final_total": overwrite, "sold": overwrite, "ended_at": overwrite, "raw": keep_if_null}


def _ruled(current: DataFrame, batch: DataFrame, key: tuple[str, ...], rules: dict[str, Rule]) -> DataFrame:
    return merge(current, batch, list(key), {c: r for c, r in rules.items() if c in current.columns and c in batch.columns})


def merge_auctions(current: DataFrame, batch: DataFrame, key: tuple[str, ...] = ("house", "external_id")) -> DataFrame:
    return _ruled(current, batch, key, AUCTION_RULES)


def merge_bids(current: DataFrame, batch: DataFrame, key: tuple[str, ...] = ("bid_id",)) -> DataFrame:
    return _ruled(current, batch, key, BID_RULES)


def refresh_items(items: DataFrame, batch: DataFrame, key: tuple[str, ...] = ("house", "external_id")) -> DataFrame:
    """``items`` after a batch of bids (key, value): those that have some take the highest and their number, and every
    fee and total is computed anew from the bid."""
    top = batch.groupBy(*key).agg(F.max("value").alias("__top"), F.count(F.lit(1)).alias("__n"))
    rows = items.join(top, list(key), "left")
    new = {"current_bid": F.coalesce("__top", "current_bid"), "bid_count": F.coalesce(F.col("__n").cast("int"), F.col("bid_count")) if "bid_count" in items.columns else F.col("__n").cast("int")}
    columns = [c for c in items.columns if c not in ("fee", "vat", "total_price", "total_basis", *new)]
    return with_total(rows.select(*columns, *[v.alias(k) for k, v in new.items()]))


def move_ends(items: DataFrame, updates: DataFrame, key: tuple[str, ...] = ("house", "external_id")) -> DataFrame:
    """``items`` with the ends of ``updates``; an unknown end changes nothing."""
    rows = items.join(updates.select(*key, F.col("ends_at").alias("__end")), list(key), "left")
    return rows.select(*[F.coalesce("__end", "ends_at").alias(c) if c == "ends_at" else F.col(c) for c in items.columns])


def sales_of(items: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """History rows of lots that are over. A lot counts as sold with a positive bid unless its reserve is known to be
    unmet; its category is its part's (``parts``: house, external_id, category) where parts are given."""
    if parts is not None:
        own = parts.select("house", F.col("external_id").alias("part_external_id"), F.col("category").alias("__category"))
        items = items.join(own, ["house", "part_external_id"], "left").drop("category").withColumnRenamed("__category", "category")
    bid = F.coalesce("current_bid", F.lit(0))
    sold = (bid > 0) & verified_sold(bid, F.col("reserve_price"), F.col("reserve_status"))
    total = F.col("total_price") if "total_price" in items.columns else F.lit(None).cast("long")
    return items.select("house", "external_id", "title", "category", bid.alias("final_bid"), total.alias("final_total"), sold.alias("sold"), F.col("ends_at").alias("ended_at"), "raw")


def finalize_keys(items: DataFrame, history: DataFrame, keys: DataFrame, as_of: Column, parts: DataFrame | None = None, guard_minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """(next items, next history) after the lots of ``keys`` were told to be over. A lot whose end lies more than the
    guard ahead stays as it is, whatever the source says; doing it twice changes nothing more."""
    fair = F.col("ends_at").isNull() | (F.col("ends_at") <= as_of + F.expr(f"INTERVAL {guard_minutes} MINUTES"))
    told = keys.select("house", "external_id").distinct().withColumn("__told", F.lit(True))
    rows = items.join(told, ["house", "external_id"], "left").withColumn("__over", F.coalesce("__told", F.lit(False)) & fair)
    after = rows.select(*[F.when(F.col("__over"), "ended").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in items.columns])
    return after, _ruled(history, sales_of(rows.filter("__over").select(*items.columns), parts), ("house", "external_id"), SALE_RULES)


def record_sales(history: DataFrame, ended: DataFrame) -> DataFrame:
    """Next history after lots that were over when they were first seen; the totals are computed here, and the title is
    the latest."""
    sales = sales_of(with_total(ended.drop("fee", "vat", "total_price", "total_basis")))
    return _ruled(history, sales, ("house", "external_id"), SALE_RULES | {"title": overwrite})


def decide(items: DataFrame, decisions: DataFrame, key: tuple[str, ...] = ("house", "external_id")) -> DataFrame:
    """``items`` after reviews (key, decision). 'approve' makes a category certain if there is one, 'reject' takes it
    away and asks again, 'use_house' takes ``house_key``, where the source has one, as certain."""
    rows = items.join(decisions.select(*key, F.col("decision").alias("__d")), list(key), "left")
    approve = F.coalesce((F.col("__d") == "approve") & F.col("category").isNotNull(), F.lit(False))
    reject = F.coalesce(F.col("__d") == "reject", F.lit(False))
    own = F.coalesce((F.col("__d") == "use_house") & F.col("house_key").isNotNull(), F.lit(False))
    new = {
        "category": F.when(own, F.col("house_key")).when(~reject, F.col("category")),
        "category_conf": F.when(approve | own, "human").when(~reject, F.col("category_conf")),
        "category_conflict": F.when(approve | own, False).when(reject, True).otherwise(F.col("category_conflict")),
    }
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in items.columns])


def insolvent() -> Column:
    """Whether an auction's title or contact tells of an insolvency."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(field).ilike(f"%{word}%"), F.lit(False)) for field, word in INSOLVENCY_WORDS])


def flag_insolvency(items: DataFrame, auctions: DataFrame) -> DataFrame:
    """Active lots that are not flagged yet take the flag from their auction; flags that are set stay."""
    marked = auctions.filter(insolvent()).select("house", F.col("external_id").alias("auction_external_id")).distinct().withColumn("__marked", F.lit(True))
    rows = items.join(marked, ["house", "auction_external_id"], "left")
    flag = F.when((F.col("status") == "active") & F.col("insolvency").isNull(), F.coalesce("__marked", F.lit(False))).otherwise(F.col("insolvency"))
    return rows.select(*[flag.alias(c) if c == "insolvency" else F.col(c) for c in items.columns])


def flag_conflicts(items: DataFrame) -> DataFrame:
    """Active lots classified by their text are marked where the source's own category has another main. One pass over
    all of them stands for a sweep with a cursor."""
    own = house_category(F.col("house"), F.col("raw"))["key"]
    asked = (F.col("status") == "active") & (F.col("category_conf") == "text")  # the rules are costly and change no other lot
    clash = conflict(F.when(asked, by_text(F.col("title"), F.col("description"))), F.col("category_conf"), F.when(asked, own)) & (F.col("status") == "active")
    return items.withColumn("category_conflict", F.coalesce(clash, F.lit(False)) | F.col("category_conflict"))


def ingest(state: dict[str, DataFrame], parts: DataFrame, items: DataFrame, bids: DataFrame, as_of: Column, grace_minutes: int = 10) -> dict[str, DataFrame]:
    """The next 'parts', 'items', 'bids' and 'history' after one load: parts, then lots, then bids with the refresh of
    their lots, then lots past their end. Each step is a merge of its own, so a caller may write and reread between."""
    key = ("house", "external_id")
    next_parts = _ruled(state["parts"], parts, key, {c: overwrite for c in state["parts"].columns if c not in key})
    loaded = merge_items(state["items"], items).drop("inserted")
    next_bids = merge_bids(state["bids"], bids, ("house", "external_id", "bid_id"))
    fresh = refresh_items(loaded.drop("total_price", "total_basis"), bids)
    due = (F.col("status") == "active") & (F.col("ends_at") < as_of - F.expr(f"INTERVAL {grace_minutes} MINUTES"))
    after, history = finalize_keys(fresh, state["history"], fresh.filter(due).select(*key), as_of, next_parts)
    return {"parts": next_parts, "items": after, "bids": next_bids, "history": history}
