"""What every source must yield: one row per lot under a common schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ITEM_COLUMNS = {
    "house": "string", "external_id": "string", "auction_external_id": "string", "title": "string", "description": "string", "location": "string",
    "status": "string", "ends_at": "timestamp_ntz", "listed_at": "timestamp_ntz", "min_bid": "bigint", "current_bid": "bigint", "bid_count": "int", "reserve_status": "string",
    "reserve_price": "bigint", "fee_value": "bigint", "vat_rate": "double", "currency": "string", "seller": "string", "source_url": "string",
    "media": "array<string>", "raw": "string",
}


def conform(rows: DataFrame, house: str, **columns: Column) -> DataFrame:
    """The contract's columns from the given expressions; what a source does not know is null. Lots without a key are
    dropped, a bid of a lot without bids is null, and a lot whose end has passed is not active."""
    given = {"house": F.lit(house), "currency": F.lit("SEK"), **columns}
    typed = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in ITEM_COLUMNS.items()]
    out = rows.select(*typed).filter(F.col("external_id").isNotNull())
    return out.withColumn("current_bid", F.when(F.coalesce("bid_count", F.lit(1)) > 0, F.col("current_bid")))


def status_at(ends: Column, as_of: Column, open_: Column | None = None) -> Column:
    """'active' while the source says so and the end lies ahead or is unknown."""
    live = F.coalesce(ends > as_of, F.lit(True))
    return F.when(live if open_ is None else live & F.coalesce(open_, F.lit(False)), "active").otherwise("ended")


def reserve(met: Column, none: Column) -> Column:
    """'none', 'met', 'not_met', or null when the source tells nothing."""
    return F.when(F.coalesce(none, F.lit(False)), "none").when(met, "met").when(~met, "not_met")


def all_sources(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
