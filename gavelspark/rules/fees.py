"""The fee engine: what a buyer really pays for a bid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.money import half_up
from .tables import FEE_MODELS

SCHEMA = "house string, currency string, kind string, premium_rate double, premium_min double, premium_max double, lot_fee double, premium_vat double, fee_vat double, approximate boolean, external_fallback boolean"


def fee_table(spark: SparkSession) -> DataFrame:
    """One row for each house and currency; '*' stands for all other currencies. Some thirty rows, whatever the data."""
    return spark.createDataFrame([tuple(r) for r in FEE_MODELS], SCHEMA)


def with_model(items: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """``items`` with the columns of its house's model under ``m_``; houses without one are plain sources. The models of
    a house come as one map by currency, so that one broadcast join finds them."""
    models = fee_table(items.sparkSession) if models is None else models
    terms = [c for c in models.columns if c not in ("house", "currency")]
    by_house = models.groupBy(F.col("house").alias("__house")).agg(F.map_from_entries(F.collect_list(F.struct("currency", F.struct(*terms)))).alias("__models"))
    rows = items.join(F.broadcast(by_house), F.col("house") == F.col("__house"), "left")
    own = F.try_element_at("__models", F.upper(F.coalesce("currency", F.lit("SEK"))))
    rows = rows.withColumn("__model", F.coalesce(own, F.try_element_at("__models", F.lit("*"))))
    picked = [F.col("__model")[c].alias("m_" + c) for c in terms if c != "kind"]
    return rows.select(*items.columns, F.coalesce(F.col("__model")["kind"], F.lit("source")).alias("m_kind"), *picked)


def with_total(items: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """``items`` with fee, vat, total_price and total_basis. Each part is rounded by itself, and the total from the
    unrounded sum; a total is known only for a positive price, or where the fee is external."""
    zero, c = F.lit(0.0), F.col
    rows = with_model(items, models).withColumns({"__bid": F.coalesce("current_bid", "min_bid", F.lit(0)).cast("double"), "__given": c("fee_value").cast("double"), "__vat": c("vat_rate").cast("double")})
    premium = F.greatest(c("__bid") * c("m_premium_rate"), F.coalesce("m_premium_min", zero))
    own_vat = c("__bid") * (F.coalesce("__vat", zero) / 100)
    told = c("__given").isNotNull() | c("__vat").isNotNull()
    external = (c("m_kind") == "external") | ((c("m_kind") == "source") & F.coalesce("m_external_fallback", F.lit(False)) & c("__given").isNull())
    by_rate = c("m_kind") == "percentage"
    rows = rows.withColumns({
        "__premium": F.when(by_rate, F.coalesce(F.least(premium, c("m_premium_max")), premium)),
        "__own": own_vat,
        "total_basis": F.when(external, "external").when(by_rate, "percentage").when(told & F.coalesce("m_approximate", F.lit(False)), "estimate").otherwise("source"),
    })
    known_fee = F.when(by_rate, c("__premium") + F.coalesce("m_lot_fee", zero)).otherwise(F.coalesce("__given", zero))
    known_vat = F.when(by_rate, F.coalesce("m_premium_vat", zero) * c("__premium") + c("__own")).otherwise(c("__own") + F.coalesce("__given", zero) * F.coalesce("m_fee_vat", "__vat", zero) / 100)
    outside = c("total_basis") == "external"
    rows = rows.withColumns({"__fee": F.when(outside, zero).otherwise(known_fee), "__tax": F.when(outside, zero).otherwise(known_vat)})
    whole = lambda x: half_up(x).cast("long")
    total = F.when((c("__bid") > 0) | outside, whole(c("__bid") + c("__fee") + c("__tax")))
    return rows.select(*items.columns, whole(c("__fee")).alias("fee"), whole(c("__tax")).alias("vat"), total.alias("total_price"), "total_basis")
