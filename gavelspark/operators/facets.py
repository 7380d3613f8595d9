"""Facets, dashboards and other aggregations over items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import city_name, normalise_location
from ..rules.tables import TAXONOMY


def category_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(main, main_label, sub, label): the fixed taxonomy, some eighty rows."""
    return spark.createDataFrame([(m, ml, s, sl) for m, ml, s, sl in TAXONOMY], "main string, main_label string, sub string, label string")


def rollup_counts(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """Counts per main and sub of the taxonomy, zeros filled in; a main's total counts all its keys, known or not."""
    own = counts.select(F.col("category"), "n")
    subs = tree.join(own, F.concat_ws("/", "main", "sub") == F.col("category"), "left").select("main", "sub", F.coalesce("n", F.lit(0)).alias("n"))
    mains = own.groupBy(F.substring_index("category", "/", 1).alias("main")).agg(F.sum("n").alias("n"))
    total = tree.select("main").distinct().join(mains, "main", "left").select("main", F.lit(None).cast("string").alias("sub"), F.coalesce("n", F.lit(0)).alias("n"))
    return subs.unionByName(total)


def location_counts(items: DataFrame, first: int = 150, last: int = 40) -> DataFrame:
    """The ``last`` most frequent places after the ``first`` most frequent spellings were translated and merged."""
    raw = items.groupBy(normalise_location(F.col("location")).alias("place")).agg(F.count(F.lit(1)).alias("n")).filter("place != ''")
    top = raw.orderBy(F.desc("n"), "place").limit(first)
    return top.groupBy(city_name(F.col("place")).alias("place")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "place").limit(last)


def counts_by(items: DataFrame, *cols: str, only: Column | None = None) -> DataFrame:
    rows = items if only is None else items.filter(only)
    return rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def house_dashboard(items: DataFrame, as_of: Column) -> DataFrame:
    """Per house: lots, active and overdue ones, known totals in percent, average bid count."""
    active = F.col("status") == "active"
    return items.groupBy("house").agg(
        F.count(F.lit(1)).alias("lots"),
        F.count_if(active).alias("active"),
        F.count_if(active & (F.col("ends_at") <= as_of)).alias("overdue"),
        F.round(100.0 * F.count_if(F.col("fee_value").isNotNull()) / F.count(F.lit(1)), 1).alias("fee_percent"),
        F.round(F.avg("bid_count"), 3).alias("avg_bids"),
    )


def global_counts(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("lots"), F.count_if(F.col("status") == "active").alias("active"), F.countDistinct("house").alias("houses"), F.countDistinct("category").alias("categories"))


def index_percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Order statistics by place: element floor(q n) of the sorted values (the upper median at one half), with rounded
    extremes and mean. Equal values are counted before anything is sorted, so a hot group shrinks to its distinct
    values; nulls do not count, and groups without a value are left out."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by)
    rows = counts.withColumns({"__upto": F.sum("__c").over(group.orderBy("__v")), "__n": F.sum("__c").over(group)})
    pick = lambda q: F.min(F.when(F.col("__upto") > F.least(F.floor(F.col("__n") * q), F.col("__n") - 1), F.col("__v")))
    return rows.groupBy(*by).agg(
        F.sum("__c").alias("n"), pick(0.25).alias("p25"), pick(0.5).alias("median"), pick(0.75).alias("p75"),
        F.min("__v").alias("low"), F.max("__v").alias("high"), F.floor(F.sum(F.col("__v") * F.col("__c")) / F.sum("__c") + 0.5).alias("mean"),
    )


def percentiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Interpolated quartiles with extremes, mean and count. Equal values are counted first, so that what one task holds
    of a hot group are its distinct values."""
    counts = df.groupBy(*by, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    quartiles = F.percentile("__v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("__c"))
    known = F.when(F.col("__v").isNotNull(), F.col("__c"))
    mean = F.round(F.sum(F.col("__v") * F.col("__c")) / F.sum(known), 4)
    rows = counts.groupBy(*by).agg(quartiles.alias("q"), F.min("__v").alias("low"), F.max("__v").alias("high"), mean.alias("mean"), F.coalesce(F.sum(known), F.lit(0)).alias("n"))
    return rows.select(*by, *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "median", "p75"))], "low", "high", "mean", "n")


def first_by(df: DataFrame, by: list[str], order: Column, *cols: str) -> DataFrame:
    """One row per group, the first by ``order``; a plain minimum, so hot groups combine before the shuffle."""
    return df.groupBy(*by).agg(F.min(F.struct(order.alias("__o"), *cols)).alias("__f")).select(*by, *[F.col(f"__f.{c}").alias(c) for c in cols])


def coverage(items: DataFrame, children: DataFrame, key: list[str], by: str, digits: int = 0) -> DataFrame:
    """Per group: items, and the share of those that have a child, in percent."""
    with_child = children.select(*key).distinct().withColumn("__has", F.lit(True))
    rows = items.join(with_child, key, "left")
    has = F.count_if(F.col("__has"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), has.alias("covered"), F.round(100.0 * has / F.count(F.lit(1)), digits).alias("percent"))


def processing_state(images: DataFrame, key: list[str], vector: str, since: Column, done_at: str) -> DataFrame:
    """One row: items with images, those with a vector, those without a try, and tries a second over the last minute.
    An empty vector marks a try that gave nothing."""
    each = images.groupBy(*key).agg(F.bool_or(F.coalesce(F.size(vector) > 0, F.lit(False))).alias("ok"), F.bool_or(F.col(vector).isNotNull()).alias("tried"), F.count_if(F.col(done_at) > since).alias("recent"))
    return each.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("tried")).alias("remaining"), (F.coalesce(F.sum("recent"), F.lit(0)) / 60).alias("rate"))


def soonest(items: DataFrame, as_of: Column) -> DataFrame:
    """Milliseconds until the next end of each house's active items."""
    ahead = items.filter((F.col("status") == "active") & (F.col("ends_at") > as_of)).groupBy("house").agg(F.min("ends_at").alias("e"))
    return ahead.select("house", F.timestamp_diff("MILLISECOND", as_of, F.col("e")).alias("ms"))


def galleries(images: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """Items that have several images already."""
    return images.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def places(items: DataFrame) -> DataFrame:
    return items.select(normalise_location(F.col("location")).alias("place")).filter("place != ''").distinct()


def located(items: DataFrame, places_: DataFrame) -> DataFrame:
    """``items`` with lat and lon of their place, null where it is not known. ``places_``: (place, lat, lon)."""
    return items.withColumn("__place", normalise_location(F.col("location"))).join(places_.withColumnRenamed("place", "__place"), "__place", "left").drop("__place")


def unknown_places(items: DataFrame, places_: DataFrame) -> DataFrame:
    """Places still to be looked up; one that was looked up without a result is known too."""
    return places(items).join(places_.select("place"), "place", "left_anti")


def class_mix(items: DataFrame) -> DataFrame:
    """Items per main category and confidence, with the share in percent."""
    counts = items.groupBy(F.coalesce(F.substring_index("category", "/", 1), F.lit("-")).alias("main"), F.coalesce("category_conf", F.lit("-")).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("main", "confidence", "n", F.round(100.0 * F.col("n") / F.col("total"), 2).alias("percent"))


def top_houses(history: DataFrame, most: int = 14) -> DataFrame:
    return counts_by(history, "house").orderBy(F.desc("n"), "house").limit(most)
