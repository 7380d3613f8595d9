"""Work queues and plans for scans: quotas, anti-joins, tiers, capped partitions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stable import pinned


def quota_union(first: DataFrame, second: DataFrame, order: list[Column], size: int, share: float = 0.7) -> DataFrame:
    """``size`` rows: a share of the first branch, the rest of the second, each by its order."""
    n = round(size * share)
    return first.orderBy(*order).limit(n).unionByName(second.orderBy(*order).limit(size - n))


def poll_tiers(items: DataFrame, as_of: Column, tiers: tuple[tuple[int, int], ...] = ((1, 10), (5, 60), (15, 180)), stale_minutes: int = 20, limit: int = 500) -> DataFrame:
    """Active items due for a poll: within the first m minutes before their end and unseen for s seconds, for the first
    (m, s) that holds; items long past their end are left to finalisation."""
    seen = F.col("last_seen")
    due = None
    for minutes, seconds in tiers:
        tier = (F.col("ends_at") <= as_of + F.expr(f"INTERVAL {minutes} MINUTES")) & (seen <= as_of - F.expr(f"INTERVAL {seconds} SECONDS"))
        due = tier if due is None else due | tier
    rows = items.filter(F.col("status") == "active").filter(F.col("ends_at") >= as_of - F.expr(f"INTERVAL {stale_minutes} MINUTES")).filter(due)
    return rows.orderBy("ends_at", "house", "external_id").limit(limit)


def estimates_due(items: DataFrame, as_of: Column, hours: int = 18, limit: int = 200) -> DataFrame:
    """Active lots to estimate: those never estimated first, then those whose estimate is too old, by their ends."""
    old = F.col("est_at").isNull() | (F.col("est_at") < as_of - F.expr(f"INTERVAL {hours} HOURS"))
    rows = items.filter(F.col("status") == "active").filter(old)
    return rows.orderBy(F.col("est_at").isNull().desc(), F.col("ends_at").asc_nulls_last(), "house", "external_id").limit(limit)


def sharp(url: str) -> Column:
    """Not one of the small sizes."""
    return ~F.col(url).rlike(r"_mid\.")


def reading_queue(items: DataFrame, images: DataFrame, mains: tuple[str, ...], limit: int) -> DataFrame:
    """Active lots whose picture was not read yet, those of the given main categories first. ``images``: (house,
    external_id, url, sort); small sizes do not count, and lots without a picture are left out before the limit."""
    best = images.filter(sharp("url")).groupBy("house", "external_id").agg(F.min_by("url", F.struct(F.coalesce("sort", F.lit(1 << 30)), "url")).alias("image"))
    rows = items.filter((F.col("status") == "active") & F.col("ocr_text").isNull()).join(best, ["house", "external_id"])
    first = F.coalesce(F.substring_index("category", "/", 1).isin(*mains), F.lit(False))
    return rows.orderBy(first.desc(), F.col("ends_at").asc_nulls_last(), "house", "external_id").limit(limit)


def classification_queue(items: DataFrame, images: DataFrame, tried: DataFrame, rank: Column, limit: int) -> DataFrame:
    """Active lots without a picture and without a sure category that were not tried yet: conflicts first, then the
    least sure, then by their ends."""
    rows = items.filter((F.col("status") == "active") & F.col("title").isNotNull())
    rows = rows.filter(F.col("category_conf").isNull() | ~F.col("category_conf").isin("llm", "learned", "human"))
    for seen in (tried, images):
        rows = rows.join(seen.select("house", "external_id").distinct(), ["house", "external_id"], "left_anti")
    return rows.orderBy(F.col("category_conflict").desc(), rank, F.col("ends_at").asc_nulls_last(), "house", "external_id").limit(limit)


def reclassify_queue(items: DataFrame, tried: DataFrame, limit: int) -> DataFrame:
    """Lots that are over, have a title and were not classified by a service yet, the latest first."""
    rows = items.filter((F.col("status") != "active") & F.col("title").isNotNull() & ~F.col("category_conf").eqNullSafe("llm"))
    rows = rows.join(tried.select("house", "external_id").distinct(), ["house", "external_id"], "left_anti")
    return rows.orderBy(F.col("ends_at").desc_nulls_last(), "house", "external_id").limit(limit)


def some_of_first(rows: DataFrame, order: list[Column], first: int, take: int, seed: int, key: list[str]) -> DataFrame:
    """``take`` of the ``first`` rows by an order, drawn by a hash of seed and key, so that a task that runs again draws
    the same; the cut is the feature's own."""
    drawn = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(k).cast("string") for k in key]), 256)
    return rows.orderBy(*order).limit(first).orderBy(drawn, *key).limit(take)


def pending_images(images: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Pictures of active lots that have no copy yet, in the order of their numbers."""
    active = items.filter(F.col("status") == "active").select("house", "external_id").distinct()
    return images.filter(F.col("local_path").isNull()).join(active, ["house", "external_id"], "left_semi").orderBy("image_id").limit(limit)


#: Halvings of a range that one pass over its rows stands for, at most.
LEVELS = 12


def _halved(value: Column, times: Column) -> Column:
    """Struct (low, high): the part of the range from ``low`` to ``high`` that a value lies in after some halvings."""

    def half(r: Column, _: Column) -> Column:
        low, high = r["low"], r["high"]
        mid = low + F.shiftright(high - low, 1)
        pair = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
        return F.when(low >= high, r).when(value <= mid, pair(low, mid)).otherwise(pair(mid + 1, high))

    steps = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(F.col("low").alias("low"), F.col("high").alias("high")), half)


def capped_ranges(rows: DataFrame, bucket: str, value: str, cap: int) -> DataFrame:
    """(bucket, low, high, n, over_cap): value ranges of each bucket by repeated halving of its span while a range holds
    more than ``cap`` rows and more than one value; a single value over the cap is marked. Values are whole numbers. A
    pass counts the rows of all parts some halvings below the open ranges, as many as their counts call for, adds these
    up to every range between, and leaves only rows of parts over the cap to the next one. Rows meet their range by
    equality, so no bucket is one task's work."""
    spans = pinned(rows.groupBy(F.col(bucket).alias("b")).agg(F.min(value).cast("long").alias("low"), F.max(value).cast("long").alias("high"), F.count(F.lit(1)).alias("n")))
    fits = (F.col("n") <= cap) | F.coalesce(F.col("low") >= F.col("high"), F.lit(True))
    leaves = spans.filter(fits)

    def deeper(found: DataFrame) -> DataFrame:
        levels = F.least(F.ceil(F.log2(F.col("n") / cap)).cast("int") + 2, F.lit(LEVELS))
        return found.filter(~fits).select(F.col("b").alias("o_b"), F.col("low").alias("o_low"), F.col("high").alias("o_high"), levels.alias("levels"))

    wide = deeper(spans)
    inside = rows.select(F.col(bucket).alias("b"), F.col(value).cast("long").alias("v")).filter("v IS NOT NULL").join(F.broadcast(wide), F.col("b").eqNullSafe(F.col("o_b")))
    inside = inside.select("b", "v", F.col("o_low").alias("low"), F.col("o_high").alias("high"), "levels")
    while not wide.isEmpty():
        placed = inside.select("b", "v", "low", "high", "levels", F.inline(F.array(_halved(F.col("v"), F.col("levels")))).alias("at", "to"))
        cells = placed.groupBy("b", "low", "high", "levels", "at").agg(F.count(F.lit(1)).alias("n"))
        deep = cells.withColumn("d", F.explode(F.sequence(F.lit(1), F.col("levels"))))
        pairs = deep.select("b", "d", "n", (F.col("d") == F.col("levels")).alias("last"), _halved(F.col("at"), F.col("d")).alias("r"), _halved(F.col("at"), F.col("d") - 1).alias("above"))
        pairs = pairs.filter(F.col("above.low") < F.col("above.high"))
        nodes = pinned(pairs.groupBy("b", "d", "last", F.col("r.low").alias("low"), F.col("r.high").alias("high"), F.col("above.low").alias("p_low"), F.col("above.high").alias("p_high")).agg(F.sum("n").alias("n")))
        parents = nodes.select(F.col("b").alias("a_b"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), F.col("n").alias("a_n"))
        known = nodes.join(parents, F.col("b").eqNullSafe(F.col("a_b")) & (F.col("p_low") == F.col("a_low")) & (F.col("p_high") == F.col("a_high")), "left")
        leaves = leaves.unionByName(known.filter(fits & ((F.col("d") == 1) | (F.col("a_n") > cap))).select("b", "low", "high", "n"))
        wide = deeper(nodes.filter("last"))
        still = placed.select("b", "v", F.col("at").alias("low"), F.col("to").alias("high"))
        met = F.col("b").eqNullSafe(F.col("o_b")) & (F.col("low") == F.col("o_low")) & (F.col("high") == F.col("o_high"))
        inside = pinned(still.join(wide, met).select("b", "v", "low", "high", "levels"))
    return leaves.select(F.col("b").alias(bucket), "low", "high", "n", (F.col("n") > cap).alias("over_cap"))


def numbered_pages(rows: DataFrame, key: str, size: int) -> DataFrame:
    """``rows`` with ``page``, ``size`` rows each in key order. Places come from a range partitioning and the counts of
    earlier partitions, so that no task sees more than its range; the key must be unique."""
    part = pinned(rows.repartitionByRange(F.col(key)).withColumn("__p", F.spark_partition_id()))
    counts = part.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    local = F.row_number().over(Window.partitionBy("__p").orderBy(key))
    placed = part.withColumn("__r", local).join(F.broadcast(before), "__p")
    return placed.withColumn("page", F.floor((F.col("__before") + F.col("__r") - 1) / size)).drop("__p", "__r", "__before")
