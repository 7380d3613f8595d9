"""Saved searches and watches: rule matching, transition events, a sink that notifies once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import keyed

PER_SEARCH = 30
SOON_MINUTES = 65


def match_searches(items: DataFrame, searches: list[tuple[str, Column]], since: Column, upto: Column, first_seen: str = "first_seen", limit: int | None = PER_SEARCH) -> DataFrame:
    """(search, item columns) for items first seen in the half-open window; each search is one predicate, and a row
    carries the array of those it meets, so the items are read once however many searches there are."""
    fresh = items.filter((F.col(first_seen) > since) & (F.col(first_seen) <= upto))
    hit = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in searches]))
    rows = fresh.select("*", F.explode(hit).alias("search"))
    if limit is None:
        return rows
    order = Window.partitionBy("search").orderBy(F.desc(first_seen), "house", "external_id")
    return rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= limit).drop("__r")


def new_watches(asked: DataFrame, items: DataFrame) -> DataFrame:
    """(house, external_id, notified_reserve, notified_ended) of new watches. What is so already gives no news later;
    nothing is so for a lot that is not known."""
    now = items.select("house", "external_id", (F.col("reserve_status") == "met").alias("r"), (F.col("status") == "ended").alias("e"))
    rows = asked.select("house", "external_id").distinct().join(now, ["house", "external_id"], "left")
    return rows.select("house", "external_id", F.coalesce("r", F.lit(False)).alias("notified_reserve"), F.coalesce("e", F.lit(False)).alias("notified_ended"))


def watched_first() -> list[Column]:
    """The order of watched lots: what is over comes last, then by the end."""
    return [F.coalesce(F.col("status") == "ended", F.lit(False)), F.col("ends_at").asc_nulls_last(), F.col("house"), F.col("external_id")]


def transitions(before: DataFrame, after: DataFrame, as_of: Column, key: list[str], soon: int = SOON_MINUTES) -> DataFrame:
    """(key, event, dedup_key) for what became true: ending_soon, reserve_met, ended. A key that ``before`` lacks starts
    with its present state and gives no event."""
    near = lambda p: (F.col(p + "status") == "active") & (F.col(p + "ends_at") > as_of) & (F.col(p + "ends_at") <= as_of + F.expr(f"INTERVAL {soon} MINUTES"))
    flags = {"ending_soon": (near, True), "reserve_met": (lambda p: F.col(p + "reserve_status") == "met", False), "ended": (lambda p: F.col(p + "status") == "ended", False)}
    b = before.select(*key, *[F.col(c).alias("b_" + c) for c in ("status", "reserve_status", "ends_at", "soon_sent")])
    a = after.select(*key, *[F.col(c).alias("a_" + c) for c in ("status", "reserve_status", "ends_at")])
    told = []
    for name, (flag, once) in flags.items():
        was = F.col("b_soon_sent") if once else flag("b_")
        told.append(F.when(F.coalesce(flag("a_"), F.lit(False)) & ~F.coalesce(was, F.lit(False)), F.lit(name)))
    rows = a.join(b, key).select(*key, F.explode(F.array_compact(F.array(*told))).alias("event"))
    return rows.withColumn("dedup_key", F.concat_ws(":", *key, "event"))


def unsent(batch: DataFrame, sent: DataFrame, key: str = "dedup_key") -> DataFrame:
    """Rows of a batch whose key was never sent, one for each key."""
    return batch.dropDuplicates([key]).join(sent.select(key), key, "left_anti")


def first_only(news: DataFrame, key: str = "dedup_key") -> DataFrame:
    """A stream of news with one row for each key ever. Keys lie in the stream's state, spread by hash, so a batch costs
    a look-up for each of its own rows however many keys were sent before; a restart goes on from the state, and a sink
    that commits batches (a file sink) then repeats nothing. Rows without a key are dropped. Needs the state store of
    ``keyed.with_state_store``, which keeps old keys on disk."""
    keyed.with_state_store(news.sparkSession)
    return news.filter(F.col(key).isNotNull()).dropDuplicates([key])


def notify_once(spark: SparkSession, path: str, schema: str, key: str = "dedup_key"):
    """A foreachBatch function that appends only unsent rows to the Parquet folder ``path``. A batch writes its own
    subfolder and overwrites it when it is replayed, so that a restart neither loses nor repeats a row. It looks keys up
    among all rows in ``path``, also those of other streams; where one stream sends all, ``first_only`` costs less."""

    def write(batch: DataFrame, batch_id: int) -> None:
        session, kinds = batch.sparkSession, f"{schema}, batch long"
        sent = session.read.schema(kinds).parquet(path) if _exists(session, path) else session.createDataFrame([], kinds)
        fresh = unsent(batch, sent.filter(F.col("batch") != batch_id), key)
        fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
