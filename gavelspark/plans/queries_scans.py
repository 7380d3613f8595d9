"""Queries over sources that are scanned whole: plans made by a search's own totals, resumed sweeps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stable import shared_path
from ..sources import cursors, sliced
from .adapt import ITEMS_SQL, items, table
from .registry import query

_SCANNED = "house string, external_id string, category string, location string, flag string, price long"


def recorded_items(spark: SparkSession, sf_dir: str, page: int = 100) -> sliced.Recorded:
    """The items as a service would show them: written once by category, a search sees no more than its ceiling."""
    path = shared_path(spark, "recorded")
    rows = items(spark, sf_dir).select("house", "external_id", F.substring_index("category", "/", 1).alias("main"), "category", "location", "flag", F.when(F.col("bid_count") % 9 > 0, F.col("current_bid")).alias("price"))
    rows.repartitionByRange("category", "price").sortWithinPartitions("category", "price").write.option("parquet.block.size", str(1 << 20)).parquet(path)
    return sliced.Recorded(path, "external_id", page)


@query("capped_scan", f"WITH {ITEMS_SQL} SELECT house, external_id, category, location, flag, CASE WHEN bid_count % 9 > 0 THEN current_bid END AS price FROM items")
def capped_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a source whose searches show 500 rows at most, by a plan that only knows the searches' totals."""
    search, name = recorded_items(spark, sf_dir), f"scan_{uuid.uuid4().hex}"
    known = spark.read.parquet(search.path).select(F.collect_set("location"), F.collect_set("flag")).first()  # facet values, as a service lists them
    facets = {"location": sorted(known[0]), "flag": sorted(known[1])}
    sliced.register_sliced(spark, name, _SCANNED, search, facets, planned=sliced.spread_plan(spark, search, facets))
    return spark.read.format(name).load()


def swept(spark: SparkSession, sf_dir: str, by_place: bool, rounds: int = 2, limit: int = 400) -> DataFrame:
    """The customers as a sweep reads them, page by page, over some rounds."""
    path, sink, state = (shared_path(spark, tag) for tag in ("recorded", "sink", "state"))
    table(spark, sf_dir, "customer").select("c_custkey", "c_name").write.parquet(path)
    name = f"sweep_{uuid.uuid4().hex}"
    limit = max(limit, spark.read.parquet(path).count() // 12)  # as many pages at any size
    fetch = cursors.RecordedRows(path, "c_custkey", by_place)
    cursors.register_cursor(spark, name, "c_custkey long, c_name string", cursors.Cursor(fetch, limit, None if by_place else "c_custkey", rounds))
    stream = spark.readStream.format(name).load().writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).start()
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.parquet(sink)


_SWEPT = "SELECT c_custkey, c_name, sweep, false AS mark FROM customer, (VALUES (0::BIGINT), (1::BIGINT)) AS s(sweep) UNION ALL SELECT NULL, NULL, sweep, true FROM (VALUES (0::BIGINT), (1::BIGINT)) AS s(sweep)"


@query("keyset_sweep", _SWEPT)
def keyset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir, False)


@query("offset_sweep", _SWEPT)
def offset_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swept(spark, sf_dir, True)
