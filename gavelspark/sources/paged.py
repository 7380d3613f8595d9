"""Paged sources as Spark data sources: one input partition for each page of each shard, or a cursor for streams.

``fetch(shard, page)`` gives (records, number of pages); it must be picklable and is what talks to a service, a recording
or a test double. Records are dicts under the schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..operators.stable import pinned

Fetch = Callable[[str, int], tuple[list[dict], int]]


class Page(InputPartition):
    """One page of a shard; the first page carries its records, as it was fetched to learn how many there are."""

    def __init__(self, shard: str, page: int, records: list[dict] | None = None) -> None:
        super().__init__((shard, page))
        self.shard, self.page, self.records = shard, page, records


class _Pages(DataSourceReader):
    def __init__(self, fetch: Fetch, shards: list[str], names: list[str]) -> None:
        self.fetch, self.shards, self.names = fetch, shards, names

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(min(16, len(self.shards))) as pool:
            firsts = list(pool.map(lambda s: self.fetch(s, 1), self.shards))
        return [Page(s, p, records if p == 1 else None) for s, (records, pages) in zip(self.shards, firsts) for p in range(1, pages + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        records = self.fetch(partition.shard, partition.page)[0] if partition.records is None else partition.records
        for record in records:
            yield tuple(record.get(n) for n in self.names)


class _Sweep(SimpleDataSourceStreamReader):
    """One page a trigger, shard after shard, and round again; the offset counts sweeps so that it always grows."""

    def __init__(self, fetch: Fetch, shards: list[str], names: list[str]) -> None:
        self.fetch, self.shards, self.names = fetch, shards, names

    def initialOffset(self) -> dict:
        return {"sweep": 0, "shard": 0, "page": 1}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        records, pages = self.fetch(self.shards[start["shard"]], start["page"])
        at = dict(start)
        if at["page"] < pages:
            at["page"] += 1
        else:
            at["page"], at["shard"] = 1, (at["shard"] + 1) % len(self.shards)
            at["sweep"] += at["shard"] == 0
        return iter([tuple(r.get(n) for n in self.names) for r in records]), at

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = dict(start)
        while at != end:
            rows, at = self.read(at)
            yield from rows


def register_paged(spark: SparkSession, name: str, schema: str, fetch: Fetch, shards: list[str] | None = None) -> None:
    """Registers format ``name`` for spark.read and spark.readStream."""
    names, places = StructType.fromDDL(schema).names, shards or ["all"]

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Pages(fetch, places, names)

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return _Sweep(fetch, places, names)

    spark.dataSource.register(Paged)


def refetch(keys: DataFrame, key: str, schema: str, fetch: Callable[[list], list[dict]], size: int = 50) -> DataFrame:
    """The records of some keys, fetched anew in batches inside the tasks; ``fetch`` gives those that still exist."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [r for i in range(0, len(batch), size) for r in fetch(batch[key].iloc[i : i + size].tolist())]
            yield pd.DataFrame([[r.get(n) for n in names] for r in found], columns=names)

    return keys.select(key).distinct().mapInPandas(run, schema)


def probe_ids(spark: SparkSession, schema: str, fetch: Callable[[list], list[dict]], start: int, size: int = 50, wave: int = 20, empty: int = 2) -> DataFrame:
    """Records found by asking for ids from ``start`` on, ``wave`` batches of ``size`` at a time, until the last
    ``empty`` batches of a wave find nothing. Waves are written in the shared folder, so no id is asked for twice."""
    found = None
    while True:
        ids = spark.range(start, start + wave * size, 1, wave).withColumnRenamed("id", "__id")
        got = pinned(refetch_in_place(ids, schema, fetch, size))
        found = got if found is None else found.unionByName(got)
        tail = got.filter(F.col("__asked") >= start + (wave - empty) * size)
        if tail.isEmpty():
            return found.drop("__asked")
        start += wave * size


def refetch_in_place(ids: DataFrame, schema: str, fetch: Callable[[list], list[dict]], size: int) -> DataFrame:
    """``refetch`` for a range of ids, with the first id of the batch that found a record."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), size):
                asked = batch["__id"].iloc[i : i + size].tolist()
                yield pd.DataFrame([[*[r.get(n) for n in names], asked[0]] for r in fetch(asked)], columns=[*names, "__asked"])

    return ids.mapInPandas(run, f"{schema}, __asked long")


def hierarchy(spark: SparkSession, parts: str, items: str, bids: str, part_key: str, item_key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three registered sources that hang together: parts, the items of known parts, and the bids of known items."""
    p = spark.read.format(parts).load()
    i = spark.read.format(items).load().join(p.select(part_key).distinct(), part_key, "left_semi")
    b = spark.read.format(bids).load().join(i.select(item_key).distinct(), item_key, "left_semi")
    return p, i, b
