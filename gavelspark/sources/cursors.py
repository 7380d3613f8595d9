"""Sweeps with a cursor as stream sources: by key (rows after the last one) or by place (rows from an offset on).

The cursor is the stream's offset, so Spark's checkpoint keeps it: a sweep that was stopped or killed goes on behind the
last batch that was committed, and a batch that was not is asked for again. A page that is not full ends a round. The
reader then gives a row with ``mark`` true, which is what ends unseen rows in ``streaming.keyed.stale_sweep``, and
starts anew from the beginning; after ``rounds`` rounds it is done and stays so over restarts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

#: ``fetch(cursor, limit)``: records behind a key (None: from the first) in the order of keys, or from a place on.
Fetch = Callable[[object, int], list[dict]]


@dataclass(frozen=True)
class Cursor:
    """How a sweep moves: by ``key``, or by place where there is none."""

    fetch: Fetch
    limit: int
    key: str | None = None
    rounds: int | None = None

    def start(self) -> dict:
        return {"sweep": 0, "at": None if self.key else 0, "done": self.rounds == 0}

    def step(self, offset: dict) -> tuple[list[tuple[dict, bool]], dict]:
        """(records, mark) of the next page, and the offset behind it."""
        if offset["done"]:
            return [], offset
        records = self.fetch(offset["at"], self.limit)
        out = [(r, False) for r in records]
        if len(records) == self.limit:
            return out, offset | {"at": records[-1][self.key] if self.key else offset["at"] + self.limit}
        sweep = offset["sweep"] + 1
        return [*out, ({}, True)], self.start() | {"sweep": sweep, "done": sweep == self.rounds}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, cursor: Cursor, names: list[str]) -> None:
        self.cursor, self.names = cursor, names

    def initialOffset(self) -> dict:
        return self.cursor.start()

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self.cursor.step(start)
        return iter([(*(r.get(n) for n in self.names), start["sweep"], mark) for r, mark in rows]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            rows, start = self.read(start)
            yield from rows


def register_cursor(spark: SparkSession, name: str, schema: str, cursor: Cursor) -> None:
    """Registers format ``name`` for spark.readStream: the columns of ``schema``, then ``sweep`` and ``mark``."""
    names = StructType.fromDDL(schema).names

    class Swept(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return f"{schema}, sweep long, mark boolean"

        def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
            return _Reader(cursor, names)

    spark.dataSource.register(Swept)


@dataclass(frozen=True)
class RecordedRows:
    """A recorded service over a Parquet folder: rows by ``key``, or by their place in its order."""

    path: str
    key: str
    by_place: bool = False

    def __call__(self, cursor, limit: int) -> list[dict]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds
        import pyarrow.fs as pf

        system, path = pf.FileSystem.from_uri(self.path) if ":" in self.path else (pf.LocalFileSystem(), self.path)
        behind = None if self.by_place or cursor is None else pc.field(self.key) > cursor
        found = ds.dataset(path, filesystem=system, format="parquet").to_table(filter=behind)
        places = pc.sort_indices(found, [(self.key, "ascending")])
        return found.take(places.slice(cursor if self.by_place else 0, limit)).to_pylist()
