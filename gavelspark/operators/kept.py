"""Tables that are kept between runs and change by small batches.

Rows lie in buckets by a hash of their key; what a batch touches is found by its keys' buckets, and only those buckets
are read, merged and written anew. A version is a small manifest that names, for each bucket, the folders that make it
up; it is created only if no one else made that version, so two writers cannot both win, and readers of an older
version keep its files until ``vacuum``. Small batches may also be logged first and settled later, many at a time.

    data/<generation>/__bucket=<b>/part-*.parquet    rows, written once, never changed
    versions/<n>.json                                key, schema, bucket -> generations, logged generations
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .stable import pinned

BUCKETS = 64
BUCKET = "__bucket"
#: Bytes of buckets that one step of a merge rewrites.
STEP = 1 << 29
#: Shuffle files of a write go when it is done, not when the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: ``fn(current, batch)``: the next rows of the buckets that the batch touches.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer made this version first; read the table again and repeat the change."""


@dataclass(frozen=True)
class Version:
    number: int
    key: list[str]
    buckets: int
    schema: str
    parts: dict[int, list[str]] = field(default_factory=dict)
    #: Logged batches in order: (generation, buckets it touches).
    log: list[tuple[str, list[int]]] = field(default_factory=list)


class KeptTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    @classmethod
    def create(cls, path: str, rows: DataFrame, key: list[str], buckets: int = BUCKETS, steps: int = 1) -> KeptTable:
        """A table of ``rows``, which must come out the same if they are asked for once a step: each step writes its
        share of the buckets, so that what is shuffled lies on disk a share at a time."""
        table, parts = cls(rows.sparkSession, path), {}
        empty = Version(0, key, buckets, rows.schema.json())
        for i in range(steps):
            parts |= table._write(empty, rows if steps == 1 else rows.filter(table._bucket(empty) % steps == i))
        table._commit(empty, replace(empty, number=1, parts=parts))
        return table

    # versions

    def versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        known = self.versions()
        for n in reversed(known) if number is None else [number]:
            text = self._read(f"{self.path}/versions/{n:010}.json")
            if text.endswith("\n"):  # a writer that died here left no version
                v = json.loads(text)
                return Version(v["number"], v["key"], v["buckets"], v["schema"], {int(b): g for b, g in v["parts"].items()}, [tuple(x) for x in v["log"]])
        raise FileNotFoundError(f"no version of {self.path}")

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._hadoop.Path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _commit(self, old: Version, new: Version) -> None:
        path = self._hadoop.Path(f"{self.path}/versions/{new.number:010}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as taken:
            if self._fs.exists(path):
                raise Conflict(f"version {new.number} of {self.path} exists") from taken
            raise
        stream.write((json.dumps(new.__dict__) + "\n").encode())
        stream.close()

    # rows

    def _bucket(self, v: Version) -> Column:
        kinds = {f.name: f.dataType for f in StructType.fromJson(json.loads(v.schema)).fields}
        return F.pmod(F.xxhash64(*[F.col(k).cast(kinds[k]) for k in v.key]), F.lit(v.buckets)).cast("int")

    def _write(self, v: Version, rows: DataFrame, spread: int = 1) -> dict[int, list[str]]:
        """Buckets of ``rows`` -> the new generation that holds them."""
        generation = uuid.uuid4().hex
        names = StructType.fromJson(json.loads(v.schema)).names
        marked = rows.select(*names, self._bucket(v).alias(BUCKET))
        salt = F.pmod(F.xxhash64(*names[:1], F.monotonically_increasing_id()), F.lit(spread))
        marked = marked.repartition(F.col(BUCKET)) if spread == 1 else marked.repartition(F.col(BUCKET), salt)
        folder = f"{self.path}/data/{generation}"
        self._set_down(marked, folder, BUCKET)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(folder))]
        return {int(n.split("=")[1]): [generation] for n in found if n.startswith(BUCKET)}

    def _set_down(self, rows: DataFrame, folder: str, *by: str) -> None:
        before = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            rows.write.partitionBy(*by).parquet(folder)
        finally:
            self.spark.conf.unset(_CLEAN) if before is None else self.spark.conf.set(_CLEAN, before)

    def _steps(self, v: Version, buckets: list[int]) -> list[list[int]]:
        """Buckets that are rewritten together, by the bytes of their files."""
        steps, room = [], 0
        for b in sorted(buckets):
            size = sum(self._fs.getContentSummary(self._hadoop.Path(f"{self.path}/data/{g}/{BUCKET}={b}")).getLength() for g in v.parts.get(b, []))
            if not steps or size > room:
                steps.append([])
                room = STEP
            steps[-1].append(b)
            room -= size
        return steps

    def _rows(self, v: Version, parts: dict[int, list[str]]) -> DataFrame:
        paths = [f"{self.path}/data/{g}/{BUCKET}={b}" for b, gs in parts.items() for g in gs]
        schema = StructType.fromJson(json.loads(v.schema))
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, keys: DataFrame | None = None, settle: Merge | None = None) -> DataFrame:
        """The rows of a version, by default the last; with ``keys`` only the buckets that hold them; with ``settle``
        the logged batches are merged on the way."""
        v = self.version(version)
        wanted = set(v.parts) if keys is None else set(self._touched(v, keys))
        if settle is None or not v.log:
            return self._rows(v, {b: g for b, g in v.parts.items() if b in wanted})
        logged = {b for _, bs in v.log for b in bs}
        if keys is None:
            wanted |= logged
        plain = self._rows(v, {b: g for b, g in v.parts.items() if b in wanted - logged})
        return plain.unionByName(self._settled(v, wanted & logged, settle))

    def _settled(self, v: Version, buckets: set[int], merge: Merge) -> DataFrame:
        rows = self._rows(v, {b: g for b, g in v.parts.items() if b in buckets})
        for generation, held in v.log:
            rows = merge(rows, self._rows(v, {b: [generation] for b in held if b in buckets})).select(*rows.columns)
        return rows

    def _touched(self, v: Version, keys: DataFrame) -> list[int]:
        """Buckets of some keys, at most ``buckets`` numbers."""
        return [r[0] for r in keys.select(self._bucket(v).alias(BUCKET)).distinct().collect()]

    # changes

    def merge(self, batch: DataFrame, fn: Merge) -> Version:
        """The next version: ``fn`` over the buckets that the batch touches; other buckets keep their files. ``fn`` may
        add and drop rows, but only with keys of the batch's buckets. It is asked of a step of buckets at a time if they
        are large, with the batch's rows of them, so it must not look across keys."""
        v, folder = self.version(), f"{self.path}/batch-{uuid.uuid4().hex}"
        if any(kind == "void" for _, kind in batch.dtypes):
            batch = pinned(batch)
        else:  # smaller than a checkpoint, and gone when it is merged
            self._set_down(batch, folder)
            batch = self.spark.read.schema(batch.schema).parquet(folder)
        touched = self._touched(v, batch)
        steps, written = self._steps(v, touched) or [[]], {}
        for step in steps:
            own = batch if len(steps) == 1 else batch.filter(self._bucket(v).isin(step))
            new = self._write(v, fn(self._rows(v, {b: g for b, g in v.parts.items() if b in step}), own))
            if strange := set(new) - set(step):
                raise ValueError(f"rows of buckets that the batch does not touch: {sorted(strange)[:5]}")
            written |= new
        kept = {b: g for b, g in v.parts.items() if b not in touched}
        done = self._next(v, parts=kept | written)
        self._fs.delete(self._hadoop.Path(folder), True)
        return done

    def append(self, rows: DataFrame, spread: int = 1) -> Version:
        """The next version with more rows; ``spread`` files for a bucket whose key may be hot."""
        v = self.version()
        written = self._write(v, rows, spread)
        return self._next(v, parts={b: [*v.parts.get(b, []), *written.get(b, [])] for b in {*v.parts, *written}})

    def log(self, batch: DataFrame) -> Version:
        """The next version with a batch that is written down but not merged. It must have the table's columns."""
        v = self.version()
        written = self._write(v, batch)
        generation = next(iter(written.values()))[0] if written else None
        return self._next(v, log=[*v.log, (generation, sorted(written))] if generation else v.log)

    def settle(self, fn: Merge) -> Version:
        """Merges all logged batches, in their order, in one rewrite of the buckets that they touch."""
        v = self.version()
        logged = {b for _, bs in v.log for b in bs}
        written = self._write(v, self._settled(v, logged, fn))
        return self._next(v, parts={b: g for b, g in v.parts.items() if b not in logged} | written, log=[])

    def compact(self, most: int = 4) -> Version:
        """Buckets of more than ``most`` generations become one again."""
        v = self.version()
        many = {b: g for b, g in v.parts.items() if len(g) > most}
        written = self._write(v, self._rows(v, many)) if many else {}
        return self._next(v, parts={b: g for b, g in v.parts.items() if b not in many} | written)

    def _next(self, v: Version, **changes) -> Version:
        new = replace(v, number=v.number + 1, **changes)
        self._commit(v, new)
        return new

    def vacuum(self, keep: int = 2) -> int:
        """Drops the files that none of the last ``keep`` versions names, and older manifests; returns how many
        generations went."""
        numbers = self.versions()
        used = {g for n in numbers[-keep:] for v in [self.version(n)] for g in [*[g for gs in v.parts.values() for g in gs], *[g for g, _ in v.log]]}
        gone = [s.getPath() for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data")) if s.getPath().getName() not in used]
        for path in gone:
            self._fs.delete(path, True)
        for n in numbers[:-keep]:
            self._fs.delete(self._hadoop.Path(f"{self.path}/versions/{n:010}.json"), False)
        return len(gone)

    def files(self, version: int | None = None) -> dict[int, list[str]]:
        """Files of each bucket."""
        v = self.version(version)
        list_ = lambda b, g: [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(f"{self.path}/data/{g}/{BUCKET}={b}"))]
        return {b: sorted(f"{g}/{n}" for g in gs for n in list_(b, g) if n.startswith("part-")) for b, gs in v.parts.items()}
