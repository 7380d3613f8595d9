"""Helpers that all corpus operators share: reading tables, shared-folder tables, row keys.

Row identity. ``doc_id`` is normally unique, but rows may repeat or carry a null id. Operators that must bring a
decision back to its row join on ``row_key``: the id (null sorts after every id) plus a hash of id and text. Rows
equal in both always get equal decisions, so a join on the key never has to tell them apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: ``[\x20\x09-\x0D]``: the white space that separates words and is stripped from line ends.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id: sorts after every real one.
NO_ID = (1 << 63) - 1
#: Column names that operators add while they work; a caller's columns of these names are never touched.
ID, RK = "__id", "__rk"
#: Bits of a bitmap of row keys, and the names that probing it uses.
KEY_BITS = 1 << 23
BITMAP_BYTES = 4096  # of one of Spark's bitmaps
PROBE = ("__bucket", "__bit", "__bits")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read (``spark.checkpoint.dir``)."""
    folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def durable(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here, and a lost executor costs
    a re-read, not a re-computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """``df``, after bounding the rows that Python gets at a time: texts can be very long. Spark reads the option when
    a plan starts to run, so it stays set; every operator that hands texts to Python sets the same value."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def join_split(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner", share: int = 1000, floor: int = 1000) -> DataFrame:
    """``rows`` joined with ``lookup``, which has one row for each key and in ``weight`` how many of ``rows`` hold it.

    A key that holds more than one in ``share`` of the rows would make one task of the shuffle long. There are fewer
    than ``share`` such keys whatever the input, so their look-up rows are broadcast and only the others are shuffled.
    Without such a key it is the plain join.
    """
    most, total = lookup.agg(F.max(weight), F.sum(weight)).first()
    limit = max(floor, (total or 0) // share)
    if most is None or most <= limit:
        return rows.join(lookup.drop(weight), keys, how)
    rows = durable(rows, "split")  # read by both branches
    values = [c for c in lookup.columns if c not in (*keys, weight)]
    hot = lookup.filter(F.col(weight) > limit).select(*keys, F.struct(*values).alias("__hot"))
    marked = rows.join(F.broadcast(hot), keys, "left")
    warm = marked.filter(F.col("__hot").isNotNull()).select(*rows.columns, *[F.col("__hot")[v].alias(v) for v in values])
    cold = marked.filter(F.col("__hot").isNull()).drop("__hot").join(lookup.filter(F.col(weight) <= limit).drop(weight), keys, how)
    return warm.union(cold.select(*warm.columns))


def key_bitmap(keys: DataFrame) -> DataFrame:
    """A bitmap of the row keys (``__id``, ``__rk``) by their hashes: ``KEY_BITS`` bits, one megabyte, however many
    keys there are, so it may be broadcast. With very many keys it tells little, but never anything wrong."""
    place = _place()
    found = keys.select(F.bitmap_bucket_number(place).alias("__bucket"), F.bitmap_bit_position(place).alias("__bit"))
    found = found.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    width = 8 * BITMAP_BYTES
    every = keys.sparkSession.range(1, max(KEY_BITS // width, 1) + 1, 1, 1).withColumnRenamed("id", "__bucket")
    return durable(every.join(found, "__bucket", "left").withColumn("__bits", F.coalesce("__bits", F.lit(bytes(BITMAP_BYTES)))), "bitmap")


def _place() -> Column:
    return F.pmod(F.xxhash64(F.lit(3), F.col(ID), F.col(RK)), F.lit(KEY_BITS)) + 1


def maybe_among(rows: DataFrame, bitmap: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keyed ``rows`` apart: those whose key may be in the bitmap, and those whose key surely is not, which need no
    shuffle to meet anything."""
    byte = F.expr("CAST(conv(hex(substring(__bits, CAST(__bit DIV 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    marked = rows.withColumns({"__bucket": F.bitmap_bucket_number(_place()), "__bit": F.bitmap_bit_position(_place())}).join(F.broadcast(bitmap), "__bucket", "left")
    held = F.coalesce(F.call_function("shiftright", byte, (F.col("__bit") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    keep = [F.col(f"`{c}`") for c in rows.columns]
    return marked.filter(held).select(*keep), marked.filter(~held).select(*keep)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_id(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(id_col), F.lit(NO_ID))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(row_id(id_col), F.coalesce(F.col(text_col), F.lit("")))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.withColumns({ID: row_id(id_col), RK: row_key(id_col, text_col)})


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with a caller's columns of these names under others, and what gives a result of the same columns their
    own names back. Names that Spark takes for equal count as equal."""
    taken, used = {n.lower() for n in names}, {c.lower() for c in docs.columns}
    other: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in taken:
            new = next(x for k in range(len(used) + 1) if (x := f"caller_{k}") not in used)
            used.add(new)
            other[c] = new
    return docs.withColumnsRenamed(other), lambda done: done.withColumnsRenamed({new: c for c, new in other.items()})


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def per_batch(fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]):
    """A function for mapInArrow from one over a single batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return run


def with_columns(batch: pa.RecordBatch, drop: Iterable[str] = (), **new: pa.Array) -> pa.RecordBatch:
    drop = set(drop)
    names = [n for n in batch.schema.names if n not in drop and n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def numbered(rows: DataFrame, group: str, order: list[Column], place: str = "place") -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2 ... in ``order`` among the rows of a ``group`` (an int column of few values).

    Rows are range-partitioned by group and order, so a group that holds everything still runs over all tasks; each
    partition counts on its own, and the counts of earlier partitions (groups times partitions, which the driver adds
    up) are put on top. The result is written once: a range partitioning samples its input.
    """
    spark, names = rows.sparkSession, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            values = batch.column(group).to_numpy(zero_copy_only=False)
            local = np.empty(len(values), np.int64)
            for g in np.unique(values).tolist():
                at = np.nonzero(values == g)[0]
                local[at] = seen.get(g, 0) + np.arange(len(at))
                seen[g] = seen.get(g, 0) + len(at)
            yield with_columns(batch, __part=pa.array(np.full(len(values), part, np.int32)), __local=pa.array(local))

    keys = [F.col(group), *order]
    ranged = rows.repartitionByRange(shuffle_width(spark), *keys).sortWithinPartitions(*keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = durable(ranged.mapInArrow(run, f"{kinds}, __part int, __local long"), "numbered")
    offsets, before, last = [], 0, None
    for r in local.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("n")).orderBy(group, "__part").collect():
        before = before if r[group] == last else 0
        offsets.append((r[group], r["__part"], before))
        before, last = before + r.n, r[group]
    offset = spark.createDataFrame(offsets, f"`{group}` int, __part int, __before long")
    return local.join(F.broadcast(offset), [group, "__part"]).select(*[f"`{c}`" for c in names], (F.col("__before") + F.col("__local")).alias(place))
