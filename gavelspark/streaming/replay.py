"""Replaying a table as a stream: in batches by time, through a sink in the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.stable import shared_path


def in_batches(rows: DataFrame, time: str, batches: int, files: int = 2) -> str:
    """A folder with ``rows`` in the order of ``time``: each of ``batches`` equal spans is ``files`` files, written one
    span after another."""
    path = shared_path(rows.sparkSession, "replay")
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    width = ((high or 0) - (low or 0)) // batches + 1
    for k in range(batches):
        span = rows.filter(F.floor((micros - (low or 0)) / width) == k)
        span.repartition(files).write.mode("append").parquet(path)
    return path


def run_over(spark: SparkSession, source: str, schema: str, make: Callable[[DataFrame], DataFrame], sink: str, state: str, files: int = 2) -> None:
    """Runs ``make`` over what ``source`` has and the checkpoint ``state`` does not know yet, ``files`` files a batch;
    the rows go to ``sink``. Started again after a stop or a crash it goes on where it was."""
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source))
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def replayed(rows: DataFrame, time: str, make: Callable[[DataFrame], DataFrame], batches: int = 3) -> DataFrame:
    """The result of ``make`` over ``rows`` as a stream of ``batches``."""
    spark = rows.sparkSession
    source, sink = in_batches(rows, time, batches), shared_path(spark, "sink")
    run_over(spark, source, rows.schema, make, sink, shared_path(spark, "state"))
    return spark.read.parquet(sink)
