"""Importance resampling towards a target distribution, on hashed word n-grams.

Each task hands its texts in chunks to an in-process DuckDB: SQL unnests the words, windows make the n-grams, and a
registered function gives each distinct n-gram the CRC-32 of its bytes. Every row's bucket counts, and one row of
totals a partition, are spilled to Parquet in the shared folder. Spark merges the totals of corpus and target, whose
logarithmic ratio is a bucket's gain; a row's weight is the floored mean of its features' gains. A Gumbel variate
drawn from a hash of the id makes the highest scores a sample without replacement in proportion to the weights.

The scores are ranked by range partitions with the counts of earlier ones on top, so no task holds them all. Gains are
``BUCKETS`` numbers whatever the input; that is all a task gets besides its rows.

Edge cases: null and empty texts have no word, weight 0 and are never drawn; a row without an id draws by the empty id
and comes last among ties; equal rows count and draw apart; an empty corpus or target gives gains by the added ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, durable, numbered, per_batch, row_id, small_batches

GRAMS, BUCKETS, SEED, SHARE, MIN_WORDS = 1, 10_000, "2024", 10, 20
#: Characters of texts that DuckDB gets at a time; a longer text goes alone.
CHUNK = 1 << 22
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _grams(n: int) -> str:
    """SELECT of all runs of ``n`` words, by windows over the word positions."""
    ahead = ["word", *(f"lead(word, {k}) OVER o" for k in range(1, n))]
    return f"SELECT doc, gram FROM (SELECT doc, {' || chr(32) || '.join(ahead)} AS gram FROM words WINDOW o AS (PARTITION BY doc ORDER BY pos)) WHERE gram IS NOT NULL"


def counting_sql(grams: int) -> str:
    return f"""
    WITH lists AS (SELECT doc, regexp_extract_all(text, '{WORD}') AS list FROM texts),
    words AS (SELECT doc, unnest(list) AS word, generate_subscripts(list, 1) AS pos FROM lists),
    runs AS ({" UNION ALL ".join(_grams(n) for n in range(1, grams + 1))}),
    counted AS (SELECT doc, gram, count(*) AS n FROM runs GROUP BY doc, gram),
    hashed AS (SELECT gram, crc32_bytes(gram) AS crc FROM (SELECT DISTINCT gram FROM counted)),
    buckets AS (SELECT doc, crc % $buckets AS bucket, sum(n) AS n FROM counted JOIN hashed USING (gram) GROUP BY doc, bucket),
    listed AS (SELECT doc, sum(n)::BIGINT AS n_features, list(bucket::INTEGER ORDER BY bucket) AS buckets, list(n::BIGINT ORDER BY bucket) AS counts FROM buckets GROUP BY doc)
    SELECT len(l.list)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(buckets, []::INTEGER[]) AS buckets, coalesce(counts, []::BIGINT[]) AS counts
    FROM lists l LEFT JOIN listed USING (doc) ORDER BY doc
    """


class Counter:
    """One process's DuckDB."""

    def __init__(self) -> None:
        import duckdb

        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        crc = lambda grams: pa.array([zlib.crc32(g.encode()) for g in grams.to_pylist()], pa.int64())
        self.con.create_function("crc32_bytes", crc, ["VARCHAR"], "BIGINT", type="arrow")

    def count(self, texts: pa.Array, grams: int, buckets: int) -> pa.Table:
        """For each text its words, features, buckets and their counts."""
        self.con.register("texts", pa.table({"doc": pa.array(np.arange(len(texts), dtype=np.int32)), "text": texts}))
        got = self.con.execute(counting_sql(grams), {"buckets": buckets}).to_arrow_table()
        self.con.unregister("texts")
        return got.combine_chunks()


@lru_cache(maxsize=1)
def counter() -> Counter:
    return Counter()


def _spans(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends = pc.binary_length(texts).to_numpy().cumsum()
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, side="right")))
        yield first, last
        first = last


def bucket_counts(rows: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(id, total, n_words, n_features, buckets, counts) for each of (id, text); one more row a partition, with
    ``total`` true, sums up its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        kinds = {"id": pa.int64(), "total": pa.bool_(), "n_words": pa.int64(), "n_features": pa.int64(), "buckets": pa.list_(pa.int32()), "counts": pa.list_(pa.int64())}
        for batch in batches:
            texts = batch.column("text").cast(pa.string())
            for first, last in _spans(texts):
                met = counter().count(texts.slice(first, last - first), grams, buckets)
                at, n = (pc.list_flatten(met.column(c)).to_numpy() for c in ("buckets", "counts"))
                np.add.at(sums, at, n)
                columns = [batch.column("id").slice(first, last - first), pa.array([False] * len(met)), *(met.column(c).combine_chunks().cast(kinds[c]) for c in list(kinds)[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=list(kinds))
        at = np.flatnonzero(sums)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([None, True, 0, int(sums.sum()), at.tolist(), sums[at].tolist()], kinds.values())], names=list(kinds))

    return small_batches(rows).mapInArrow(run, "id long, total boolean, n_words long, n_features long, buckets array<int>, counts array<long>")


def merged(spilled: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all partitions."""
    sums = spilled.filter("total").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():  # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, with one added to each bucket."""
    size, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + size) / ((s + 1.0) * (all_t + size)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(id_col: str = "id", seed: str = SEED) -> Column:
    """A Gumbel variate in thousandths from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS, buckets: int = BUCKETS, share: int = SHARE, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """(id, n_features, weight, score, rank) per row of ``docs``; ``rank`` is 1, 2, 3 ... for the ``share`` per cent of
    the rows of ``min_words`` words or more that are drawn, best score first, and null for the others."""
    spark = docs.sparkSession
    lower = lambda df, i: df.select(i.alias("id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    corpus = durable(bucket_counts(lower(docs, F.col(id_col).cast("long")), grams, buckets), "corpus")
    wanted = durable(bucket_counts(lower(target, F.lit(None).cast("long")), grams, buckets), "target")
    known = spark.sparkContext.broadcast(gains(merged(corpus, buckets), merged(wanted, buckets)))

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("buckets")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        at, n = lists.values.to_numpy()[bounds[0] : bounds[-1]], batch.column("counts").values.to_numpy()[bounds[0] : bounds[-1]]
        sums = np.concatenate([[0], (known.value[at] * n).cumsum()])[bounds - bounds[0]]
        features = batch.column("n_features").to_numpy()
        weight = np.diff(sums) // np.maximum(features, 1)  # floors go down
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), batch.column("n_features"), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    rows = corpus.filter(~F.col("total")).mapInArrow(per_batch(weigh), "id long, n_words long, n_features long, weight long")
    scored = rows.withColumn("score", (F.col("weight") + noise("id", seed)).cast("long")).withColumn("eligible", (F.col("n_words") >= min_words).cast("int"))
    placed = numbered(scored, "eligible", [F.col("score").desc(), row_id("id")])
    drawn = placed.filter(F.col("eligible") == 1).count() * share // 100
    rank = F.when((F.col("eligible") == 1) & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.cast("long").alias("rank"))

