"""The corpus pipeline: language ID, line dedup, near-dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of ``documents``; a stage that changes texts brings ``n_chars`` up to date. Language ID drops only documents it
rejects, near-dedup all members of a group but the smallest doc_id; the other stages keep every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gavelspark.llm import langid, line_dedup, packing, secrets, simhash
from gavelspark.llm.common import durable, small_batches, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs)
    return langid.identify(small_batches(docs).select(*COLUMNS), model).filter(~F.col("rejected")).select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.dedup_lines(small_batches(docs).select(*COLUMNS)))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(small_batches(docs).select(*COLUMNS))


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.mask_secrets(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("secret_scans", secret_masking),
    ("packing", pack),
]
#: Language ID, SimHash and the packing of batches have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
