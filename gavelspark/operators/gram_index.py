"""A trigram index that is kept: postings by trigram, extended by new texts and compacted, for search and fuzzy joins.

Three kept tables: ``texts`` (each distinct text once), ``postings`` (gram, text, size of the text's set) and ``freq``
(how many texts have a gram). A query reads the buckets of its own grams only. A reader works on the versions that were
there when it opened the index, so additions and compactions do not disturb it.

A text that shares t of its own n grams with another shares at least one of its n - ceil(t n) + 1 rarest, whatever
order the other side's are in; so only the probe's side is cut and the postings need not know how rare a gram has become.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.vectors import trigram_similarity, trigrams
from . import merge as M
from .kept import BUCKETS, KeptTable
from .stable import pinned

#: Files of a bucket in one addition, as a common trigram fills its bucket.
SPREAD = 4


def _sets(texts: DataFrame) -> DataFrame:
    rows = texts.withColumn("grams", trigrams(F.col("text"))).filter(F.size("grams") > 0)
    return rows.select("text", F.size("grams").alias("size"), F.explode("grams").alias("gram"))


class GramIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.texts, self.postings, self.freq = (KeptTable(spark, f"{self.path}/{n}") for n in ("texts", "postings", "freq"))
        if self.texts.versions():
            self.at = (self.texts.version().number, self.postings.version().number, self.freq.version().number)

    @classmethod
    def build(cls, path: str, texts: DataFrame, buckets: int = BUCKETS) -> GramIndex:
        """An index of the distinct values of the one column of ``texts``."""
        distinct = pinned(texts.toDF("text").filter("text IS NOT NULL").distinct())  # written to three tables
        sets, root = _sets(distinct), path.rstrip("/")
        KeptTable.create(f"{root}/postings", sets.select("gram", "text", "size"), ["gram"], buckets)
        KeptTable.create(f"{root}/freq", sets.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), ["gram"], buckets)
        KeptTable.create(f"{root}/texts", distinct, ["text"], buckets)
        return cls(texts.sparkSession, path)

    def add(self, texts: DataFrame) -> GramIndex:
        """The index with more texts; those it has are left out. Texts come last, so an addition that broke off is
        repeated, and a posting that is there twice finds its text once."""
        asked = texts.toDF("text").filter("text IS NOT NULL").distinct()
        asked = pinned(asked)
        new = pinned(asked.join(self.texts.read(keys=asked), "text", "left_anti"))
        sets = _sets(new)
        self.postings.append(sets.select("gram", "text", "size"), SPREAD)
        self.freq.merge(sets.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), lambda old, more: M.merge(old, more, ["gram"], {"n": M.add}))
        self.texts.append(new)
        return GramIndex(self.spark, self.path)

    def compact(self, most: int = 4) -> GramIndex:
        self.postings.compact(most)
        self.texts.compact(most)
        return GramIndex(self.spark, self.path)

    def search(self, text: str, threshold: float = 0.3) -> DataFrame:
        """(text, similarity) of the indexed texts of at least this similarity to one text."""
        asked = self.spark.createDataFrame([(text,)], "text string").select(F.explode(trigrams(F.col("text"))).alias("gram"))
        n = asked.count()
        held = self.postings.read(self.at[1], keys=asked).join(F.broadcast(asked), "gram")  # a few grams of one text
        shared = held.select("gram", "text", "size").distinct().groupBy("text", "size").agg(F.count(F.lit(1)).alias("both"))
        similarity = F.col("both") / (F.col("size") + n - F.col("both"))
        return shared.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select("text", "similarity")

    def similar(self, texts: DataFrame, threshold: float = 0.45) -> DataFrame:
        """(a, b, similarity): ``a`` of the one column of ``texts``, ``b`` of the index."""
        sets = _sets(texts.toDF("text").filter("text IS NOT NULL").distinct())
        freq = self.freq.read(self.at[2], keys=sets.select("gram").distinct())
        rarest = Window.partitionBy("text").orderBy(F.coalesce("n", F.lit(0)), "gram")
        probes = sets.join(freq, "gram", "left").withColumn("place", F.row_number().over(rarest))
        probes = probes.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold) + 1).filter("n IS NOT NULL")
        probes = probes.select(F.col("text").alias("a"), F.col("size").alias("na"), "gram")
        held = self.postings.read(self.at[1], keys=probes.select("gram").distinct())
        like = F.least("na", "size") >= F.greatest("na", "size") * threshold - 1e-9
        pairs = probes.join(held, "gram").filter(like).select("a", F.col("text").alias("b")).distinct()
        return pairs.withColumn("similarity", trigram_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= threshold)

    def containing(self, part: str) -> DataFrame:
        """Indexed texts that contain ``part``, in any case. Only whole trigrams inside a word of ``part`` can be looked
        up; a part without one is searched for in all texts."""
        inside = [w[i : i + 3] for w in re.findall(r"[^\W_]+", part.lower()) for i in range(len(w) - 2)]
        hit = F.lower("text").contains(F.lower(F.lit(part)))
        if not inside:
            return self.texts.read(self.at[0]).filter(hit)
        asked = self.spark.createDataFrame([(g,) for g in sorted(set(inside))], "gram string")
        freq = self.freq.read(self.at[2], keys=asked).join(F.broadcast(asked), "gram", "right")
        rarest = freq.orderBy(F.coalesce("n", F.lit(0)), "gram").select("gram").limit(1)
        held = self.postings.read(self.at[1], keys=rarest).join(F.broadcast(rarest), "gram")
        return held.select("text").distinct().filter(hit)


def rows_with(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """``rows`` whose text the index found."""
    return rows.join(found.select(F.col("text").alias(column)), column, "left_semi")

