"""Fuzzy joins by trigram similarity.

Pairs at similarity t or more share enough trigrams that at least one lies in the first n - ceil(t n) + 1 of the rarer
ones of either side, and neither has less than t times the other's trigrams; so only those are joined on (prefix and
length filter), and only texts and sizes travel. Distinct candidates are then verified on their whole sets. Equal texts
are matched once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.regex import escape, unicode_words
from ..functions.text import telling_words
from ..functions.vectors import trigram_similarity, trigrams


def _prefixed(texts: DataFrame, weights: DataFrame, threshold: float) -> DataFrame:
    """(text, size, gram): the rarest grams of each text that a match must share."""
    rows = texts.select("text", F.size("grams").alias("size"), F.explode("grams").alias("gram")).join(weights, "gram")
    order = Window.partitionBy("text").orderBy("freq", "gram")
    size = F.col("size")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size - F.ceil(size * threshold) + 1).select("text", "size", "gram")


def similar_pairs(left: DataFrame, left_col: str, right: DataFrame, right_col: str, threshold: float = 0.45) -> DataFrame:
    """(a, b, similarity) of distinct texts with similarity of ``threshold`` or more. Texts without a trigram match
    nothing."""
    prep = lambda df, c: df.select(F.col(c).alias("text")).filter(F.col("text").isNotNull()).distinct().withColumn("grams", trigrams(F.col("text"))).filter(F.size("grams") > 0)
    a, b = prep(left, left_col), prep(right, right_col)
    weights = a.union(b).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    pa = _prefixed(a, weights, threshold).select(F.col("text").alias("a"), F.col("size").alias("na"), "gram")
    pb = _prefixed(b, weights, threshold).select(F.col("text").alias("b"), F.col("size").alias("nb"), "gram")
    like = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    pairs = pa.join(pb, "gram").filter(like).select("a", "b").distinct()
    return pairs.withColumn("similarity", trigram_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= threshold)


def word_pairs(left: DataFrame, left_col: str, right: DataFrame, right_col: str, within: tuple[str, str] | None = None) -> DataFrame:
    """(a, b): texts of the right that have the left's most telling word at a word start, as an equi-join on that word
    against the right's words cut to its length. With ``within``, a column of either side, only texts that agree in it
    pair up, and a left row without a value pairs with all; so a common word is parted by what it is said of."""
    own, other = (F.col(c) if within else F.lit(None).cast("string") for c in within or ("", ""))
    a = left.select(F.col(left_col).alias("a"), own.alias("own")).distinct().withColumn("word", F.get(telling_words(F.col("a")), F.lit(0))).filter("word IS NOT NULL")
    lengths = a.select(F.length("word").alias("n")).distinct()
    words = right.select(F.col(right_col).alias("b"), other.alias("own")).distinct().withColumn("token", F.explode(F.array_distinct(F.split(F.lower("b"), r"[^\p{L}\p{N}_]+"))))
    starts = words.join(F.broadcast(lengths), F.length("token") >= F.col("n")).select("b", "own", F.substring("token", F.lit(1), F.col("n")).alias("word")).distinct()
    every = a.filter("own IS NULL").drop("own").join(starts.drop("own"), "word").select("a", "b")
    alike = a.filter("own IS NOT NULL").join(starts, ["word", "own"]).select("a", "b")
    return (alike.union(every) if within else every).distinct()


def verified(a: Column, word: str) -> Column:
    return a.rlike(unicode_words(r"\m" + escape(word)))
