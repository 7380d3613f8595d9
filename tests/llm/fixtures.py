"""Small tables with the cases that every operator must survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LONG = " ".join(f"word{i % 977}" for i in range(120_000))
#: Names that operators use while they work.
CLASHES = ["id", "rk", "t", "fp", "kinds", "keep_bitmap", "h1", "pos", "score", "lang_pred", "rejected", "n", "node", "y", "length", "bucket", "place", "root", "key", "v", "text_2", "__id", "__RK", "__keep", "__spans", "__bit", "caller_0"]
EDGE = [
    (1, "A shared line of text\nonly here\n\nA shared line of text", "en", "web"),
    (2, None, "en", "web"),
    (3, "", None, None),
    (None, "no id at all\na shared LINE of text \t", "en", None),
    (4, LONG, "en", "web"),
    (5, "twice the same row with password = hunter2secret", "en", "web"),
    (5, "twice the same row with password = hunter2secret", "en", "web"),
    (5, "the same id with another text and eleven more words in it to count", "en", "web"),
    (6, " \t\n\x0b ", "de", "web"),
    (7, "åäö é 東京 🎉 ünïcode  nbsp line\x01mark", "de", "mail"),
    (8, "A SHARED LINE OF TEXT\nnumber eight", "fr", "mail"),
    (9, "x", None, "mail"),
    (10, "one two three four five six seven eight nine ten eleven twelve", "en", "web"),
    (11, "one two three four five six seven eight nine ten eleven twelve", "en", "web"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def documents(spark: SparkSession, rows=EDGE, clashes: bool = False) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "CAST(length(text) AS BIGINT) AS n_chars").repartition(3)
    if clashes:
        df = df.selectExpr("*", *[f"'mine' AS `{c}`" for c in CLASHES])
    return df


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])


def groups_of(n: int, linked) -> list[int]:
    """Least member of each member's component, by brute force over all pairs."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]
