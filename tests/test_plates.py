"""Plates in texts whose capitals are not letter by letter."""

from pyspark.sql import functions as F

from gavelspark.functions import text as T

CASES = {"aß 123": None, "abc 123ß": "ABC123", "ŉab 123": None, "abc\x0b123": None, "abc\t123": "ABC123", "ſab 123": "SAB123", "abc 123ı": None, "gruß abc 12d": "ABC12D"}


def test_plates_by_letter(spark):
    got = spark.createDataFrame([(x,) for x in CASES], "x string").select("x", T.plate(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == CASES
