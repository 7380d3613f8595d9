"""Costly work per row: dealt over all cores, and asked for only where it can change the result."""

import pytest
from pyspark.sql import functions as F

from gavelspark.functions import regex as R
from gavelspark.operators import merge, price
from gavelspark.plans.queries import QUERIES
from gavelspark.rules import classify
from gavelspark.rules.tables import LABEL_RULES, MIXED_SIGNAL, NAME_RULES, TITLE_RULES

from .support import SMALL

COSTLY = ["keyword_classify_rows", "keyword_classify", "title_rules_hit", "house_categories", "vehicle_records", "plate_regex_rows", "conflict_sweep", "map_blinto", "pages_fabeo_bids"]


@pytest.mark.parametrize("name", COSTLY)
def test_a_small_file_is_not_one_task(spark, name):
    assert QUERIES[name](spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_quicker_patterns_are_found_in_the_same_texts(spark):
    patterns = [p for p, _ in (*TITLE_RULES, *NAME_RULES, *LABEL_RULES)] + [MIXED_SIGNAL, r"x?\by|\bz?a", r"(a|\bb)\b", r"\d\b|[&^]q\b"]
    words = ["volvo", "vw", "xbuss", "buss", "en buss", "minibussar", "åbåt", "båt", "båtö", "tv-bänk", "tv", "lp skiva", "ps5", "ps55", "ring", "oring", "ringa", "ånga ring_", "vas", "kanvas", "xy", "y", "za", "a", "ab", "1a", "&q", "^q7", "konst ", " fordon", "mynt", "myntet", "oljor på duk", "matta, stol", "blandat parti", "-traktor", "a-traktor"]
    texts = spark.createDataFrame([(f" {a}{s}{b} ",) for a in words for s in (" ", "", "ö", "_", "-") for b in words], "t string")
    differs = lambda p: F.sum((F.col("t").rlike(R.ascii_words(p)) != F.col("t").rlike(R.found_ascii_words(p))).cast("int"))
    assert not any(texts.repartition(8).agg(*[differs(p).alias(str(i)) for i, p in enumerate(patterns)]).first())


def refused(spark, monkeypatch, module):
    """``by_text`` fails for titles that need no rules."""
    told = lambda title, *_: F.when(title == "never", F.raise_error(F.lit("asked for"))).otherwise("a/b")
    monkeypatch.setattr(module, "by_text", told)


def test_rules_are_not_asked_about_lots_they_cannot_change(spark, monkeypatch):
    refused(spark, monkeypatch, merge)
    lots = spark.createDataFrame([("never", "house", "active"), ("never", "text", "ended"), ("once", "text", "active"), ("never", None, "active"), ("never", "text", None)], "title string, category_conf string, status string")
    lots = lots.withColumns({"description": F.lit(None).cast("string"), "house": F.lit("pantbanken"), "raw": F.lit("{}"), "category_conflict": F.lit(False)})
    got = merge.flag_conflicts(lots.repartition(2)).select("title", "category_conflict").collect()
    assert sorted(map(tuple, got)) == [("never", False)] * 4 + [("once", True)]


def test_rules_are_not_asked_about_sales_with_a_category(spark, monkeypatch):
    refused(spark, monkeypatch, classify)
    sales = spark.createDataFrame([("never", "fordon/x"), ("once", None)], "title string, category string").repartition(2)
    assert sorted(tuple(r) for r in price.sale_mains(sales).select("title", "s_main").collect()) == [("never", "fordon"), ("once", "a")]
