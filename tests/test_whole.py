"""Queries that do the whole job: what a cut of their input would lose."""

import re

from gavelspark.operators import price
from gavelspark.plans.queries import ORACLE, QUERIES

from .support import MIDDLE, assert_same


def _written(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_tokens_beyond_character_400(spark, tmp_path):
    rows = [(1, "och " * 120 + "silverfat"), (2, "x " * 198 + "abcdefgh")]
    d = _written(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path, "documents")
    got = {r.doc_id: r.tokens for r in QUERIES["tokens_whole"](spark, d).collect()}
    assert got == {1: "silverfat", 2: "abcdefgh"}


def test_fusion_ranks_all_vectors(spark, tmp_path):
    """The vectors most like the first have ids of 300 and more."""
    for name in ("lineitem", "part", "supplier", "nation"):
        d = _written(spark.read.parquet(f"{MIDDLE}/{name}.parquet").limit(0), tmp_path, name)
    near = [1.0, 0.0]
    rows = [(i, near if i == 0 or i >= 900 else [0.0, 1.0], 0) for i in range(1000)]
    _written(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), tmp_path, "embeddings")
    got = {r.part_id: r.srank for r in QUERIES["semantic_rrf"](spark, d).collect()}
    assert got == {0: 1} | {i: i - 898 for i in range(900, 1000)}


def test_media_batch_of_all_users(spark, tmp_path):
    d = _written(spark.createDataFrame([(60, 10, 1.0), (60, 12, 1.0), (61, 14, 2.0)], "user_id long, event_id long, value double"), tmp_path, "events")
    got = sorted(map(tuple, QUERIES["media_sync_all"](spark, d).select("user_id", "event_id", "value").collect()))
    assert got == [(60, 10, 2.0), (61, 14, 2.0)]


def test_capped_plan_keeps_a_price_over_the_cap(spark, tmp_path):
    rows = [(i, "1-URGENT", 9.5 if i < 600 else i / 100) for i in range(1500)]
    d = _written(spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string, o_totalprice double"), tmp_path, "orders")
    assert_same(QUERIES["capped_partition_plan"](spark, d), d, ORACLE["capped_partition_plan"].replace("FROM orders", f"FROM read_parquet('{d}/orders.parquet/*.parquet')"))
    leaves = QUERIES["capped_partition_ranges"](spark, d).collect()
    # six hundred rows at 9.5, and the row numbered 950
    assert [(r.low, r.high, r.n) for r in leaves if r.over_cap] == [(950, 950, 601)]
    assert sum(r.n for r in leaves) == 1500


def test_comparables_are_verified_and_of_the_right_main(spark):
    """A sale under its reserve is out; a trusted category, then the lexicon, goes before the stored one."""
    title = "Silverfat graverat"
    targets = spark.createDataFrame([(title, "silver/fat")], "title string, category string")
    sale = lambda i, category, conf=None, reserve=None, status=None: (str(i), title, category, conf, 100 + i, 125 + i, True, i, reserve, status)
    rows = [*[sale(i, "silver/fat") for i in range(20)], sale(50, "silver/fat", None, 500.0), sale(51, "silver/fat", None, None, "not_met"), sale(52, "konst/tavla"), sale(53, "konst/tavla", "human")]
    kinds = "external_id string, title string, category string, category_conf string, final_bid long, final_total long, sold boolean, ended_at long, reserve_price double, reserve_status string"
    history = spark.createDataFrame(rows, kinds)
    lexicon = spark.createDataFrame([("silverfat", "silver/fat", 30)], "token string, category string, seen long")
    found = {r.external_id for r in price.comparables(targets, history, lexicon=lexicon).collect()}
    assert found == {str(i) for i in [*range(20), 52]}
    samples = price.price_samples(targets, history, lexicon=lexicon).orderBy("sample").collect()
    assert [r.external_id for r in samples] == ["52", *[str(i) for i in range(19, 5, -1)]]


def test_html_entities_of_all_pages(spark):
    entities = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}

    def plain(html):
        text = re.sub("<[^>]*>", " ", re.sub(r"(?is)<(script|style)[^>]*>.*?</\1\s*>", " ", html))
        for name, char in entities.items():
            text = text.replace(name, char)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")

    pages = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    got = {r.page_id: r.y for r in QUERIES["html_entities_rows"](spark, MIDDLE).collect()}
    assert got == pages
