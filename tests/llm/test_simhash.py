import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gavelspark.llm import queries, simhash
from gavelspark.llm.components import connected_components

from ..support import MIDDLE, SMALL
from .fixtures import EDGE, documents, empty, groups_of

INF = 1 << 62


def brute_print(text):
    words, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    words += [word] if word else []
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints):
    distinct = sorted(set(prints))
    root = groups_of(len(distinct), lambda i, j: (distinct[i] ^ distinct[j]).bit_count() <= 2)
    of = dict(zip(distinct, root))
    least = {}
    for i, p in zip(ids, prints):
        least[of[p]] = min(least.get(of[p], INF), INF if i is None else i)
    return [None if least[of[p]] == INF else least[of[p]] for p in prints]


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [brute_print(d.text) for d in docs]
    want = sorted((d.doc_id, f"{p:016x}", c) for d, p, c in zip(docs, prints, brute_components([d.doc_id for d in docs], prints)))
    assert sorted(map(tuple, queries.QUERIES["op9_simhash_near_dedup"](spark, sf_dir).collect())) == want


def test_edge_rows(spark):
    rows = [r for r in EDGE if len(r[1] or "") < 10_000]
    prints = [brute_print(r[1]) for r in rows]
    want = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints))), key=repr)
    got = simhash.near_duplicates(documents(spark, rows, clashes=True)).select("doc_id", simhash.hex_digits(), "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_one_of_each_group_stays(spark):
    docs = documents(spark, clashes=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    # 3 and 6 have fingerprint zero like 2; 11 is a copy of 10; the copies of 5 share their fate, its other text its own
    assert ids == sorted([1, 2, None, 4, 5, 5, 5, 7, 8, 9, 10], key=repr)


def test_shared_id_does_not_take_another_group_along(spark):
    text = "a text of some length that has a group of its own to stand for"
    rows = [(3, "copy of something else entirely, told twice", None, None), (5, "copy of something else entirely, told twice", None, None), (5, text, None, None), (9, text, None, None)]
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(documents(spark, rows)).select("doc_id", "text").collect()) == [(3, rows[0][1]), (5, text)]


def test_large_shards_are_exact(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    values = {0, base}
    for _ in range(900):  # many fingerprints that agree in their upper halves, and chains through them
        values.add(base ^ r.getrandbits(26) & r.getrandbits(26))
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"))
    of = {row.node: row.root for row in connected_components(links).collect()}
    want = groups_of(len(values), lambda i, j: (values[i] ^ values[j]).bit_count() <= 2)
    got = [of.get(s, s) for (s,) in signed]
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_bk_tree():
    r = random.Random(2)
    values = list({r.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[:40]:
        assert sorted(tree.values[i] for i in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(7, 7), (1000, 1001), (1001, 1000)]
    of = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({of[i] for i in range(301)}) == 1 and of[1000] == of[1001] != of[0] and len(of) == 303


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_hot_keys_are_joined_apart(spark):
    from gavelspark.llm.common import join_split

    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("x")).union(spark.range(3000).selectExpr("3L", "id"))
    counts = rows.filter("k != 5").groupBy("k").agg(F.count(F.lit(1)).alias("w"), F.max("x").alias("top"))
    for how in ("inner", "left"):
        got = join_split(rows, counts, ["k"], "w", how, share=10, floor=200)
        assert sorted(got.collect(), key=str) == sorted(rows.join(counts.drop("w"), "k", how).collect(), key=str)


def test_bitmap_of_keys(spark, monkeypatch):
    """No key of the bitmap is missed, few others pass, and a full bitmap only lets everything pass."""
    from gavelspark.llm import common

    rows = spark.range(5000).select(F.col("id").alias(common.ID), F.xxhash64("id").alias(common.RK), F.lit("t").alias("text"))
    inside = rows.filter(f"{common.ID} % 10 = 0")
    for bits, most in ((common.KEY_BITS, 510), (64, 5000)):
        monkeypatch.setattr(common, "KEY_BITS", bits)
        likely, quiet = common.maybe_among(rows, common.key_bitmap(inside))
        assert likely.columns == rows.columns and likely.count() + quiet.count() == 5000
        assert inside.select(common.ID).exceptAll(likely.select(common.ID)).count() == 0 and likely.count() <= most
    assert common.maybe_among(rows, common.key_bitmap(inside.limit(0)))[0].count() == 0
