import zlib
from collections import Counter, defaultdict

import pytest

from gavelspark.llm import queries, shards

from ..support import MIDDLE, SMALL
from .fixtures import EDGE, documents, empty


def held(found, rows, count):
    """What any sharding must hold; returns the bytes of each shard."""
    got = [tuple(r) for r in found.collect()]
    want = sorted((repr(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r[0]), r[1], r[2]) for r in got) == want
    slots, sizes, texts = defaultdict(list), Counter(), defaultdict(set)
    for _, size, crc, shard, slot in got:
        assert 0 <= shard < count
        slots[shard].append(slot)
        sizes[shard] += size
        texts[size, crc].add(shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, texts


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    found = queries.QUERIES["op11_kd_sharding"](spark, sf_dir)
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    sizes, texts = held(found.drop("law", "grown_shard"), [(d.doc_id, d.text) for d in docs], 40)
    groups = Counter()
    for d in docs:
        groups[d.text or ""] += len((d.text or "").encode()) + 16
    target = sum(sizes.values()) / 40
    whole = {(len(t.encode()) + 16, zlib.crc32(t.encode())) for t, n in groups.items() if n <= target}
    assert all(len(texts[k]) == 1 for k in whole)
    # a shard can miss its part by what one group weighs
    assert max(sizes.values()) - target <= max(max(groups.values()) - target, target / 4) and len(sizes) == 40


def table(spark, rows):
    return documents(spark, rows).repartition(7)


def near(sizes, count, by):
    part = sum(sizes.values()) / count
    assert len(sizes) == count and max(sizes.values()) <= part * (1 + by) and min(sizes.values()) >= part * (1 - by)


def test_even_bytes_and_whole_groups(spark):
    rows = [(i, f"text {i} " * (i % 60 + 1), f"l{i % 3}", f"s{i % 5}") for i in range(6000)]
    rows += [(10_000 + i, f"copied {i % 40} " * 50, f"l{i % 2}", "s9") for i in range(1200)]  # groups of 30, of most of a large one's size
    sizes, texts = held(shards.kd_shards(table(spark, rows), 40), [(r[0], r[1]) for r in rows], 40)
    near(sizes, 40, 0.01)
    assert all(len(s) == 1 for s in texts.values())


def test_hot_group_is_torn_and_even(spark):
    rows = [(i, f"text {i} " * 20, "en", "web") for i in range(4000)] + [(9000 + i, "the same text " * 12, "en", "hot") for i in range(2000)]
    sizes, texts = held(shards.kd_shards(table(spark, rows), 16), [(r[0], r[1]) for r in rows], 16)
    near(sizes, 16, 0.03)
    assert sum(len(s) > 1 for s in texts.values()) == 1


def test_empty_texts_hold_most_rows(spark):
    rows = [(i, None if i % 2 else "", None, None) for i in range(3000)] + [(5000 + i, f"words {i} " * 30, "en", "a") for i in range(500)]
    sizes, _ = held(shards.kd_shards(table(spark, rows), 8), [(r[0], r[1]) for r in rows], 8)
    near(sizes, 8, 0.05)


def test_metadata_stay_close(spark):
    """Languages are as wide as ids and come first, so the first cut parts them; the next ones go along the ids."""
    rows = [(i, f"text {i:05} same length", "abcd"[i % 4], "web") for i in range(4000)]
    docs = table(spark, rows)
    found = {r.doc_id: r.shard for r in shards.kd_shards(docs, 8).collect()}
    by = defaultdict(set)
    for i, shard in found.items():
        by[i % 4].add(shard)
    assert not (by[0] | by[1]) & (by[2] | by[3])
    assert all(shards_of_ids(found, shard) <= 1100 for shard in range(8))


def shards_of_ids(found, shard):
    """How far apart the ids of a shard are."""
    ids = [i for i, s in found.items() if s == shard]
    return max(ids) - min(ids)


def test_edge_rows(spark):
    found = shards.kd_shards(documents(spark, clashes=True), 5)
    held(found, [(r[0], r[1]) for r in EDGE], 5)
    plain = shards.kd_shards(documents(spark).select("doc_id", "text"), 3)
    held(plain, [(r[0], r[1]) for r in EDGE], 3)
    assert shards.kd_shards(empty(spark), 5).collect() == []
    assert {r.shard for r in shards.kd_shards(documents(spark, EDGE[:2]), 1).collect()} == {0}


def test_written_shards(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 9 + 1), "en", "web") for i in range(300)] + [(i, f"text {i} " * (i % 9 + 1), "en", "web") for i in range(30)] + [(None, None, None, None)] * 2
    path = str(tmp_path / "out")
    shards.write_shards(documents(spark, rows), path, target_bytes=4000)
    back = spark.read.parquet(path)
    assert sorted(repr((r.doc_id, r.text)) for r in back.collect()) == sorted(repr(r[:2]) for r in rows)
    assert back.select("shard").distinct().count() == -(-sum(len((r[1] or "").encode()) + 16 for r in rows) // 4000)
