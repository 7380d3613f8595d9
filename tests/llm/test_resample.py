import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from gavelspark.llm import queries, resample

from ..support import MIDDLE, SMALL, assert_same
from .fixtures import EDGE, LONG, documents, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, grams, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    return words, Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(words) - n + 1))


def brute(docs, target, grams=1, buckets=10_000, share=10, min_words=20):
    read = [(i, *features(t, grams, buckets)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in read:
        s.update(f)
    for text in target:
        t.update(features(text, grams, buckets)[1])
    all_s, all_t = float(s.total()), float(t.total())
    rows = []
    for i, words, f in read:
        total = sum(n * math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b, n in f.items())
        weight = total // f.total() if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], 1 << 63 if r[0] is None else r[0]))
    for k, r in enumerate(able[: len(able) * share // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_sql_and_brute_force(spark, sf_dir):
    df = queries.QUERIES["op12_importance_resampling"](spark, sf_dir)
    assert_same(df, sf_dir, queries.ORACLE["op12_importance_resampling"])
    docs, target = (spark.read.parquet(f"{sf_dir}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    assert sorted(map(tuple, df.collect()), key=repr) == brute([(d.doc_id, d.text) for d in docs], [t.text for t in target])


@pytest.mark.parametrize("grams,share,min_words", [(1, 10, 20), (2, 50, 0), (3, 100, 1)])
def test_edge_rows_and_grams(spark, grams, share, min_words):
    target = ["eleven more words", None, "", LONG[:5000], "åäö 東京"]
    rows = [*EDGE, (40, "Nul\x00inside ÅÄÖ Ⅷ x-y_z 1.5", None, None)]
    got = resample.importance_resample(documents(spark, rows, clashes=True), spark.createDataFrame([(t,) for t in target], "text string"), grams=grams, buckets=500, share=share, min_words=min_words)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r[0], r[1]) for r in rows], target, grams, 500, share, min_words)


def test_ties_go_by_id_over_partitions(spark):
    rows = [(i % 7, " ".join(["same"] * 25), None, None) for i in range(400)]
    got = resample.importance_resample(documents(spark, rows).repartition(31), documents(spark, EDGE), share=50)
    drawn = sorted((r.rank, r.doc_id, r.score) for r in got.collect() if r["rank"])
    assert [d[0] for d in drawn] == list(range(1, 201))
    assert drawn == sorted(drawn, key=lambda d: (-d[2], d[1], d[0]))


def test_empty_tables(spark):
    assert resample.importance_resample(empty(spark), documents(spark)).collect() == []
    assert resample.importance_resample(documents(spark), empty(spark)).count() == len(EDGE)
