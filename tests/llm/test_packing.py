import random
from collections import defaultdict
from itertools import combinations

import numpy as np

from gavelspark.llm import packing, queries

from ..support import MIDDLE
from .fixtures import EDGE, documents, empty


def padding(bounds, lengths):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_boundaries_are_optimal():
    r = random.Random(1)
    for top in (60, 3_000, 1_000_000):
        for buckets in (1, 3, 5):
            for _ in range(12):
                lengths = [r.randint(0, top) for _ in range(r.randint(1, 16))] + [r.randint(0, top)] * r.choice([0, 1, 40])
                values = sorted(set(lengths))
                found = packing.best_boundaries(values, [lengths.count(v) for v in values], buckets)
                best = min(padding([*c, values[-1]], lengths) for k in range(buckets) for c in combinations(values[:-1], k))
                assert padding(found, lengths) == best and len(found) <= buckets
    assert packing.best_boundaries([], []) == []


def least_padding(lengths, buckets):
    """The textbook programme over all pairs of cuts."""
    values = sorted(set(lengths))
    rows = np.array([lengths.count(v) for v in values])
    count, words = np.concatenate([[0], rows.cumsum()]), np.concatenate([[0], (rows * values).cumsum()])
    cost = np.array([[values[j - 1] * (count[j] - count[i]) - (words[j] - words[i]) if i < j else 10**15 for j in range(1, len(values) + 1)] for i in range(len(values))])
    best = cost[0]
    for _ in range(buckets - 1):
        best = np.minimum(best, [min((best[i - 1] + cost[i, j] for i in range(1, j + 1)), default=10**15) for j in range(len(values))])
    return int(best[-1])


def test_query_packs_every_document(spark):
    docs = {d.doc_id: len((d.text or "").split()) for d in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_packing"](spark, MIDDLE).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check(rows)
    # rows lie in the first bucket that holds them, and the whole padding is the least possible
    bounds = sorted({r.boundary for r in rows})
    assert all(r.boundary == min(b for b in bounds if b >= r.n_tokens) for r in rows)
    assert sum(r.padding for r in rows) == least_padding(list(docs.values()), packing.BUCKETS)


def check(rows, budget=packing.BUDGET):
    batches = defaultdict(list)
    for r in rows:
        assert r.padding == r.boundary - r.n_tokens >= 0
        batches[r.bucket, r.batch].append(r)
    for (bucket, number), members in batches.items():
        assert len(members) == 1 or len(members) * members[0].boundary <= budget
    for bucket in {b for b, _ in batches}:  # only a bucket's last batch may have room
        numbers = sorted(n for b, n in batches if b == bucket)
        assert numbers == list(range(len(numbers)))
        sizes = {len(batches[bucket, n]) for n in numbers[:-1]}
        assert len(sizes) <= 1


def test_words_and_ties(spark):
    rows = packing.pack(documents(spark, clashes=True), budget=40, buckets=4).collect()
    words = lambda t: len([w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t or "").split(" ") if w])
    assert sorted(((r.doc_id, r.n_tokens) for r in rows), key=repr) == sorted(((x[0], words(x[1])) for x in EDGE), key=repr)
    check(rows, 40)


def test_one_length_for_all(spark):
    rows = packing.pack(documents(spark, [(i, "one two three four", None, None) for i in range(500)]), budget=16).collect()
    assert sorted(r.batch for r in rows) == [i // 4 for i in range(500)]


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0
