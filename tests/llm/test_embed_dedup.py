import numpy as np
import pytest

from gavelspark.llm import embed_dedup, queries

from ..support import MIDDLE, SMALL
from .fixtures import groups_of

NAN, INF = float("nan"), float("inf")


def brute(rows):
    unit, at = [], []
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            unit.append(a / np.linalg.norm(a))
            at.append(k)
    alike = lambda i, j: len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95
    links, component = [0] * len(rows), [r[0] for r in rows]
    for i in range(len(at)):
        for j in range(i):
            if alike(i, j):
                links[at[i]] += 1
                links[at[j]] += 1
    groups = groups_of(len(at), alike)
    for g in set(groups):
        members = [at[i] for i in range(len(at)) if groups[i] == g]
        for m in members:
            component[m] = min(rows[x][0] for x in members)
    return sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, component))


@pytest.mark.parametrize("sf_dir", [SMALL, MIDDLE])
def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op6_embedding_near_dedup"](spark, sf_dir).collect())) == brute(rows)


def test_edge_vectors_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, NAN]), (6, [INF, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.0]), (10, [0.0, 1.0, 0.05]), (11, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' AS id", "'y' AS v", "'z' AS root")
    assert sorted(map(tuple, embed_dedup.near_vectors(df).collect())) == brute(rows)


def test_chains_through_a_hot_bucket(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(scale=0.18, size=16)).tolist()) for i in range(700)]
    got = sorted(map(tuple, embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    want = brute(rows)
    assert sum(g[1] for g in got) >= 0.995 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))


def test_shape_follows_the_number_of_vectors():
    last = 0
    for rows in (1, 100, 10_000, 10**6, 10**9):
        bits, tables = embed_dedup.shape(rows)
        assert bits >= last and rows <= 2 ** (bits - embed_dedup.SPARE)
        last = bits
        p = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - p) ** tables >= embed_dedup.RECALL > 1 - (1 - p) ** (tables - 1)
    assert embed_dedup.shape(10, threshold=1.0)[1] == 1


def test_copies_and_clusters_beside_many_unlike_vectors(spark):
    """Buckets of two, of a few and of many; equal vectors that hold a third of the rows."""
    rng = np.random.default_rng(8)
    rows = [rng.normal(size=24) for _ in range(500)]
    for size in (2, 3, 5, 60):
        base = rng.normal(size=24)
        rows += [base + rng.normal(scale=0.1, size=24) for _ in range(size)]
    rows += [rows[0]] * 400
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    got = sorted(map(tuple, embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == brute(rows)


def test_extreme_lengths_of_vectors(spark):
    rows = [(1, [1e200, 1e199]), (2, [1e-200, 1e-201]), (3, [-1.0, 0.0])]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links) for r in got) == [(1, 1), (2, 1), (3, 0)]


def test_empty_table(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
