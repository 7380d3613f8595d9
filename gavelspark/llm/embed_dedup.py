"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosine check, components.

Equal vectors are folded into one first (their mutual links are counted, not listed). Each remaining vector gets one
signature in each of several tables of seeded hyperplanes; two vectors are compared where they share a signature, in
the first table in which they do, so that no pair is counted twice and no list of pairs is ever shuffled. The number of
signs follows the number of vectors (``SPARE`` more than its logarithm), so that unlike vectors share a signature in
one table of sixteen on average at any size; the number of tables is the least that finds a pair at the threshold with
probability ``RECALL``, and pairs above it more often (0.99999 at 0.96).

Signatures are counted first. Buckets of the same members in several tables meet once, and vectors travel only to
buckets that meet. A bucket with many members is cut into pieces of about ``PIECE`` and every two pieces meet in a task
of their own; no bucket is capped. What leaves a task is a partial link count for each member and edges that connect
the linked members, never the pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own component; vectors of different lengths never link; equal vectors link; rows that repeat an id count as vectors of their own.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import NO_ID, durable, join_split, per_batch, row_id, shuffle_width, small_batches
from .components import connected_components

THRESHOLD = 0.95
RECALL = 0.9993
SPARE = 4
LEAST_BITS, MOST_BITS = 8, 48
PIECE = 256
#: Low bits of a key that hold the number of its table.
_TABLE_BITS = 12
_TABLE = (1 << _TABLE_BITS) - 1


def shape(rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(signs of a signature, tables) for so many distinct vectors."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(rows, 2))) + SPARE))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    tables = math.ceil(math.log(1 - recall) / math.log1p(-same)) if same < 1 else 1
    return bits, min(tables, _TABLE)


@lru_cache(maxsize=4)
def hyperplanes(dim: int, bits: int, tables: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits * tables))


def _rows(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b].astype(np.float64) for a, b in zip(offsets[:-1], offsets[1:])]


def signatures(vectors: np.ndarray, bits: int, tables: int, of: int | None = None) -> np.ndarray:
    """A matrix of signatures, one column a table; the first ``of`` tables only, if given."""
    of = tables if of is None else of
    signs = (vectors @ hyperplanes(vectors.shape[1], bits, tables)[:, : of * bits] > 0).reshape(len(vectors), of, bits)
    out = np.zeros((len(vectors), of), np.int64)
    for k in range(bits):
        out |= signs[:, :, k].astype(np.int64) << k
    return out


def _signed(bits: int, tables: int):
    def run(batch: pa.RecordBatch):
        rows = _rows(batch.column("v"))
        ids = batch.column("id").to_numpy()
        for dim in sorted({len(r) for r in rows}):
            at = [i for i, r in enumerate(rows) if len(r) == dim]
            keys = signatures(np.stack([rows[i] for i in at]), bits, tables) << _TABLE_BITS | np.arange(tables, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), lists], names=["id", "sigs"])

    return run


def usable(col: str) -> F.Column:
    """True for vectors that can link: finite, not null, not zero."""
    x = F.col(col)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0), F.lit(False))


def _compare(threshold: float, bits: int, tables: int):
    """mapInArrow over rows sorted by (key, pieces): counts and edges of each meeting of two pieces."""

    def unlike(u: np.ndarray, v: np.ndarray) -> bool:
        """Quick and certain: the pair is far below the threshold."""
        uu, vv, uv = float(u @ u), float(v @ v), float(u @ v)
        return 1e-100 < uu < 1e100 and 1e-100 < vv < 1e100 and (uv <= 0 or uv * uv < 0.999 * threshold * threshold * uu * vv)

    def meet(group: list[tuple]) -> list[tuple[int, int, int]]:
        key, a, b = group[0][:3]
        dims = {len(g[6]) for g in group}
        if len(dims) > 1:  # a signature means nothing across dimensions
            return [row for d in sorted(dims) for row in meet([g for g in group if len(g[6]) == d])]
        if len(group) == 2 and threshold > 0 and unlike(group[0][6], group[1][6]):
            return []
        ids = np.array([g[4] for g in group])
        mult = np.array([g[5] for g in group])
        piece = np.array([g[3] for g in group])
        unit = np.stack([g[6] for g in group])
        unit /= np.abs(unit).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        left, right = (np.nonzero(piece == p)[0] for p in (a, b))
        if not len(left) or not len(right):
            return []
        hit = unit[left] @ unit[right].T >= threshold
        if a == b:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return []
        table = key & _TABLE
        if table:
            rows, columns = np.nonzero(hit.any(axis=1))[0], np.nonzero(hit.any(axis=0))[0]
            sig = [signatures(np.stack([group[k][6] for k in side]), bits, tables, table) for side in (left[rows], right[columns])]
            for at, signs in zip(rows, sig[0]):
                met = columns[hit[at, columns]]
                earlier = (sig[1][np.searchsorted(columns, met)] == signs).any(axis=1)
                hit[at, met[earlier]] = False
        out = []
        counts = hit @ mult[right]
        out += [(int(ids[left[i]]), int(counts[i]), int(ids[right[int(hit[i].argmax())]])) for i in np.nonzero(counts)[0]]
        if a != b:
            counts = mult[left] @ hit
            out += [(int(ids[right[j]]), int(counts[j]), int(ids[left[int(hit[:, j].argmax())]])) for j in np.nonzero(counts)[0]]
        out += _joins(hit, ids[left], ids[right])
        return out

    def run(batches):
        key, group, out = None, [], []
        for batch in batches:
            vectors = _rows(batch.column(6))
            for *row, v in zip(*(batch.column(i).to_pylist() for i in range(6)), vectors):
                if row[:3] != key:
                    if len(group) > 1:
                        out += meet(group)
                    key, group = row[:3], []
                group.append((*row, v))
            if out:
                yield _links(out)
                out = []
        if len(group) > 1:
            out += meet(group)
        if out:
            yield _links(out)

    return run


def _joins(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges (count 0) that connect what ``hit`` connects: a spanning forest of its bipartite graph."""
    out, seen_l, seen_r = [], np.zeros(len(left), bool), np.zeros(len(right), bool)
    for start in range(len(left)):
        if seen_l[start] or not hit[start].any():
            continue
        seen_l[start] = True
        todo = [("l", start)]
        while todo:
            side, i = todo.pop()
            if side == "l":
                for j in np.nonzero(hit[i] & ~seen_r)[0]:
                    seen_r[j] = True
                    out.append((int(left[i]), 0, int(right[j])))
                    todo.append(("r", int(j)))
            else:
                for j in np.nonzero(hit[:, i] & ~seen_l)[0]:
                    seen_l[j] = True
                    out.append((int(right[i]), 0, int(left[j])))
                    todo.append(("l", int(j)))
    return out


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["id", "n", "other"])


def vector_links(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n, other) from distinct vectors (id, v, mult): partial link counts, and edges id - other."""
    bits, tables = shape(vectors.count(), threshold, recall)
    signed = durable(small_batches(vectors).select("id", "v").mapInArrow(per_batch(_signed(bits, tables)), "id long, sigs array<bigint>"), "signatures")
    members = signed.select("id", F.explode("sigs").alias("key"))
    shared = durable(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    # a bucket may hold most vectors: hot keys are looked up by broadcast
    met = durable(join_split(members, shared.withColumn("weight", F.col("n")), ["key"], "weight"), "members")
    # buckets of the same members: the one of the first table stands for all
    marks = [F.expr(f"bit_xor(xxhash64({k}, id))").alias(f"mark{k}") for k in (1, 2)]
    sets = met.groupBy("key", "n").agg(*marks).groupBy("n", "mark1", "mark2").agg(F.min_by("key", F.col("key").bitwiseAND(F.lit(_TABLE))).alias("key"))
    kept = durable(sets.select("key", F.ceil(F.col("n") / PIECE).cast("int").alias("pieces"), "n"), "kept")
    placed = join_split(met.drop("n"), kept, ["key"], "n").withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int"))
    every = F.sequence(F.lit(0), F.col("pieces") - 1)
    meets = placed.withColumn("other", F.explode(every))
    meets = meets.select("key", F.least("piece", "other").alias("a"), F.greatest("piece", "other").alias("b"), "piece", "id")
    n = shuffle_width(vectors.sparkSession)
    rows = meets.join(vectors, "id").select("key", "a", "b", "piece", "id", "mult", "v")
    dealt = rows.repartition(n, "key", "a", "b").sortWithinPartitions("key", "a", "b", "piece", "id")
    return small_batches(dealt).mapInArrow(_compare(threshold, bits, tables), "id long, n long, other long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(id, n_links, component_id, kept) per vector."""
    vector = F.when(usable(vector_col), F.col(vector_col))
    # equal vectors are told by 128 hash bits where a row looks for its vector's result
    held = durable(rows.select(row_id(id_col).alias("id"), vector.alias("v")).withColumns({"none": F.col("v").isNull(), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")
    folded = held.filter("v IS NOT NULL").groupBy("h1", "h2", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("mult"))
    # vectors get a number of their own, as ids may repeat; written at once, so that it never changes
    distinct = durable(folded.withColumn("id", F.monotonically_increasing_id()), "distinct")
    links = durable(vector_links(distinct.select("id", "v", "mult"), threshold, recall), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n"))
    roots = connected_components(links.select(F.col("id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "id")
    known = distinct.drop("v").join(counts, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    found = durable(known.select("h1", "h2", "root", "least", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "found")
    components = durable(found.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("vectors")), "components")
    found = durable(join_split(found, components, ["root"], "vectors").select("h1", "h2", "mult", "n_links", "component_id"), "found")
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    full = join_split(held.filter("NOT none").select("id", "h1", "h2"), found, ["h1", "h2"], "mult").select("id", "n_links", "component_id")
    full = full.union(held.filter("none").select("id", F.lit(0).cast("long"), "id"))
    return full.select(null("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), null("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
