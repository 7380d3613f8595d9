"""SimHash near-duplicate groups with BK-trees.

A fingerprint's bit is 1 where over half of the document's shingle hashes have it set. Distinct fingerprints are
dealt into shards such that two fingerprints within the radius always share one: their 64 bits are cut into
``radius + 3`` blocks, at most ``radius`` of which can differ, so some three blocks agree; a shard is a choice of three
blocks and their value. Each shard's BK-tree files a child under its integer Hamming distance to the parent, and a
look-up follows only the edges within the radius of the distance at hand. A shard of over ``TREE`` fingerprints is cut
once more in the same way over its remaining bits, which leaves eight free bits at most, so no tree ever exceeds 256
nodes and none of it relies on caps. The trees stay with the task that holds the shard: broadcasting them would
broadcast every fingerprint.

A shard gives each member one edge to its smallest neighbour group, never all pairs; components follow from
distributed contraction.

Edge cases: null, empty and all-space texts have fingerprint zero, which links like any other; texts under three words
have one shingle; repeated rows share a fingerprint and so a component; a null doc_id never names a component unless
the whole component has no other id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ID, NO_ID, PROBE, RK, aside, durable, join_split, key_bitmap, keyed, maybe_among, per_batch, shuffle_width, small_batches
from .components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in one tree; larger shards are cut again.
TREE = 256
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, n, _CHUNK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rk, fp) per row: the id (``NO_ID`` for null), the row key and the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t) for t in batch.column("t").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("rk"), pa.array(fps, pa.int64())], names=["id", "rk", "fp"])

    rows = keyed(docs, id_col, text_col).select(F.col(ID).alias("id"), F.col(RK).alias("rk"), F.col(text_col).alias("t"))
    return small_batches(rows).mapInArrow(per_batch(run), "id long, rk long, fp long")


def _masks(bits: list[int], blocks: int, keep: int) -> list[int]:
    """Signed 64-bit masks over the given bit positions: every choice of ``keep`` of ``blocks`` even blocks."""
    parts = np.array_split(np.array(bits), blocks)
    values = [sum(1 << int(b) for i in chosen for b in parts[i]) for chosen in combinations(range(blocks), keep)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _first_cut(radius: int) -> list[int]:
    return _masks(list(range(64)), radius + 3, 3)


def _second_cut(mask: int, radius: int) -> list[int]:
    """Masks over the bits that ``mask`` leaves free, which together leave about eight free."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    blocks = max(radius + 1, int(np.ceil(len(free) * radius / 8)))
    return _masks(free, blocks, blocks - radius)


def _dealt(fps: DataFrame, cut: list[int], name: str, key: str) -> DataFrame:
    """Every row once for each mask: its number and the masked value."""
    choices = F.array(*[F.struct(F.lit(i).alias(name), F.col("fp").bitwiseAND(F.lit(m)).alias(key)) for i, m in enumerate(cut)])
    return fps.select("*", F.inline(choices))


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            distance = (value ^ self.values[at]).bit_count()
            below = self.children[at].setdefault(distance, new)
            if below == new:
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            todo += [c for d, c in self.children[at].items() if -radius <= d - distance <= radius]
        return found


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """(root, member) for each fingerprint of a shard that is linked within it."""
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        unsigned = value & 0xFFFFFFFFFFFFFFFF
        for j in tree.within(unsigned, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(unsigned)
    return [(values[root(i)], values[i]) for i in range(len(values)) if root(i) != i]


def _links_of_sorted(radius: int):
    """mapInArrow over rows sorted by shard: a tree for each run of equal keys."""

    def run(batches):
        key, values = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *k, fp in zip(*columns):
                if k != key:
                    out += shard_links(values, radius)
                    key, values = k, []
                values.append(fp)
            if out:
                yield _edges(out)
                out = []
        out += shard_links(values, radius)
        if out:
            yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect every two distinct fingerprints within the radius, directly or through others."""
    cut = _first_cut(radius)
    members = _dealt(fps.select("fp"), cut, "t", "k")
    sizes = durable(members.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    # a shard may hold most fingerprints: hot shards are looked up by broadcast
    sized = join_split(members, sizes.withColumn("size", F.col("n")), ["t", "k"], "n")
    rows = sized.filter(F.col("size") <= TREE).select("t", "k", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("k2"), "fp")
    large = durable(sized.filter(F.col("size") > TREE).drop("size"), "large")
    if not large.isEmpty():
        for t, mask in enumerate(cut):
            again = _dealt(large.filter(F.col("t") == t), _second_cut(mask, radius), "t2", "k2")
            rows = rows.union(again.select("t", "k", "t2", "k2", "fp"))
    keys = ["t", "k", "t2", "k2"]
    dealt = rows.repartition(shuffle_width(fps.sparkSession), *keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(_links_of_sorted(radius), "a long, b long")


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, rk, fp, component_id) per row, with ``NO_ID`` for null ids."""
    prints = durable(fingerprints(docs, id_col, text_col), "prints")
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "distinct")
    roots = connected_components(fingerprint_links(distinct, radius))
    linked = durable(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    grouped_prints = join_split(linked, durable(least, "least"), ["root"], "prints").select("fp", "rows", "component_id")
    alone = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left_anti").select("fp", "rows", F.col("least").alias("component_id"))
    return join_split(prints, durable(grouped_prints.union(alone), "groups"), ["fp"], "rows")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) per row; component_id is the smallest id reachable over links."""
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return grouped(docs, id_col, text_col, radius).select(null("id").alias(id_col), "fp", null("component_id").alias("component_id"))


def hex_digits(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` without the members of a group but its smallest id. Rows that share id and text share their fate; rows
    that share only the id are judged each in its own group."""
    docs, back = aside(docs, ID, RK, *PROBE)
    lost = grouped(docs, id_col, text_col, radius).filter("id != component_id").select(F.col("id").alias(ID), F.col("rk").alias(RK)).distinct()
    lost = durable(lost, "lost")
    likely, quiet = maybe_among(keyed(docs, id_col, text_col), key_bitmap(lost))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return back(quiet.select(*columns).union(likely.join(lost, [ID, RK], "left_anti").select(*columns)))
