"""Sharding by a k-d tree over the documents' metadata, with shards of near equal bytes.

Rows of equal text form a group, which is what the tree places: its bytes are its weight, and its language, source,
size and least id, scaled to the same range, its coordinates. A node that stands for k shards is cut along its widest
dimension where the bytes before the cut are the left half's part of k, and so on until a leaf stands for one shard.

The cut is a weighted median found over all groups, without a sample: each task adds up the bytes of its groups in
``BINS`` bins of each node's range, the driver sees a row for each bin that holds any, picks the bin where the median
lies, and the next pass divides only that one, until what is left is less than ``SLACK`` of a shard. A coordinate that
many groups share goes on in a hash of the text, so ties can be cut too. A level of the tree takes one pass for the
widths and two or three for the medians, over some 40 bytes a group; the texts are read once.

Groups of over a ``LARGE``-th of a shard are fewer than ``LARGE`` times the shards, whatever the input. The driver
deals them to the two sides in the order of their coordinate as far as both have room, and the cut of all others makes
up for the difference, so a large group neither is torn nor spoils the balance. Only a group that no shard could hold
is torn, by a hash of the id, into pieces of about an eighth of a shard.

Edge cases: null and empty texts are one group and count their row's 16 bytes; rows of equal text stay together
whatever their ids; a document larger than a shard makes its shard larger; with fewer groups than shards some shards
stay empty; an empty table gives an empty one; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ID, durable, join_split, numbered, row_id, with_columns

SHARDS, ROW_BYTES = 40, 16
BINS, LARGE, PIECES, SLACK = 1024, 100, 8, 1 / 2000
DIMS = ("lang", "source", "size", "id")
KEYS = ["__text", "__size", "__piece"]
_SPAN = (1 << 30) - 1


@dataclass
class Node:
    """``shards`` leaves below; once cut, rows of ``dim`` whose place is under ``cut`` go left."""

    shards: int
    first: int  # the first of its shards
    dim: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None
    low: int = 0
    high: int = 0
    before: float = 0  # bytes under ``low``
    wanted: float = 0  # bytes of small groups that should go left
    large: list[dict] = field(default_factory=list)


def _code(col: Column) -> Column:
    """A number that sorts as the first six bytes of a string do."""
    first = F.rpad(F.hex(F.substring(F.encode(F.coalesce(col, F.lit("")), "utf-8"), 1, 6)), 12, "0")
    return F.conv(first, 16, 10).cast("long")


def text_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text and those of a row."""
    return (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + ROW_BYTES).cast("long")


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    other = [(_code(F.col(c)) if c in docs.columns else F.lit(0).cast("long")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_id(id_col).cast("long").alias(ID), text_size(text_col).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(F.lit(17), text).alias("__text"), *other)


def _groups(rows: DataFrame) -> DataFrame:
    """One row a group or piece of a group: its bytes, rows, coordinates and a 32-bit hash for ties."""
    tie = F.xxhash64(F.lit(5), *KEYS).bitwiseAND((1 << 32) - 1)
    found = rows.withColumnRenamed("size", "__size").groupBy(*KEYS).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min(ID).alias("id"))
    return found.withColumns({"size": F.col("__size"), "tie": tie})


def _torn(rows: DataFrame, limit: float) -> DataFrame:
    """``rows`` with ``__piece``: 0, or for groups of over ``limit`` bytes a hash of the id. Such groups are fewer than
    shards, so their keys are broadcast."""
    sums = rows.groupBy("__text", "size").agg(F.sum("size").alias("__bytes")).filter((F.col("__bytes") > limit) & (F.col("__bytes") > F.col("size")))
    pieces = F.ceil(F.col("__bytes") * PIECES / F.lit(limit)).cast("int")
    cut = sums.select("__text", "size", pieces.alias("__pieces"))
    return rows.join(F.broadcast(cut), ["__text", "size"], "left").withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(F.lit(9), ID), F.col("__pieces")), F.lit(0)).cast("int")).drop("__pieces")


def _walk(tree: Node, places: np.ndarray) -> np.ndarray:
    """For each column of ``places`` (a dimension's place a row) the node it ends in, by its place in ``leaves``."""
    out = np.zeros(places.shape[1], np.int64)

    def go(node: Node, at: np.ndarray) -> None:
        if node.left is None:
            out[at] = node.first
            return
        left = places[node.dim][at] < node.cut
        go(node.left, at[left])
        go(node.right, at[~left])

    go(tree, np.arange(places.shape[1]))
    return out


def _leaves(node: Node) -> list[Node]:
    return [node] if node.left is None else _leaves(node.left) + _leaves(node.right)


def _places(batch: pa.RecordBatch) -> np.ndarray:
    """A group's place along each dimension: the coordinate in the upper bits, then the hash."""
    tie = batch.column("tie").to_numpy()
    return np.stack([(batch.column(d).to_numpy() << 32) | tie for d in DIMS])


def _extents(groups: DataFrame, tree: Node) -> list[dict]:
    """For each open node: bytes and, for each dimension, least and largest place."""
    shared = groups.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            places, size = _places(batch), batch.column("bytes").to_numpy()
            node = _walk(shared.value, places)
            for k in np.unique(node).tolist():
                at = node == k
                low, high = places[:, at].min(axis=1), places[:, at].max(axis=1)
                old = met.get(k)
                met[k] = [int(size[at].sum()), low, high] if old is None else [old[0] + int(size[at].sum()), np.minimum(old[1], low), np.maximum(old[2], high)]
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.array([m[0] for m in met.values()], pa.int64()), *(pa.array([m[i][d] for m in met.values()], pa.int64()) for i in (1, 2) for d in range(len(DIMS)))], names=["node", "bytes", *[f"{e}{d}" for e in ("low", "high") for d in range(len(DIMS))]])

    ends = [f"{e}{d}" for e in ("low", "high") for d in range(len(DIMS))]
    parts = groups.select("tie", "bytes", *DIMS).mapInArrow(run, "node int, bytes long, " + ", ".join(f"{e} long" for e in ends))
    return [r.asDict() for r in parts.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[(F.min if e[0] == "l" else F.max)(e).alias(e) for e in ends]).collect()]


def _bins(groups: DataFrame, tree: Node, spans: dict[int, tuple[int, int, int]]) -> dict[int, list]:
    """For each node of ``spans`` (dimension, low, high): (bytes, least and largest place) of the bins of its range
    that hold anything, in order."""
    shared = groups.sparkSession.sparkContext.broadcast((tree, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, spans = shared.value
        met: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            places, size = _places(batch), batch.column("bytes").to_numpy()
            node = _walk(tree, places)
            for k in np.unique(node).tolist():
                if k not in spans:
                    continue
                dim, low, high = spans[k]
                at = (node == k) & (places[dim] >= low) & (places[dim] <= high)
                place, weight = places[dim][at], size[at]
                sums = met.setdefault(k, [np.zeros(BINS, np.int64), np.full(BINS, np.iinfo(np.int64).max), np.full(BINS, -1, np.int64)])
                bin_ = (place - low) // ((high - low) // BINS + 1)
                np.add.at(sums[0], bin_, weight)
                np.minimum.at(sums[1], bin_, place)
                np.maximum.at(sums[2], bin_, place)
        for k, (total, low, high) in met.items():
            at = np.flatnonzero(high >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at]), pa.array(low[at]), pa.array(high[at])], names=["node", "bin", "bytes", "low", "high"])

    parts = groups.select("tie", "bytes", *DIMS).mapInArrow(run, "node int, bin int, bytes long, low long, high long")
    found: dict[int, list] = {}
    for r in parts.groupBy("node", "bin").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("node", "bin").collect():
        found.setdefault(r.node, []).append((r.bytes, r.low, r.high))
    return found


def _deal(large: list[dict], dim: int, room: tuple[float, float]) -> tuple[list[dict], list[dict]]:
    """Large groups to two sides, in the order of their place; the largest first where that order overfills a side."""
    total, sides, sums = sum(g["bytes"] for g in large), ([], []), [0, 0]
    part = total * room[0] / (room[0] + room[1]) if total else 0
    for g in sorted(large, key=lambda g: g["places"][dim]):
        side = 0 if sums[0] + g["bytes"] / 2 <= part else 1
        sides[side].append(g)
        sums[side] += g["bytes"]
    if sums[0] <= room[0] and sums[1] <= room[1]:
        return sides
    sides, sums = ([], []), [0, 0]
    for g in sorted(large, key=lambda g: (-g["bytes"], g["places"][dim])):
        side = 0 if room[0] - sums[0] >= room[1] - sums[1] else 1
        sides[side].append(g)
        sums[side] += g["bytes"]
    return sides


def grow(small: DataFrame, large: list[dict], shards: int) -> Node:
    """The tree over ``small`` groups; its leaves carry the ``large`` ones dealt to them."""
    tree = Node(shards, 0, large=large)
    while open_ := {n.first: n for n in _leaves(tree) if n.shards > 1}:
        extents = {e["node"]: e for e in _extents(small, tree)}
        cuts: dict[int, Node] = {}
        sides: dict[int, tuple[list[dict], list[dict]]] = {}
        for k, node in open_.items():
            e = extents.get(k)
            weight = e["bytes"] if e else 0
            low = [e[f"low{d}"] if e else 0 for d in range(len(DIMS))]
            high = [e[f"high{d}"] if e else 0 for d in range(len(DIMS))]
            node.dim = max(range(len(DIMS)), key=lambda d: ((high[d] >> 32) - (low[d] >> 32), -d))
            node.low, node.high, node.before = low[node.dim], high[node.dim], 0
            total = weight + sum(g["bytes"] for g in node.large)
            left = total * (node.shards // 2) / node.shards
            sides[k] = _deal(node.large, node.dim, (left, total - left))
            node.wanted = min(max(left - sum(g["bytes"] for g in sides[k][0]), 0), weight)
            node.cut = node.low
            if weight and node.wanted >= weight:
                node.cut = node.high + 1
            elif node.wanted > 0:
                cuts[k] = node
        slack = SLACK * sum(e["bytes"] for e in extents.values()) / shards
        while cuts:
            met = _bins(small, tree, {k: (n.dim, n.low, n.high) for k, n in cuts.items()})
            for k, node in list(cuts.items()):
                for weight, low, high in met[k]:
                    if node.before + weight > node.wanted:
                        break
                    node.before += weight
                over = node.before + weight - node.wanted
                if weight <= slack or low == high:
                    node.cut = low if node.wanted - node.before <= over else high + 1
                    del cuts[k]
                else:
                    node.low, node.high = low, high
        for k, node in open_.items():
            half = node.shards // 2
            node.left, node.right = Node(half, node.first, large=sides[k][0]), Node(node.shards - half, node.first + half, large=sides[k][1])
            node.large = []
    return tree


def _scaled(groups: DataFrame) -> DataFrame:
    """Coordinates on one scale, 0 to 2^30 - 1, so that widths compare."""
    ends = groups.agg(*[f(d).alias(f"{n}_{d}") for d in DIMS for n, f in (("low", F.min), ("high", F.max))]).first()
    low = {d: ends[f"low_{d}"] or 0 for d in DIMS}
    wide = {d: max((ends[f"high_{d}"] or 0) - low[d], 1) for d in DIMS}
    return groups.withColumns({d: F.least(F.lit(_SPAN), F.floor((F.col(d) - low[d]).cast("double") / wide[d] * _SPAN)).cast("long") for d in DIMS})


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per row of ``docs``, for so many shards, or as many as reach
    ``target_bytes`` each. ``slot`` counts a shard's rows from 0, by id."""
    rows = durable(_rows(docs, id_col, text_col, lang_col, source_col), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = max(1, shards or -(-total // max(target_bytes or total, 1)))
    rows = durable(_torn(rows, total / shards or 1), "torn")
    groups = durable(_scaled(durable(_groups(rows), "groups")), "scaled")
    limit = total / shards / LARGE
    is_large = F.col("bytes") > limit
    large = [r.asDict() for r in groups.filter(is_large).collect()]  # fewer than LARGE times the shards
    for g in large:
        g["places"] = [(g[d] << 32) | g["tie"] for d in DIMS]
    small = groups.filter(~is_large)
    tree = grow(small, large, shards)
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield with_columns(batch, shard=pa.array(_walk(shared.value, _places(batch)).astype(np.int32)))

    dealt = [(*[g[k] for k in KEYS], g["n"], leaf.first) for leaf in _leaves(tree) for g in leaf.large]
    by_tree = small.mapInArrow(run, f"{kinds}, shard int").select(*KEYS, "n", "shard")
    placed = by_tree.union(docs.sparkSession.createDataFrame(dealt, "__text long, __size long, __piece int, n long, shard int"))
    found = join_split(rows.withColumnRenamed("size", "__size"), durable(placed, "shards"), KEYS, "n")
    found = found.select("doc_id", ID, F.col("__size").alias("size"), "text_crc32", "shard")
    return numbered(found, "shard", [F.col(ID)], "slot").select(F.col("doc_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", files: int = 1, **columns: str) -> None:
    """``docs`` as Parquet under ``path``, one folder a shard, ``files`` files in each. A text's shard is found by its
    row again, so that the texts are shuffled once only."""
    where = kd_shards(docs, shards, target_bytes, id_col, text_col, **columns)
    ids = where.groupBy(row_id(id_col).alias(ID), "size", "text_crc32").agg(F.min("shard").alias("shard"), F.count(F.lit(1)).alias("__n"))
    keyed = docs.withColumns({ID: row_id(id_col), "__size": text_size(text_col), "__crc": F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8"))})
    lookup = durable(ids.select(ID, F.col("size").alias("__size"), F.col("text_crc32").alias("__crc"), "shard", "__n"), "where")
    joined = join_split(keyed, lookup, [ID, "__size", "__crc"], "__n")
    spread = joined.repartition(F.col("shard"), F.pmod(F.xxhash64(ID, "__crc"), F.lit(files))).drop(ID, "__size", "__crc")
    spread.write.partitionBy("shard").parquet(path)
