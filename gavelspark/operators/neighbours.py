"""The most similar vectors of every vector, exactly, by blocks of neighbouring cells and the triangle inequality.

Vectors are taken to unit length, so that cosine and distance order alike. Some of them, by a hash of the id, are
centroids (``CENTROIDS`` at most, broadcast); every vector lies in the cell of its nearest one. Vectors in the order of
their cells are packed into blocks of at most ``BLOCK``, one row each, and a block's own members first bound how far the
k-th neighbour of each can be. Then every block meets every block in a Cartesian product of the packed rows, which
shuffles nothing: a task keeps the best of one block of vectors at a time while the blocks of a share of the others pass
by. A cell whose ball is farther than a vector's bound is not compared with it. What a task holds and hands on does not
depend on how many cells a vector may reach; all pairs are compared where the vectors leave no cell out of reach.
Rows whose vector is null, empty, zero or not finite have no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .stable import pinned

#: Blocks of a task's share of the others at most, beyond ``SHARES`` shares.
CENTROIDS, BLOCK, SHARES, VISITORS = 1000, 4096, 12, 32
#: Vectors whose scores are held at a time, and how far a score of the matrix product may lie from a pair's own.
_ROWS, _SLACK = 256, 1e-9
_PACKED = "ids binary, vectors binary, cells binary, away binary, bound binary"
_FOUND = "id long, others array<long>, scores array<double>, compared long"


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


class _Best:
    """The k best neighbours of a block's vectors so far, best first, then by id."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, least: float) -> None:
        self.ids, self.v, self.k = ids, v, k
        self.others, self.scores = np.full((len(v), k), -1, np.int64), np.full((len(v), k), -np.inf)
        self.floor, self.least = np.full(len(v), least), least  # a neighbour scores this at least
        self.compared = 0

    def meet(self, at: np.ndarray, others: np.ndarray, m: np.ndarray) -> None:
        """Vectors number ``at`` against members."""
        self.compared += len(at) * len(m)
        for first in range(0, len(at), _ROWS):
            rows = at[first : first + _ROWS]
            scores = self.v[rows] @ m.T
            scores[others[None, :] == self.ids[rows, None]] = -np.inf
            able = scores >= self.floor[rows, None] - _SLACK
            if (many := np.flatnonzero(able.sum(axis=1) > 4 * self.k)).size:
                kth = np.partition(scores[many], len(m) - self.k, axis=1)[:, len(m) - self.k] - _SLACK
                able[many] &= scores[many] >= kth[:, None]
            r, c = np.nonzero(able)
            if len(r):
                self._take(rows[r], others[c], m, c)

    def _take(self, r: np.ndarray, others: np.ndarray, m: np.ndarray, c: np.ndarray) -> None:
        # a pair's score by its own two vectors alone, so that copies tie wherever they lie
        found = np.concatenate([(self.v[r[i : i + 65536]] * m[c[i : i + 65536]]).sum(axis=1) for i in range(0, len(r), 65536)])
        keep = found >= self.least
        touched = np.unique(r[keep])
        old = np.repeat(touched, self.k)
        r, others, found = (np.concatenate(x) for x in ((r[keep], old), (others[keep], self.others[touched].ravel()), (found[keep], self.scores[touched].ravel())))
        order = np.lexsort((others, -found, r))
        r, others, found = r[order], others[order], found[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        top = place < self.k
        self.others[r[top], place[top]], self.scores[r[top], place[top]] = others[top], found[top]
        self.floor[touched] = np.maximum(self.floor[touched], self.scores[touched, self.k - 1])

    def reach(self) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * self.floor, 0))

    def rows(self) -> pa.RecordBatch:
        sizes = (self.others >= 0) | np.isfinite(self.scores)
        ends = np.concatenate([[0], sizes.sum(axis=1).cumsum()]).astype(np.int32)
        compared = np.zeros(len(self.ids), np.int64)
        compared[:1] = self.compared
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[sizes])) for x in (self.others, self.scores)]
        return pa.RecordBatch.from_arrays([pa.array(self.ids), *lists, pa.array(compared)], names=["id", "others", "scores", "compared"])


def _pack(k: int, least: float, size: int):
    """Rows in the order of their cells as packed blocks, each vector with the least score of a neighbour as far as its
    own block tells."""

    def block(rows: pd.DataFrame) -> pa.RecordBatch:
        ids, v = rows["id"].to_numpy(np.int64), _matrix(rows["v"])
        own = _Best(ids, v, k, least)
        own.meet(np.arange(len(v)), ids, v)
        values = (ids, v, rows["cell"].to_numpy(np.int32), rows["away"].to_numpy(np.float64), own.floor)
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in values], names=["ids", "vectors", "cells", "away", "bound"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            rows = batch.to_pandas()
            while len(rows):
                held.append(rows[: size - n])
                n, rows = n + len(held[-1]), rows[size - n :]
                if n == size:
                    yield block(pd.concat(held))
                    held, n = [], 0
        if held:
            yield block(pd.concat(held))

    return run


def _compare(k: int, least: float, shared):
    """Pairs of packed blocks, those of one block of vectors one after another."""

    def met(best: _Best, row: dict, centres: np.ndarray) -> None:
        others, cells, away = (np.frombuffer(row[n], t) for n, t in (("m_ids", np.int64), ("m_cells", np.int32), ("m_away", np.float64)))
        m = np.frombuffer(row["m_vectors"], np.float64).reshape(len(others), -1)
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        high, low = np.maximum.reduceat(away, first), np.minimum.reduceat(away, first)
        far = np.sqrt(np.maximum(2 - 2 * (best.v @ centres[cells[first]].T), 0))
        # 1e-6: near a centroid, a distance taken from a cosine is as rough as the root of its last digits
        reach = best.reach()[:, None] + 1e-6
        able = (far - high <= reach) & (low - far <= reach)
        if able.mean() > 0.5:
            return best.meet(np.flatnonzero(able.any(axis=1)), others, m)
        last = np.append(first[1:], len(others))
        for i in np.flatnonzero(able.any(axis=0)):
            best.meet(np.flatnonzero(able[:, i]), others[first[i] : last[i]], m[first[i] : last[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, of = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_buffer() for n in batch.schema.names}
                if of is None or not row["ids"].equals(of):
                    if best is not None:
                        yield best.rows()
                    of = pa.py_buffer(row["ids"].to_pybytes())
                    ids = np.frombuffer(of, np.int64)
                    best = _Best(ids, np.frombuffer(row["vectors"].to_pybytes(), np.float64).reshape(len(ids), -1), k, least)
                    best.floor = np.frombuffer(row["bound"], np.float64).copy()
                met(best, row, shared.value)
        if best is not None:
            yield best.rows()

    return run


def all_neighbours(vectors: DataFrame, id_col: str, vector_col: str = "embedding", k: int = 12, least: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """((id, other, score, rank) of at most ``k`` neighbours of at least ``least`` each, (compared, pairs): how many
    pairs were compared, and how many there are)."""
    length = F.sqrt(F.aggregate(vector_col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    sound = F.coalesce(F.size(vector_col) > 0, F.lit(False)) & F.coalesce(~F.exists(vector_col, lambda x: x.isNull()), F.lit(False))
    unit = vectors.filter(sound).withColumn("__n", length).filter((F.col("__n") > 0) & (F.col("__n") < float("inf")))
    unit = pinned(unit.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double") / F.col("__n")).alias("v")))
    n = unit.count()
    few = max(1, min(CENTROIDS, int(n**0.5)))
    seeds = unit.orderBy(F.xxhash64("id"), "id").limit(few).toPandas()
    centres = _matrix(seeds["v"]) if len(seeds) else np.zeros((1, 1))
    shared = unit.sparkSession.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                away = np.sqrt(np.maximum(2 - 2 * (_matrix(batch["v"]) @ shared.value.T), 0))
                cell = away.argmin(axis=1)
                yield pd.DataFrame({"id": batch["id"], "v": batch["v"], "cell": cell.astype(np.int32), "away": away[np.arange(len(cell)), cell]})

    blocks = max(1, -(-n // BLOCK))
    placed = unit.mapInPandas(nearest, "id long, v array<double>, cell int, away double")
    # by the hash as well, so that a cell of many copies is cut
    order = ["cell", F.xxhash64("id"), "id"]
    packed = pinned(placed.repartitionByRange(blocks, *order).sortWithinPartitions(*order).mapInArrow(_pack(k, least, BLOCK), _PACKED))
    members = packed.select(*[F.col(c).alias(f"m_{c}") for c in ("ids", "vectors", "cells", "away")]).coalesce(max(SHARES, blocks // VISITORS))
    pairs = packed.select("ids", "vectors", "bound").hint("shuffle_replicate_nl").crossJoin(members)
    found = pinned(pairs.mapInArrow(_compare(k, least, shared), _FOUND))
    every = found.groupBy("id").agg(F.flatten(F.collect_list(F.transform(F.arrays_zip("others", "scores"), lambda x: F.struct((-x["scores"]).alias("s"), x["others"].alias("other"))))).alias("all"))
    best = every.select("id", F.posexplode(F.slice(F.array_sort("all"), 1, k)).alias("place", "x"))
    best = best.select("id", F.col("x.other").alias("other"), (-F.col("x.s")).alias("score"), (F.col("place") + 1).alias("rank"))
    return best, found.agg(F.sum("compared").alias("compared"), F.lit(n * n).alias("pairs"))
