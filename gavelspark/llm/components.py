"""Distributed connected components by repeated contraction.

Each round every node picks the neighbour (or itself) of least priority, a hash that changes with the round; edges are
rewritten to the picked nodes, and loops and duplicates fall away. Random priorities shrink even a long chain by a
constant share per round, so the number of rounds grows with the logarithm of the largest component. Afterwards the
picks of the rounds are composed from the last, smallest one back to the first. Nothing but "is an edge left?" and row
counts reach the driver. Picks are plain minimum aggregations (combined before the shuffle); picks of nodes with very
many edges, and roots that very many nodes picked, are broadcast, so that no single task gathers what holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, join_split


def _rank(col: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.lit(turn), F.col(col)).alias("h"), F.col(col).alias("node"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node that has an edge; root is one node of its component, the same for all of it.

    Nodes are longs; loops, repeated and reversed edges are fine; an empty table gives an empty one.
    """
    live = durable(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        turn = len(rounds)
        both = live.union(live.select("v", "u"))
        picks = both.groupBy("u").agg(F.min(_rank("v", turn)).alias("least"), F.count(F.lit(1)).alias("edges"))
        picks = durable(picks.select("u", F.least("least", _rank("u", turn)).getField("node").alias("p"), "edges"), "picks")
        pu, pv = picks.select("u", F.col("p").alias("a"), "edges"), picks.select(F.col("u").alias("v"), F.col("p").alias("b"), "edges")
        live = durable(join_split(join_split(live, pu, ["u"], "edges"), pv, ["v"], "edges").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u != v").distinct(), "edges")
        rounds.append(picks.select("u", "p"))
    if not rounds:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = rounds.pop().select(F.col("u").alias("node"), F.col("p").alias("root"))
    for picks in reversed(rounds):
        held = picks.groupBy("p").agg(F.count(F.lit(1)).alias("nodes"))
        step = durable(found.withColumnRenamed("node", "p").join(held, "p"), "steps")
        found = durable(join_split(picks, step, ["p"], "nodes", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root")), "components")
    return found
