"""Connected components of an edge table, as joins and aggregates.

Large-star and small-star steps alternate: each node's neighbours are re-linked to the smallest of them, until
every node hangs on its root. Minima are pre-aggregated before the shuffle, and the joins put a node's edges
beside its minimum one row each. From ``SPLIT`` edges on, minima are written before they are joined: with no aggregate
left in the join's stage, Spark splits a node with very many neighbours as any skewed key. Each round is written to the
shared folder and read again; the last but one is then deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberloom.llm import scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


#: Edges up to which the node with the most of them is no burden for one task.
SPLIT = 200_000


def _apart(low: DataFrame, n: int) -> DataFrame:
    return scratch.stash(low, "low").hint("merge") if n > SPLIT else low


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = _apart(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
    return both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    if n > SPLIT:
        edges = scratch.stash(edges, "large")
    low = _apart(edges.groupBy("u").agg(F.min("v").alias("m")), n)
    moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node of the edges (``a``, ``b``), a < b."""
    now = scratch.stash(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), "edges")
    state = _state(now)
    while state[0]:
        step = scratch.stash(_small(_large(now, state[0]), state[0]), "edges")
        was, state = state, _state(step)
        scratch.drop(now)
        now = step
        if state == was:
            break
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(leaves.select("root", "root").distinct())
