"""Connected components of an edge table by alternating large-star and small-star steps.

Each round links every node's larger neighbours, then all its neighbours, to the smallest node it knows, until the edges
are stars.  Every round's edges are written to the shared folder, so lineage stays short and lost executors cost one
round.  Neighbourhoods are only ever reduced to their minimum (with map-side combination), never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

MAX_ROUNDS = 60
#: A node of so many edges is hot; with more edges in all, of one in SPLIT, so that at most 2 * SPLIT nodes are.
HOT, SPLIT = 1024, 8192


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _to_least(edges: DataFrame, low: DataFrame, hot: int) -> DataFrame:
    """``edges`` with ``m`` of their node ``a`` from ``low`` (``a``, ``m``, ``n``, one row a node).  The edges of hot nodes stay where
    they are and meet a broadcast list of at most 2 * SPLIT nodes; only those of the others are shuffled."""
    few = F.broadcast(low.filter(F.col("n") > hot).select("a", "m"))
    rest = edges.join(few.select("a"), "a", "left_anti").join(low.filter(F.col("n") <= hot).select("a", "m"), "a")
    return edges.join(few, "a").unionByName(rest)


def _star(edges: DataFrame, small: bool, hot: int) -> DataFrame:
    """Edges are (a, b) with a > b.  small: neighbours not above the node; else those above it."""
    if small:
        low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        moved = _to_least(edges, low, hot).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = low.select("a", F.col("m").alias("b"))
        return moved.unionByName(kept).distinct()
    both = _both(edges)
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _to_least(both.filter("b > a"), low, hot).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for every node of an edge; columns ``a``, ``b`` of any ordered type."""
    now = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        hot = max(HOT, state[0] // SPLIT)
        large = materialize(_star(now, False, hot), "edges")
        after = materialize(_star(large, True, hot), "edges")
        release(large)
        release(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
