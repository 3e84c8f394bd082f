"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

#: Edges that one task of a round takes at least.
TASK_EDGES = 200_000


def _large_star(edges: DataFrame, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (itself included)."""
    both = edges.union(edges.select(F.col("dst"), F.col("src")))
    low = common.written(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low")).coalesce(parts), "lowest")
    out = common.written(both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).coalesce(parts), "links")
    return out, [low]


def _small_star(edges: DataFrame, parts: int) -> tuple[DataFrame, list[DataFrame]]:
    """Every smaller neighbour of a node, and the node, are linked to its smallest neighbour."""
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = common.written(down.groupBy("src").agg(F.min("dst").alias("low")).coalesce(parts), "lowest")
    moved = down.join(low, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    out = common.written(moved.union(low.select("src", F.col("low").alias("dst"))).where("src <> dst").distinct().coalesce(parts), "links")
    return out, [low, edges]


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, component: the smallest node reachable, for each node of ``edges`` (src, dst; longs).

    Nothing is collected: each round is written to the shared folder, and the
    loop ends when a round leaves all edges as they were (count and hash sum). Smallest neighbours are
    written before they are joined, so that a node with very many neighbours is a skewed side of a plain join,
    which adaptive execution can split.
    """
    now = common.written(edges.where("src <> dst").select("src", "dst"), "links")
    limit = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(limit, -(-now.count() // TASK_EDGES)))  # edges only get fewer
    sign = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    before = None
    for _ in range(most):
        state = sign(now)
        if state == before or not state[0]:
            break
        before = state
        large, spent = _large_star(now, parts)
        after, more = _small_star(large, parts)
        for table in (now, *spent, *more):
            common.forget(table)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(now.select("dst", "dst")).distinct()
