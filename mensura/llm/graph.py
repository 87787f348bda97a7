"""Connected components by alternating large-star and small-star rounds, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, cut, spread_join


def _least(pairs: DataFrame, hot: list) -> DataFrame:
    """pairs (u, v) with m, the least v of its u. The least is found by a partial aggregate; hubs are dealt over tasks."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return spread_join(pairs, least, ["u"], hot, by=F.xxhash64("v"))


def _large_star(edges: DataFrame, hot: list) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, hot).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(down: DataFrame, hot: list) -> DataFrame:
    """down: u over v in every row. A node's least neighbour takes its others, and the node."""
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return _least(down, hot).select(moved.alias("u"), F.col("m").alias("v")).distinct()


def _measured(edges: DataFrame, most: float) -> tuple[tuple, list]:
    """((edges, sum of their hashes), nodes with over `most` edges), in one pass; there are 2 edges / most such nodes at most."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), F.xxhash64("u", "v").cast("decimal(38,0)").alias("x"))
    counted = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    n, x, hot = counted.agg(F.sum("n"), F.sum("x"), F.collect_list(F.when(F.col("n") > most, F.col("node")))).first()
    return (n, x), hot


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge, root being the least node of its component.

    edges: columns u, v of one orderable type. Loops and repeated edges are harmless, null ends are
    ignored, no edges give no rows. Every round reads a checkpoint of the last, so that the lineage
    stays short and a lost executor costs one round at most. Hubs, which the rounds make, are dealt over tasks.
    """
    current = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    mark, hot = _measured(current, 2 * current.count() / HOT_SHARE)
    for _ in range(rounds):
        current = cut(_small_star(_large_star(current, hot), hot))
        last = mark
        mark, hot = _measured(current, (mark[0] or 0) / HOT_SHARE)
        if last == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    stars = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
