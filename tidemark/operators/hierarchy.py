"""Roll-ups over a hierarchy of any depth, given as rows of (node, parent)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import stage

MOST_LEVELS = 64


def ancestors(nodes: DataFrame, node: str, parent: str, most_levels: int = MOST_LEVELS) -> DataFrame:
    """(node, ancestor, distance) for every node and all above it, itself at distance 0.

    One equi-join a level, over the nodes that still have something above them;
    levels are written, so a lost executor repeats one of them only. A parent that
    is no node ends the path and is not an ancestor. NULL nodes have no rows, repeated rows
    count once. A hierarchy of more than `most_levels` levels, or with a cycle, raises ValueError.
    """
    above = stage(nodes.where(F.col(node).isNotNull())
                  .select(F.col(node).alias("node"), F.col(parent).alias("parent")).distinct())
    steps = above.join(above.select(F.col("node").alias("parent")).distinct(), "parent").select("node", "parent")
    steps = stage(steps)
    levels = [above.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance")).distinct()]
    level = steps.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    up = steps.select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    for _ in range(most_levels):
        level = stage(level)
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(level)
        level = (level.join(up, "ancestor")
                 .select("node", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance")))
    raise ValueError(f"more than {most_levels} levels, or a cycle")


def roll_up(nodes: DataFrame, node: str, parent: str, amounts: DataFrame, amount: str) -> DataFrame:
    """(node, own, total, below): a node's own amount, with all below it, and how many nodes are below.

    `amounts` has rows of (node, amount), any number a node; they are summed per
    node first. Nodes without amounts have 0, amounts of unknown nodes are left out.
    """
    own = amounts.groupBy(F.col(node).alias("node")).agg(F.sum(amount).alias("own"))
    paths = ancestors(nodes, node, parent).join(own, "node", "left")
    mine = F.when(F.col("distance") == 0, F.col("own"))
    return (paths.groupBy(F.col("ancestor").alias("node"))
            .agg(F.coalesce(F.sum(mine), F.lit(0)).alias("own"), F.coalesce(F.sum("own"), F.lit(0)).alias("total"),
                 (F.count_if(F.col("distance") > 0)).alias("below")))
