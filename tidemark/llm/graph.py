"""Connected components of an edge table, and joins against checked small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize

# A side of plain keys is broadcast up to this many rows (16 to 40 bytes each).
KEY_ROWS = 500_000


def small(keys: DataFrame, max_rows: int = KEY_ROWS) -> DataFrame:
    """Mark a stored side for broadcast if its counted rows allow it.

    Beyond the bound it is returned as it is: the join shuffles, and AQE splits
    hot keys.
    """
    return F.broadcast(keys) if keys.limit(max_rows + 1).count() <= max_rows else keys


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the least node.

    Alternates the large-star and small-star steps: neighbours are tied to the
    least node of a neighbourhood until only stars are left, in a number of
    rounds that grows with the logarithm of the longest path. A neighbourhood is
    never gathered: its least node is an aggregate with map-side combining, and
    the join back may be split. Self-loops and repeated edges are allowed; no
    edges give no rows.
    """
    edges = materialize(_down(edges.select("a", "b")))
    seen = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = _down(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a")
        edges = materialize(_down(
            down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))))
        now = _state(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component")))


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the greater to the lesser node."""
    return (edges.where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first()
    return tuple(row)
