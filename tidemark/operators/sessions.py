"""Sessions of a key: runs of rows with no pause longer than a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import bucketed
from tidemark.runtime import attach, materialize


def _sums(names: Sequence[str]) -> list[Column]:
    return [F.sum(c).alias(c) for c in names]


def sessions(df: DataFrame, at: str, by: Sequence[str], gap: str, sums: Sequence[str] = (),
             buckets: int | None = None) -> DataFrame:
    """One row per session: key, session_start, session_end, events and the `sums` columns added up.

    A row belongs to the session before it if it comes at most `gap` (an interval such as
    "30 minutes") after that session's last row. session_end is the last row's time
    plus the gap. Rows with NULL in key or time take no part; repeated rows count.

    Spark's own session window sorts all rows of a key in one task. Here equal times
    of a key collapse on the map side, and the times are cut into ordered buckets that learn
    the last row and the last start before them, so a hot key spreads over tasks.
    """
    by, up_to = list(by), Window.unboundedPreceding
    known = F.col(at).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    times = materialize(df.where(known).groupBy(*by, F.col(at).alias("_at")).agg(
        F.count(F.lit(1)).alias("events"), *_sums(sums)))
    placed = bucketed(times, "_at", by, buckets)
    inside, below = Window.partitionBy(*by, "_bucket").orderBy("_at"), Window.partitionBy(*by).orderBy("_bucket")
    ends = placed.groupBy(*by, "_bucket").agg(F.max("_at").alias("_last"))
    ends = ends.select(*by, "_bucket", F.lag("_last").over(below).alias("_carried"))
    before = F.coalesce(F.lag("_at").over(inside), F.col("_carried"))
    opens = before.isNull() | (F.col("_at") > before + F.expr(f"interval {gap}"))
    marked = materialize(attach(placed, ends, [*by, "_bucket"]).withColumn("_opened", F.when(opens, F.col("_at"))).drop("_carried"))
    starts = marked.groupBy(*by, "_bucket").agg(F.max("_opened").alias("_opened")).select(
        *by, "_bucket", F.last("_opened", ignorenulls=True).over(below.rowsBetween(up_to, -1)).alias("_carried"))
    start = F.coalesce(F.last("_opened", ignorenulls=True).over(inside.rowsBetween(up_to, 0)), F.col("_carried"))
    return (attach(marked, starts, [*by, "_bucket"]).withColumn("session_start", start).groupBy(*by, "session_start")
            .agg((F.max("_at") + F.expr(f"interval {gap}")).alias("session_end"), F.sum("events").alias("events"), *_sums(sums)))
