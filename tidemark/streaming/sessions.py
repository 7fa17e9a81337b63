"""Sessions over a stream, closed by the watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_stream(stream: DataFrame, at: str, by: Sequence[str], gap: str, lateness: str,
                   sums: Sequence[str] = ()) -> DataFrame:
    """The columns of `operators.sessions.sessions`, each session once it is closed.

    A session is given out when the watermark, the latest time seen less `lateness`, has
    passed its end; rows behind the watermark are dropped, and its state is released. Open
    sessions stay in the state. The time is a timestamp. Sessions are merged in each task
    before the shuffle if spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition is set.
    """
    known = stream.where(F.col(at).isNotNull()).dropna(subset=list(by)).withWatermark(at, lateness)
    grouped = known.groupBy(*by, F.session_window(at, gap).alias("_session")).agg(
        F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(c) for c in sums])
    return grouped.select(*by, F.col("_session.start").alias("session_start"), F.col("_session.end").alias("session_end"),
                          "events", *sums)


def write_available(rows: DataFrame, target: str, checkpoint: str) -> None:
    """Process all files that have arrived and add the finished rows to a Parquet table.

    The checkpoint keeps state and progress: a repeated or resumed run goes on from it and
    adds nothing twice.
    """
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start().awaitTermination()
