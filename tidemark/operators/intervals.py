"""As-of and interval joins.

Neither tests pairs within a key. The as-of join merges both sides' times and
carries the last match through time-ordered buckets cut by the data, so a hot key
is spread over as many tasks as it has times. The interval join is an equi-join on
time cells as wide as the interval, so the pairs it tests grow with those it finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranks import bucketed
from tidemark.runtime import attach, materialize


def _present(df: DataFrame, cols: Sequence[str]) -> Column:
    test = F.lit(True)
    for c in cols:
        test = test & F.col(c).isNotNull()
    return test


def asof_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, by: Sequence[str],
              values: Sequence[str], ties: Sequence[str] = (), direction: str = "backward",
              matched_at: str | None = None, buckets: int | None = None) -> DataFrame:
    """Every left row with `values` of the last right row of its key at or before its time.

    `direction="forward"` takes the first right row at or after it. Among right rows of
    one key and time the highest by `ties`, then by `values`, counts, so repeated rows
    change nothing. A left row without a match, or with a NULL in key or time, keeps
    NULL values; right rows with one are left out. `matched_at` names a column for the
    time of the match. Both time columns are of one type.

    Times of a key are reduced to distinct ones on the map side before anything is
    shuffled by them, and each bucket of times receives what the buckets before it end with.
    """
    by, forward = list(by), direction == "forward"
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction}")
    payload = F.struct(F.col(right_at).alias("_found"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)],
                       *[F.col(c).alias(f"_v{i}") for i, c in enumerate(values)])
    offers = right.where(_present(right, [*by, right_at])).groupBy(*by, F.col(right_at).alias("_at")).agg(
        F.max(payload).alias("_offer"), F.lit(False).alias("_asked"))
    asks = left.where(_present(left, [*by, left_at])).groupBy(*by, F.col(left_at).alias("_at")).agg(
        F.lit(None).cast(offers.schema["_offer"].dataType).alias("_offer"), F.lit(True).alias("_asked"))
    times = materialize(asks.unionByName(offers).groupBy(*by, "_at").agg(
        F.max("_offer").alias("_offer"), F.max("_asked").alias("_asked")))

    placed = bucketed(times, "_at", by, buckets)
    at, bucket = (F.col(c).desc() if forward else F.col(c) for c in ("_at", "_bucket"))
    ends = placed.groupBy(*by, "_bucket").agg((F.min if forward else F.max)("_offer").alias("_end"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_end", F.last("_end", ignorenulls=True).over(before))
    inside = Window.partitionBy(*by, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    matches = attach(placed, carried, [*by, "_bucket"]).withColumn(
        "_offer", F.coalesce(F.last("_offer", ignorenulls=True).over(inside), F.col("_end"))).where("_asked")
    found = [F.col(f"_offer._v{i}").alias(c) for i, c in enumerate(values)]
    if matched_at:
        found.append(F.col("_offer._found").alias(matched_at))
    return attach(left.withColumn("_at", F.col(left_at)), matches.select(*by, "_at", *found), [*by, "_at"]).drop("_at")


def _axis(df: DataFrame, col: str) -> Column:
    """A time or whole number as a long; a time without zone is read as it stands, whatever the session's zone."""
    kind, days = dict(df.dtypes)[col], F.unix_date(F.to_date(col)).cast("long")
    if kind == "date":
        return days
    if kind == "timestamp_ntz":
        seconds = (days * 24 + F.hour(col)) * 3600 + F.minute(col) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), col) * 1_000_000).cast("long")
    return F.unix_micros(col) if kind == "timestamp" else F.col(col).cast("long")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str,
                  by: Sequence[str] = (), salts: int = 1) -> DataFrame:
    """All pairs of a point and an interval [start, end) of its key that contains it.

    Columns of both sides but for the key of the intervals, so their other names are to
    differ. Dates, timestamps and whole numbers. Repeated rows pair like others; NULL in
    a key or a bound, and intervals that are empty or end before they start, pair with nothing.

    An interval of length up to 2^k lies in one or two cells of width 2^k, and a point in
    one cell for each k that occurs: at most 64 of them, each next to intervals more than half as
    long as the cell. `salts` deals the points of a cell to so many tasks and repeats
    its intervals for each, for cells that stay hot; without it AQE splits them.
    """
    by = list(by)
    known = intervals.where(_present(intervals, [*by, start, end])).withColumns(
        {"_start": _axis(intervals, start), "_end": _axis(intervals, end)}).where("_start < _end")
    # the least k with 2^k >= length: the binary digits of length - 1
    digits = F.length(F.bin(F.col("_end") - F.col("_start") - 1))
    known = known.withColumn("_k", F.when(F.col("_end") - F.col("_start") == 1, 0).otherwise(digits))
    classes = [r[0] for r in known.select("_k").distinct().orderBy("_k").collect()]
    first, last = (F.expr(f"shiftright({e}, _k)") for e in ("_start", "_end - 1"))
    cells = known.withColumn("_cell", F.explode(F.array_distinct(F.array(first, last))))
    cells = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marks = [F.struct(F.lit(k).alias("_k"), F.shiftright(_axis(points, at), k).alias("_cell")) for k in classes]
    if not marks:
        marks = [F.struct(F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_cell"))]
    asked = points.where(_present(points, [*by, at])).withColumn("_at", _axis(points, at))
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"))
    asked = asked.select("*", F.inline(F.array(*marks)))
    pairs = asked.join(cells, [*by, "_k", "_cell", "_salt"])
    return pairs.where("_start <= _at and _at < _end").drop("_k", "_cell", "_salt", "_at", "_start", "_end")
