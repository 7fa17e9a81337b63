"""Windows over aggregated series: lag, trailing means, rank, ties.

The unpartitioned windows run on series already reduced to one row per period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import as_double, round_to, safe_div


def previous(value: str, order: str, by: Sequence[str] = ()) -> Column:
    return F.lag(value).over(Window.partitionBy(*by).orderBy(order))


def with_change(series: DataFrame, order: str, value: str, by: Sequence[str] = (),
                prev: str = "previous", diff: str | None = "change", pct: str | None = "pct_change",
                digits: int = 2) -> DataFrame:
    """Value of the previous ROW, point change and percent change."""
    out = series.withColumn(prev, previous(value, order, by))
    gap = F.col(value) - F.col(prev)
    if diff:
        out = out.withColumn(diff, round_to(gap, digits))
    if pct:
        out = out.withColumn(pct, round_to(safe_div(F.lit(100.0) * as_double(gap), F.col(prev)), digits))
    return out


def trailing_mean(series: DataFrame, order: str, value: str, rows: int, name: str,
                  by: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Mean of the last `rows` rows; short frames average what exists."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-(rows - 1), 0)
    return series.withColumn(name, round_to(F.avg(as_double(value)).over(frame), digits))


def trailing_month_mean(series: DataFrame, month: str, value: str, months: int, name: str,
                        digits: int = 2) -> DataFrame:
    """Mean over the days of the last `months` calendar months.

    Each month counts once per day it has, as in an iteration over a daily
    calendar; months without a row are left out.
    """
    at = (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int"))
    days = F.dayofmonth(F.last_day(F.to_date(F.concat(F.col(month), F.lit("-01")))))
    frame = Window.orderBy("_at").rangeBetween(-(months - 1), 0)
    weight = F.when(F.col(value).isNotNull(), days)
    out = series.withColumn("_at", at)
    mean = safe_div(F.sum(as_double(value) * days).over(frame), F.sum(weight).over(frame))
    return out.withColumn(name, round_to(mean, digits)).drop("_at")


def top_per_group(grouped: DataFrame, by: Sequence[str], score: str, k: int = 1) -> DataFrame:
    """Rows ranked 1..k by descending score in each group; ties are all kept."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc())
    return grouped.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= k).drop("_rank")


def average_rank(col: Column, partition: Sequence[str] = ()) -> Column:
    """Rank where equal values share the mean of their positions."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*partition, col))
    first = F.rank().over(Window.partitionBy(*partition).orderBy(col))
    return first + (ties - 1) / F.lit(2.0)


def period_shift(series: DataFrame, period: str, value: str, name: str, step: int = 1,
                 by: Sequence[str] = ()) -> DataFrame:
    """Value `step` calendar periods earlier; a gap gives NULL (unlike lag).

    `period` is an integer index, so that consecutive periods differ by one.
    """
    earlier = series.select(*by, (F.col(period) + step).alias(period), F.col(value).alias(name))
    return series.join(earlier, [*by, period], "left")


def top_k(df: DataFrame, score: str | Column, k: int, *ties: str) -> DataFrame:
    """The k highest rows; the tie-break columns make the cut repeatable."""
    score = F.col(score) if isinstance(score, str) else score
    return df.orderBy(score.desc(), *ties).limit(k)
