"""Exact ranks and quantiles without a global sort.

The rows are first reduced to a histogram of distinct values (with map-side
combine, so ties and hot values collapse). The histogram is computed once and
kept in the shared folder; its size is then known.

The values are cut into value-ordered buckets at hash-sampled split points, as
many as the number of distinct values asks for. Each bucket is ranked on its own
and shifted by the rows in the buckets below it: no task ever holds a whole
group. A quantile ranks only the buckets its neighbours lie in. Values are
compared in their own type.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import as_double
from tidemark.runtime import attach, materialize

# Distinct values in a bucket, about, and the least number of buckets.
BUCKET_VALUES = 250_000
LEAST_BUCKETS = 8


def value_histogram(df: DataFrame, value: str, by: Sequence[str] = (),
                    extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per distinct (by, value) with its row count n, computed once.

    Rows with a NULL (or NaN) value or a NULL group key take no part.
    """
    present = F.col(value).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        present = present & ~F.isnan(value)
    for c in by:
        present = present & F.col(c).isNotNull()
    extras = [c.alias(k) for k, c in (extra or {}).items()]
    return materialize(df.where(present).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), *extras))


def bucketed(hist: DataFrame, value: str, by: list[str], buckets: int | None) -> DataFrame:
    """The histogram with a bucket number that rises with the value.

    Some histogram rows, chosen by hash, give the split points, which serve all
    groups. They travel as one row: every g-th of them, and the g between. A
    value is placed by counting the coarse points up to it and then the fine ones
    of that stretch, so that the work for a row is the root of their number.
    """
    distinct = hist.count()
    buckets = buckets or max(LEAST_BUCKETS, math.ceil(distinct / BUCKET_VALUES))
    step = max(1, math.ceil(distinct / buckets))
    g = max(1, math.isqrt(buckets))
    chosen = hist.where(F.pmod(F.xxhash64(*by, value), F.lit(step)) == 0)
    points = chosen.agg(F.array_sort(F.collect_set(value)).alias("_p"))
    last = F.size("_p")
    points = points.select(
        F.filter("_p", lambda p, i: (i + 1) % g == 0).alias("_coarse"),
        F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(g)),
                                     lambda i: F.slice("_p", i, g))).alias("_fine"))
    placed = hist.crossJoin(F.broadcast(materialize(points)))

    def reached(points_: Column) -> Column:
        return F.coalesce(F.size(F.filter(points_, lambda p: p <= F.col(value))), F.lit(0))

    stretch = reached(F.col("_coarse"))
    rest = F.when(F.col("_fine").isNotNull(), reached(F.get("_fine", stretch)))
    # size() of NULL may be -1.
    bucket = stretch * g + F.greatest(F.coalesce(rest, F.lit(0)), F.lit(0))
    return placed.withColumn("_bucket", bucket).drop("_coarse", "_fine")


def rank_histogram(hist: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None,
                   positions: Sequence[Column] | None = None) -> DataFrame:
    """Add `before` (rows with a lower value in the group) and `total`.

    With `positions` (0-based, as functions of the column `total`) only the
    buckets that hold one of them need be ranked and returned.
    """
    by = list(by)
    up_to = Window.unboundedPreceding
    placed = bucketed(hist, value, by, buckets)
    below = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(up_to, -1)
    offsets = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum("n").alias("_rows"))
        .withColumns({
            "_offset": F.coalesce(F.sum("_rows").over(below), F.lit(0)),
            "total": F.sum("_rows").over(Window.partitionBy(*by)),
        })
    )
    if positions is not None:
        wanted = F.lit(False)
        for p in positions:
            wanted = wanted | ((F.col("_offset") <= p) & (p < F.col("_offset") + F.col("_rows")))
        offsets = offsets.where(wanted)
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(up_to, -1)
    return (
        attach(placed, offsets, [*by, "_bucket"], how="inner")
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .select(*hist.columns, "before", "total")
    )


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (),
                extra: Mapping[str, Column] | None = None, buckets: int | None = None) -> DataFrame:
    """One row per distinct (by, value): n, extras, rows before it, group total."""
    return rank_histogram(value_histogram(df, value, by, extra), value, by, buckets)


def _at(position: Column, value: str) -> Column:
    """Aggregate: the value standing at a 0-based position of its group."""
    holds = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
    return F.max(F.when(holds, F.col(value)))


def _place(q: float) -> Column:
    return F.lit(float(q)) * (F.col("total") - 1)


def histogram_statistics(hist: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float],
                         buckets: int | None = None) -> DataFrame:
    """Per group the two neighbours of each quantile and the weight of the upper.

    Columns n and `<name>_lo`, `<name>_hi`, `<name>_frac` for every quantile.
    """
    ends = [f(_place(q)) for q in quantiles.values() for f in (F.floor, F.ceil)]
    ranked = rank_histogram(hist, value, by, buckets, positions=ends)
    aggs = []
    for name, q in quantiles.items():
        place = _place(q)
        aggs += [
            _at(F.floor(place), value).alias(f"{name}_lo"),
            _at(F.ceil(place), value).alias(f"{name}_hi"),
            F.max(place - F.floor(place)).alias(f"{name}_frac"),
        ]
    return ranked.groupBy(*by).agg(F.max("total").alias("n"), *aggs)


def order_statistics(df: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float]) -> DataFrame:
    return histogram_statistics(value_histogram(df, value, by), value, by, quantiles)


def lerp(lo: Column, hi: Column, frac: Column) -> Column:
    return as_double(lo) + (as_double(hi) - as_double(lo)) * frac


def histogram_quantiles(hist: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float],
                        buckets: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, as doubles, with the count n."""
    stats = histogram_statistics(hist, value, by, quantiles, buckets)
    cols = [lerp(F.col(f"{q}_lo"), F.col(f"{q}_hi"), F.col(f"{q}_frac")).alias(q) for q in quantiles]
    return stats.select(*by, "n", *cols)


def exact_quantiles(df: DataFrame, value: str, by: Sequence[str], quantiles: Mapping[str, float],
                    buckets: int | None = None) -> DataFrame:
    return histogram_quantiles(value_histogram(df, value, by), value, by, quantiles, buckets)


def percentile_offset(df: DataFrame, value: str, p: float, by: Sequence[str] = (),
                      name: str = "value", buckets: int | None = None) -> DataFrame:
    """Value at 0-based position floor(p * n) in ascending order, in the column's own type."""
    return histogram_offset(value_histogram(df, value, by), value, p, by, name, buckets)


def histogram_offset(hist: DataFrame, value: str, p: float, by: Sequence[str] = (), name: str = "value",
                     buckets: int | None = None) -> DataFrame:
    """`percentile_offset` of a histogram that is there already."""
    place = F.floor(F.lit(float(p)) * F.col("total"))
    ranked = rank_histogram(hist, value, by, buckets, positions=[place])
    return ranked.groupBy(*by).agg(_at(place, value).alias(name))
