"""Aggregations: named measures, ratios of sums, profiles, histograms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import as_double, round_to, safe_div
from tidemark.operators.ranks import histogram_quantiles, value_histogram
from tidemark.runtime import attach, stage


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rows() -> Column:
    return F.count(F.lit(1))


def count_where(test: Column) -> Column:
    """SUM(CASE WHEN test THEN 1 ELSE 0 END): NULL on no rows, unlike count_if."""
    return F.sum(F.when(test, F.lit(1)).otherwise(F.lit(0)))


def sum_where(value: Column | str, test: Column) -> Column:
    return F.sum(F.when(test, _col(value)).otherwise(F.lit(0)))


def ratio(a: Column | str, b: Column | str) -> Column:
    """Ratio of sums, not the mean of ratios."""
    return safe_div(F.sum(_col(a)), F.sum(_col(b)))


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    return safe_div(F.sum(_col(value) * _col(weight)), F.sum(_col(weight)))


def mean(value: Column | str) -> Column:
    """Mean from the exact sum: decimals do not lose digits as in avg(decimal)."""
    return safe_div(F.sum(_col(value)), F.count(_col(value)))


def product_of_means(a: Column | str, b: Column | str) -> Column:
    """mean(a) * mean(b), which differs from the mean of a * b."""
    return mean(a) * mean(b)


@dataclass(frozen=True)
class Calculated:
    """A measure in a changed context: over the rows that meet `where` only, and
    over all values of the slicing columns in `all_of`."""

    measure: str
    where: Column | None = None
    all_of: tuple[str, ...] = ()


class Measures:
    """Named aggregates, evaluated together in one pass for any slice.

    Each measure is a function without arguments that gives an aggregate
    Column; measures may call each other, as in a semantic model. Measures in a
    changed context are attached to the slices of the others; a slice that they
    have no rows for shows NULL. Contexts do not read the rows again: a row is dealt
    to every context it belongs to, under that context's keys, and one aggregate
    with map-side combining covers all. Totals that add up, and shifted periods,
    are cheaper in `contexts.Model`.
    """

    def __init__(self, **measures: Callable[[], Column]):
        self.measures = measures

    def evaluate(self, df: DataFrame, names: Sequence[str] | None = None,
                 by: Sequence[str] = (), calculated: Mapping[str, Calculated] | None = None) -> DataFrame:
        names = list(names or self.measures)
        if not calculated:
            cols = [self.measures[n]().alias(n) for n in names]
            return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)
        changed = dict(calculated)
        wanted = list(dict.fromkeys([*names, *(c.measure for c in changed.values())]))
        kind = {f.name: f.dataType for f in df.schema.fields}

        def place(no: int, c: Calculated | None) -> Column:
            keys = [(F.lit(None).cast(kind[k]) if c and k in c.all_of else F.col(k)).alias(f"_k{i}") for i, k in enumerate(by)]
            at = F.struct(F.lit(no).alias("_context"), *keys)
            return at if c is None or c.where is None else F.when(c.where, at)

        places = F.array(*[place(no, c) for no, c in enumerate([None, *changed.values()])])
        dealt = df.select("*", F.explode(F.array_compact(places)).alias("_place"))
        keys = [f"_k{i}" for i in range(len(by))]
        cells = stage(dealt.groupBy(*[F.col(f"_place.{c}").alias(c) for c in ("_context", *keys)])
                      .agg(*[self.measures[m]().alias(m) for m in wanted]))
        out = cells.where("_context = 0").select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *names)
        if not by:  # one row, even of no rows
            out = cells.sparkSession.range(1).join(out, F.lit(True), "left").drop("id")
        for no, (name, c) in enumerate(changed.items(), 1):
            kept = [(k, b) for k, b in zip(keys, by, strict=True) if b not in c.all_of]
            part = cells.where(F.col("_context") == no).select(*[k for k, _ in kept], F.col(c.measure).alias(f"_v{no}"))
            same = reduce(lambda x, y: x & y, [out[b].eqNullSafe(part[k]) for k, b in kept], F.lit(True))
            out = out.join(part if kept else F.broadcast(part), same, "left").drop(*[k for k, _ in kept])
            out = out.withColumnRenamed(f"_v{no}", name)
        return out


def one_row(grouped: DataFrame, *aggs: Column) -> DataFrame:
    """Aggregate an already grouped frame to one row.

    The branch reads every grouped column (through a fingerprint that is
    tested, then dropped); so no aggregate is pruned from it, and Spark reuses
    the exchange of the groups instead of scanning the source again. It has no
    row when there is no group.
    """
    fingerprint = F.bit_xor(F.xxhash64(*grouped.columns)).alias("_print")
    return grouped.agg(*aggs, fingerprint).where(F.col("_print").isNotNull()).drop("_print")


def with_total(grouped: DataFrame, value: str, name: str) -> DataFrame:
    """Add the grand total of a grouped column (one-row broadcast)."""
    return grouped.crossJoin(F.broadcast(one_row(grouped, F.sum(value).alias(name))))


def share_of_total(grouped: DataFrame, value: str, name: str, digits: int = 2) -> DataFrame:
    """Percent of the grand total for each group.

    The groups are never gathered in one partition.
    """
    share = round_to(safe_div(F.lit(100.0) * as_double(value), F.col("_total")), digits)
    return with_total(grouped, value, "_total").withColumn(name, share).drop("_total")


def share_within(grouped: DataFrame, value: str, by: Sequence[str], name: str,
                 digits: int = 2) -> DataFrame:
    """Percent within each partition of already grouped rows."""
    total = F.sum(value).over(Window.partitionBy(*by))
    return grouped.withColumn(name, round_to(safe_div(F.lit(100.0) * as_double(value), total), digits))


def count_distinct_key(*parts: str) -> Column:
    """COUNT(DISTINCT a || b || ...): a NULL part leaves the row uncounted."""
    return F.countDistinct(F.concat(*[F.col(p).cast("string") for p in parts]))


def resample_month(df: DataFrame, date: str, value: str, name: str = "value") -> DataFrame:
    """Monthly sums with empty months filled by 0, first to last month."""
    monthly = df.groupBy(F.trunc(date, "MM").alias("month")).agg(F.sum(value).alias(name))
    months = one_row(monthly, F.min("month").alias("a"), F.max("month").alias("b")).select(
        F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return months.join(monthly, "month", "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.dropna(subset=[col]).groupBy(col).agg(rows().alias("n"))


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max in one row.

    Everything comes from the histogram of distinct values: one scan.
    """
    hist = value_histogram(df, col)
    x, n = as_double(col), F.col("n")
    shape = hist.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        safe_div(F.sum(F.col(col) * n), F.sum(n)).alias("_mean"),
        as_double(F.min(col)).alias("min"),
        as_double(F.max(col)).alias("max"),
    )
    spread = hist.crossJoin(F.broadcast(shape.select("_mean", F.col("count").alias("_count")))).agg(
        F.sum(n * (x - F.col("_mean")) * (x - F.col("_mean"))).alias("_squares"))
    std = F.sqrt(safe_div("_squares", F.col("count") - 1))
    quartiles = histogram_quantiles(hist, col, [], {"p25": 0.25, "p50": 0.5, "p75": 0.75}).drop("n")
    return (
        shape.crossJoin(F.broadcast(spread)).crossJoin(F.broadcast(quartiles))
        .select("count", round_to("_mean", 6).alias("mean"), round_to(std, 6).alias("std"), "min", "p25", "p50", "p75",
                "max")
    )


def histogram(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed on the right."""
    x = as_double(col)
    bounds = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    slot = F.floor(F.try_divide(x - F.col("_lo"), width)).cast("int")
    slot = F.least(F.coalesce(slot, F.lit(0)), F.lit(bins - 1))
    return (
        df.dropna(subset=[col])
        .crossJoin(F.broadcast(bounds))
        .groupBy(slot.alias("bin"), "_lo", "_hi")
        .agg(rows().alias("n"))
        .select(
            "bin",
            round_to(F.col("_lo") + F.col("bin") * width, 6).alias("bin_start"),
            round_to(F.col("_lo") + (F.col("bin") + 1) * width, 6).alias("bin_end"),
            "n",
        )
    )


def box_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, 1.5 IQR whiskers and outlier count per group.

    Whiskers are the extreme data values inside the fences. All of it comes
    from the histogram of distinct values: one scan.
    """
    hist = value_histogram(df, value, [by])
    quart = histogram_quantiles(hist, value, [by], {"q1": 0.25, "median": 0.5, "q3": 0.75})
    quart = quart.withColumnRenamed("n", "rows")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    x = as_double(value)
    inside = (x >= F.col("q1") - reach) & (x <= F.col("q3") + reach)
    return (
        attach(hist, quart, by, how="inner")
        .groupBy(by, F.col("rows"), "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
        )
        .withColumnRenamed("rows", "n")
    )


def grouped_mean(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """Mean over the cells that exist; missing cells are not zeros."""
    return df.groupBy(*by).agg(mean(value).alias(name))


def conditional_measures(tests: Mapping[str, Column]) -> list[Column]:
    """n and percent of rows for each named predicate."""
    out = []
    for name, test in tests.items():
        hit = count_where(test)
        out += [hit.alias(f"{name}_n"),
                round_to(safe_div(F.lit(100.0) * as_double(hit), rows()), 2).alias(f"{name}_pct")]
    return out
