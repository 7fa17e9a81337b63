"""Cleaning operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import canonical_text, clamp, strip_space, trim_clean
from tidemark.operators.aggregate import mean
from tidemark.operators.ranks import exact_quantiles
from tidemark.runtime import attach, spread, spread_rows


def dedup_rows(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Drop rows identical in every column; NULL equals NULL.

    Most rows are single, so they are shuffled as they are, into partitions of
    bounded size, and not gathered before. `within` names columns with few rows a
    value, to shuffle by them alone: rows that a join on them has just shuffled
    into as many partitions stay where they are.
    """
    return (spread(df, *within) if within else spread_rows(df)).distinct()


def dedup_key(df: DataFrame, key: str | Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """Keep the first row per key under a stated total order.

    `row_number() = 1` is planned with a group limit before the shuffle, so a
    hot key sends one row per task.
    """
    if not order_by:
        raise ValueError("dedup_key needs an order that decides the surviving row")
    keys = [key] if isinstance(key, str) else list(key)
    order = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def first_per_key(df: DataFrame, key: str | Sequence[str], cols: Sequence[str],
                  order_by: Sequence[str]) -> DataFrame:
    """The named columns of the first row per key, as a mergeable aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    first = F.min(F.struct(*order_by, *[F.col(c).alias(f"_{c}") for c in cols]))
    picked = df.groupBy(*keys).agg(first.alias("_first"))
    return picked.select(*keys, *[F.col(f"_first._{c}").alias(c) for c in cols])


def canonicalize(df: DataFrame, col: str, mapping: Mapping[str, str] | DataFrame, strip: bool = False,
                 into: str | None = None) -> DataFrame:
    """Replace known spellings; a miss keeps the original text.

    A dict is inlined; a mapping table has columns (spelling, canonical), one
    row per lower-case spelling, and is joined.
    """
    into = into or col
    if not isinstance(mapping, DataFrame):
        return df.withColumn(into, canonical_text(col, dict(mapping), strip))
    key = F.lower(strip_space(col) if strip else F.col(col))
    return (
        df.withColumn("spelling", key)
        .join(mapping.select("spelling", "canonical"), "spelling", "left")
        .withColumn(into, F.coalesce("canonical", F.col(col)))
        .drop("spelling", "canonical")
    )


def trim_text(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: trim_clean(c) for c in cols})


def clamp_column(df: DataFrame, col: str, lo=None, hi=None) -> DataFrame:
    return df.withColumn(col, clamp(col, lo, hi))


def impute_group(df: DataFrame, col: str, by: str, stat: str = "mean",
                 cast: str = "decimal(18,6)") -> DataFrame:
    """Fill NULLs with the mean or exact median of the row's group."""
    if stat == "mean":
        stats = df.dropna(subset=[by]).groupBy(by).agg(mean(col).cast(cast).alias("_fill"))
    elif stat == "median":
        stats = exact_quantiles(df, col, [by], {"_fill": 0.5}).select(by, F.col("_fill").cast(cast).alias("_fill"))
    else:
        raise ValueError(f"unknown statistic {stat!r}")
    filled = F.coalesce(F.col(col).cast(cast), F.col("_fill"))
    return attach(df, stats, by).withColumn(col, filled).drop("_fill")


def cap_quantile(df: DataFrame, col: str, by: str, q: float = 0.995,
                 cast: str = "decimal(18,6)") -> DataFrame:
    """Clip each group at its own interpolated quantile; NULL stays NULL."""
    caps = exact_quantiles(df, col, [by], {"_cap": q}).select(by, F.col("_cap").cast(cast).alias("_cap"))
    capped = clamp(F.col(col).cast(cast), hi=F.col("_cap"))
    return attach(df, caps, by).withColumn(col, capped).drop("_cap")


def drop_orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Keep child rows whose key is in the parent (many-to-one join)."""
    return child.join(parent, key, "inner")


def split_sales_returns(df: DataFrame, quantity: str, price: str,
                        total: str = "line_total") -> tuple[DataFrame, DataFrame]:
    """Positive quantities, negative quantities; zero belongs to neither."""
    valued = df.withColumn(total, F.col(quantity) * F.col(price))
    return valued.where(F.col(quantity) > 0), valued.where(F.col(quantity) < 0)


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop rows that lack any of the named columns."""
    return df.dropna(subset=list(cols))
