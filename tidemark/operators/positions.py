"""Ranks and tiles for rows of one big group, without a window over all of it.

The places come from the value-ordered buckets of `ranks`: each bucket is ranked
by itself and shifted by the rows below it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import as_double
from tidemark.operators.ranks import rank_histogram, value_histogram
from tidemark.runtime import attach


def value_places(df: DataFrame, value: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Each row with rank, dense_rank, percent_rank and cume_dist of its value, ascending.

    Equal values share all four. Rows whose value is NULL or NaN, or whose group key is
    NULL, take no part and keep NULLs. A group of one row has the percent rank 0.
    """
    by = list(by)
    hist = value_histogram(df, value, by)
    ranked = rank_histogram(hist, value, by, buckets)
    # the same buckets over distinct values: every value counts once
    order = rank_histogram(hist.withColumn("n", F.lit(1).cast("long")), value, by, buckets)
    dense = order.select(*by, value, (F.col("before") + 1).alias("dense_rank"))
    places = attach(ranked, dense, [*by, value]).select(
        *by, value, (F.col("before") + 1).alias("rank"), "dense_rank",
        F.coalesce(F.try_divide(as_double("before"), as_double(F.col("total") - 1)), F.lit(0.0)).alias("percent_rank"),
        (as_double(F.col("before") + F.col("n")) / as_double("total")).alias("cume_dist"))
    return attach(df, places, [*by, value])


def tile_of(position: Column, total: Column, tiles: int) -> Column:
    """Tile, from 1, of a 0-based position: the first total mod tiles hold one row more."""
    size, larger = F.floor(total / tiles), total % tiles
    edge = larger * (size + 1)
    return F.when(position < edge, F.floor(position / (size + 1))).otherwise(
        larger + F.floor(F.try_divide(position - edge, size))).cast("int") + 1


def tile_table(df: DataFrame, value: str, key: str, count: int, name: str, by: Sequence[str] = (),
               buckets: int | None = None) -> DataFrame:
    """One row per distinct (by, value, key) that takes part in `tiles`, with its tile."""
    by = list(by)
    present = F.col(value).isNotNull() & F.col(key).isNotNull()
    if dict(df.dtypes)[value] in ("double", "float"):
        present = present & ~F.isnan(value)
    placed = df.where(present).select(*by, F.struct(value, key).alias("_place"))
    ranked = rank_histogram(value_histogram(placed, "_place", by), "_place", by, buckets)
    return ranked.select(*by, F.col(f"_place.{value}").alias(value), F.col(f"_place.{key}").alias(key),
                         tile_of(F.col("before"), F.col("total"), count).alias(name))


def tiles(df: DataFrame, value: str, key: str, count: int, name: str, by: Sequence[str] = (),
          buckets: int | None = None) -> DataFrame:
    """Each row's tile out of `count`, in ascending order of value and then key.

    The key tells rows of one value apart, however many those are; rows that repeat value
    and key share the tile of the first of them. NULL and NaN values, NULL keys and NULL
    groups take no part and keep NULL.
    """
    return attach(df, tile_table(df, value, key, count, name, by, buckets), [*by, value, key])
