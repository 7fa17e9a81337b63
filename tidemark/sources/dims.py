"""Small dimensions and calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reshape import unpivot_counts

# Natural orders of the categories.
PLAN_ORDER = ["Starter", "Professional", "Business", "Enterprise"]
COMPANY_SIZE_ORDER = ["1-10", "11-50", "51-200", "201-500", "500+"]
BOROUGH_ORDER = ["Brooklyn", "Queens", "Manhattan", "Bronx", "Staten Island", "Unknown/Unassigned"]

# Count column to (road user, outcome).
ROAD_USER_COLUMNS = {
    "pedestrians_injured": ("Pedestrian", "Injured"),
    "pedestrians_killed": ("Pedestrian", "Killed"),
    "cyclists_injured": ("Cyclist", "Injured"),
    "cyclists_killed": ("Cyclist", "Killed"),
    "motorists_injured": ("Motorist", "Injured"),
    "motorists_killed": ("Motorist", "Killed"),
}


def dim_from_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def ordered_dim(spark: SparkSession, name: str, values: Sequence[str]) -> DataFrame:
    """A category with its sort order, starting at 1."""
    rows = [(v, i) for i, v in enumerate(values, start=1)]
    return dim_from_rows(spark, rows, f"{name} string, sort_order int")


def _with_parts(days: DataFrame) -> DataFrame:
    return days.select(
        "date",
        F.date_format("date", "yyyy-MM").alias("month_key"),
        F.year("date").alias("year"),
        F.date_format("date", "MMM").alias("month_name"),
    )


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    """One row per day, both ends included."""
    span = spark.range(1).select(
        F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("date"))
    return _with_parts(span)


def calendar_of(df: DataFrame, date: str) -> DataFrame:
    """The calendar between the first and the last date of a table."""
    ends = df.agg(F.min(date).cast("date").alias("a"), F.max(date).cast("date").alias("b"))
    return _with_parts(ends.select(F.explode(F.sequence("a", "b")).alias("date")))


def months_of(calendar_days: DataFrame) -> DataFrame:
    """Monthly calendar: the grain that month-keyed facts join to."""
    return calendar_days.groupBy("month_key").agg(F.min("year").alias("year"), F.count(F.lit(1)).alias("days"))


def dim_road_user(totals: DataFrame) -> DataFrame:
    """(road_user, outcome, value) rows from the six count columns."""
    return unpivot_counts(totals, [], ROAD_USER_COLUMNS)
