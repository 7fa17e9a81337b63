"""Cohort retention in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import month_index, month_key, pct, round_to
from tidemark.operators.aggregate import mean, rows
from tidemark.operators.reshape import pivot_matrix
from tidemark.runtime import spread


def cohort_assign(sales: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per customer (and extra keys) and month: cohort and month index.

    The lines are reduced to distinct customer-months first, a customer with very
    many lines in as many tasks as it has months; the window then sees at most one
    row per calendar month (and extra key) of a customer.
    """
    months = sales.dropna(subset=["customer_id"]).select(
        "customer_id", *extra, F.trunc("invoice_date", "MM").alias("order_month"))
    active = spread(spread(months, "customer_id", "order_month").distinct(), "customer_id")
    first = F.min("order_month").over(Window.partitionBy("customer_id"))
    marked = active.withColumn("cohort_month", first)
    return marked.withColumn("cohort_index", month_index("order_month") - month_index("cohort_month"))


def cohort_retention(sales: DataFrame) -> DataFrame:
    """Buyers per cohort and index, and their percent of the cohort."""
    cells = cohort_assign(sales).groupBy("cohort_month", "cohort_index").agg(rows().alias("buyers"))
    size = F.max(F.when(F.col("cohort_index") == 0, F.col("buyers"))).over(Window.partitionBy("cohort_month"))
    return cells.withColumn("cohort_size", size).select(
        month_key("cohort_month").alias("cohort"), "cohort_index", "buyers", "cohort_size",
        pct("buyers", "cohort_size", 6).alias("retention_pct"))


def retention_matrix(cells: DataFrame, months: int = 12) -> DataFrame:
    """Cohort x index matrix of rounded percentages, for display."""
    shown = cells.withColumn("retention_pct", F.round("retention_pct", 0))
    wide = pivot_matrix(shown, "cohort", "cohort_index", "retention_pct", list(range(months)))
    return wide.withColumnsRenamed({str(i): f"m{i}" for i in range(months)})


def avg_retention_curve(cells: DataFrame) -> DataFrame:
    """Mean over the cohorts that reached the index; others are not zeros."""
    share = F.col("retention_pct").cast("decimal(18,6)")
    return cells.groupBy("cohort_index").agg(round_to(mean(share), 4).alias("avg_retention_pct"))


def channel_retention(sales: DataFrame) -> DataFrame:
    """Buyers per channel and index over ALL customers of the channel.

    A customer has one row per channel and month, so buyers are a plain count;
    the channel's customers are counted in their first month there. One pass.
    """
    marked = cohort_assign(sales, extra=["channel"])
    debut = F.min("order_month").over(Window.partitionBy("customer_id", "channel"))
    cells = marked.withColumn("_new", F.col("order_month") == debut).groupBy("channel", "cohort_index").agg(
        rows().alias("buyers"), F.count_if("_new").alias("_joined"))
    size = F.sum("_joined").over(Window.partitionBy("channel"))
    return cells.withColumn("channel_customers", size).select(
        "channel", "cohort_index", "buyers", "channel_customers",
        pct("buyers", "channel_customers", 6).alias("retention_pct"))
