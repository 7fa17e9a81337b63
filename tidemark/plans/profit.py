"""Order profitability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import as_double, clamp, month_key, pct, round_to, safe_div
from tidemark.operators.aggregate import count_where, mean, rows, sum_where
from tidemark.operators.clean import dedup_rows, drop_orphans, impute_group
from tidemark.runtime import stage


def order_profit_view(orders: DataFrame, products: DataFrame, stat: str = "mean",
                      within: Sequence[str] = ()) -> DataFrame:
    """Clean order lines with cost and net revenue.

    Exact duplicates go first, then missing shipping is filled from the mean of
    the line's category; lines without a catalogue product are dropped.
    Returned lines keep their costs and earn nothing. The category is the one on
    the order line, not the catalogue's.

    The distinct lines are written once; the category means, computed here, and
    the view read them. Reports that share the view read it through `runtime.kept`.
    `within` is that of `dedup_rows`.
    """
    lines = impute_group(stage(dedup_rows(orders, within)), "shipping_cost", "category", stat)
    costed = drop_orphans(lines, products.select("product_id", "unit_cost"), "product_id")
    return (
        costed.withColumn("discount_amount", clamp("discount_amount", lo=0))
        .withColumn("order_month", month_key("order_date"))
        .withColumn("product_cost", F.col("unit_cost") * F.col("quantity"))
        .withColumn("net_revenue", F.when(F.col("is_returned") == "Yes", F.lit(0))
                    .otherwise(F.col("gross_revenue") - F.col("discount_amount")))
        .withColumn("total_cost", F.col("product_cost") + F.col("shipping_cost") + F.col("platform_fee")
                    + F.col("return_processing_cost"))
    )


def returned() -> Column:
    return F.col("is_returned") == "Yes"


def profit_sum() -> Column:
    return as_double(F.sum("net_revenue") - F.sum("total_cost"))


def margin(digits: int | None = 1) -> Column:
    """Profit over net revenue in percent, from the sums."""
    return pct(F.sum("net_revenue") - F.sum("total_cost"), F.sum("net_revenue"), digits)


def _of_gross(value: Column, digits: int = 1) -> Column:
    return pct(value, F.sum("gross_revenue"), digits)


def profitability(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        rows().alias("order_lines"),
        round_to(F.sum("net_revenue"), 2).alias("total_revenue"),
        round_to(F.sum("total_cost"), 2).alias("total_cost"),
        round_to(F.sum("net_revenue") - F.sum("total_cost"), 2).alias("total_profit"),
        margin().alias("profit_margin_pct"),
        round_to(mean("gross_revenue"), 2).alias("avg_order_value"),
        round_to(mean(F.col("net_revenue") - F.col("total_cost")), 2).alias("avg_profit_per_order"),
    )


def cost_structure(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every cost as a share of gross revenue."""
    return lines.groupBy(*by).agg(
        round_to(F.sum("gross_revenue"), 2).alias("gross_revenue"),
        _of_gross(F.sum("product_cost")).alias("product_cost_pct_of_gross"),
        _of_gross(F.sum("shipping_cost")).alias("shipping_pct_of_gross"),
        _of_gross(F.sum("platform_fee")).alias("platform_fee_pct_of_gross"),
        _of_gross(F.sum("discount_amount")).alias("discount_pct_of_gross"),
        _of_gross(sum_where("gross_revenue", returned())).alias("revenue_lost_to_returns_pct"),
    )


def return_rate(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        rows().alias("order_lines"), count_where(returned()).alias("returned_lines"),
        pct(count_where(returned()), rows(), 1).alias("return_rate_pct"), margin().alias("profit_margin_pct"))


def discount_profile(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        _of_gross(F.sum("discount_amount")).alias("avg_discount_rate_pct"),
        pct(count_where(F.col("discount_amount") > 0), rows(), 1).alias("pct_orders_discounted"))


def fee_drag(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Margin with and without the platform fee."""
    without = F.sum("net_revenue") - (F.sum("total_cost") - F.sum("platform_fee"))
    return lines.groupBy(*by).agg(
        round_to(F.sum("gross_revenue"), 2).alias("gross_revenue"),
        round_to(F.sum("platform_fee"), 2).alias("total_platform_fees"),
        _of_gross(F.sum("platform_fee"), 2).alias("platform_fee_pct_of_gross"),
        margin().alias("actual_margin_pct"),
        pct(without, F.sum("net_revenue"), 1).alias("margin_pct_excl_platform_fee"))


def margin_matrix(lines: DataFrame, a: str, b: str, min_n: int = 30) -> DataFrame:
    grouped = lines.groupBy(a, b).agg(rows().alias("order_lines"), margin().alias("profit_margin_pct"))
    return grouped.where(F.col("order_lines") >= min_n)


def returns_summary(lines: DataFrame) -> DataFrame:
    extra = F.col("shipping_cost") + F.col("platform_fee") + F.col("return_processing_cost")
    return lines.agg(
        rows().alias("total_order_lines"), count_where(returned()).alias("returned_lines"),
        pct(count_where(returned()), rows(), 1).alias("overall_return_rate_pct"),
        round_to(sum_where("gross_revenue", returned()), 2).alias("gross_revenue_lost_to_returns"),
        round_to(sum_where(extra, returned()), 2).alias("additional_costs_still_incurred_on_returns"))


def returns_by(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    return lines.groupBy(*by).agg(
        rows().alias("order_lines"), pct(count_where(returned()), rows(), 1).alias("return_rate_pct"),
        round_to(sum_where("gross_revenue", returned()), 2).alias("revenue_lost_to_returns"))


def return_rate_trend(lines: DataFrame) -> DataFrame:
    return lines.groupBy("order_month").agg(
        rows().alias("order_lines"), pct(count_where(returned()), rows(), 1).alias("return_rate_pct"))


def blended_margin(lines: DataFrame) -> DataFrame:
    """Margin of all lines together, as a fraction in one row."""
    return lines.agg(safe_div(F.sum("net_revenue") - F.sum("total_cost"), F.sum("net_revenue")).alias("margin"))
