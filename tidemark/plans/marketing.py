"""Marketing return and budget scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import add_months_to_key, as_double, round_to, safe_div, verdict
from tidemark.operators.aggregate import mean, ratio, rows


def roas() -> Column:
    return ratio("attributed_revenue", "spend")


def platform_efficiency(spend: DataFrame, by: str = "platform") -> DataFrame:
    return spend.groupBy(by).agg(
        round_to(F.sum("spend"), 2).alias("total_spend"),
        round_to(F.sum("attributed_revenue"), 2).alias("total_attributed_revenue"),
        round_to(roas(), 2).alias("roas"),
        round_to(ratio("spend", "conversions"), 2).alias("cost_per_acquisition"),
        round_to(ratio("spend", "clicks"), 2).alias("cost_per_click"),
        F.sum("clicks").alias("total_clicks"),
        F.sum("conversions").alias("total_conversions"),
    )


def profit_adjusted_roi(spend: DataFrame, margin: DataFrame, by: str = "platform") -> DataFrame:
    """Revenue at the blended margin, less the spend; `margin` is one row."""
    per = spend.groupBy(by).agg(as_double(F.sum("spend")).alias("s"),
                                as_double(F.sum("attributed_revenue")).alias("r"))
    gross = F.col("r") * F.col("margin")
    return per.crossJoin(F.broadcast(margin)).select(
        by, round_to("s", 2).alias("total_spend"), round_to(safe_div("r", "s"), 2).alias("roas"),
        round_to(gross, 2).alias("estimated_gross_profit"),
        round_to(gross - F.col("s"), 2).alias("net_profit_after_ad_spend"),
        verdict(gross - F.col("s") > 0, "Profitable", "Losing money after ad spend").alias("verdict"))


def roas_trend(spend: DataFrame) -> DataFrame:
    return spend.select("month", "platform", round_to("spend", 2).alias("spend"),
                        round_to("attributed_revenue", 2).alias("attributed_revenue"),
                        round_to(safe_div("attributed_revenue", "spend"), 2).alias("roas"))


def last_n_months(df: DataFrame, n: int, month: str = "month") -> DataFrame:
    """Rows of the n latest months, counted back from the data's own maximum."""
    cut = df.agg(add_months_to_key(F.max(month), -(n - 1)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).where(F.col(month) >= F.col("_cut")).drop("_cut")


def recent_vs_full(spend: DataFrame, n: int = 3, by: str = "platform") -> DataFrame:
    """Recent against full-period return, in one pass over the spend.

    Platforms without recent rows are left out.
    """
    cut = spend.agg(add_months_to_key(F.max("month"), -(n - 1)).alias("_cut"))
    recent = F.col("month") >= F.col("_cut")
    sums = spend.crossJoin(F.broadcast(cut)).groupBy(by).agg(
        roas().alias("full"),
        safe_div(F.sum(F.when(recent, F.col("attributed_revenue"))),
                 F.sum(F.when(recent, F.col("spend")))).alias("recent"),
        F.count_if(recent).alias("_recent_rows"))
    return sums.where(F.col("_recent_rows") > 0).select(
        by, round_to("full", 2).alias("full_period_roas"), round_to("recent", 2).alias("last_3mo_roas"),
        round_to(F.col("recent") - F.col("full"), 2).alias("roas_change"))


def budget_target(spend: DataFrame, share: float = 0.2) -> DataFrame:
    return spend.agg(round_to(F.sum("spend"), 2).alias("total_marketing_spend"),
                     round_to(as_double(F.sum("spend")) * F.lit(share), 2).alias("cut_target"))


def _lever(spend: DataFrame, where: Column, share: float) -> DataFrame:
    """Spend saved and revenue forgone by cutting `share` of the chosen rows."""
    chosen = spend.where(where).withColumn("_roas", safe_div("attributed_revenue", "spend"))
    return chosen.agg(
        rows().alias("months_flagged"),
        F.min("month").alias("earliest_flagged_month"),
        F.max("month").alias("latest_flagged_month"),
        as_double(F.sum("spend")).alias("spend_in_scope"),
        mean("_roas").alias("avg_roas"),
        (as_double(F.sum("spend")) * F.lit(share)).alias("saved"),
        (as_double(F.sum("attributed_revenue")) * F.lit(share)).alias("forgone"))


def weak(limit: float) -> Column:
    """Months whose return is below the limit."""
    return safe_div("attributed_revenue", "spend") < F.lit(limit)


def cut_scenario(spend: DataFrame, margin: DataFrame, label: str, where: Column,
                 share: float = 1.0) -> DataFrame:
    """Effect of cutting a share of the spend in the rows chosen by `where`."""
    lever = _lever(spend, where, share).crossJoin(F.broadcast(margin))
    profit = F.col("forgone") * F.col("margin")
    return lever.select(
        F.lit(label).alias("recommendation"), "months_flagged", "earliest_flagged_month", "latest_flagged_month",
        round_to("spend_in_scope", 2).alias("spend_in_flagged_months"),
        round_to("avg_roas", 2).alias("avg_roas_in_flagged_months"),
        round_to("saved", 2).alias("spend_saved"), round_to("forgone", 2).alias("attributed_revenue_forgone"),
        round_to(profit, 2).alias("estimated_gross_profit_forgone"),
        round_to(F.col("saved") - profit, 2).alias("net_profit_impact_of_cutting"))


def combined_scenarios(spend: DataFrame, margin: DataFrame, levers: Sequence[tuple[Column, float]],
                       share: float = 0.2) -> DataFrame:
    """All levers together against the target; the margin is applied once.

    Every lever is a conditional sum of the same scan.
    """
    saved = [F.sum(F.when(w, F.col("spend"))).cast("double") * F.lit(x) for w, x in levers]
    forgone = [F.sum(F.when(w, F.col("attributed_revenue"))).cast("double") * F.lit(x) for w, x in levers]
    total_saved, total_forgone = saved[0], forgone[0]
    for a, b in zip(saved[1:], forgone[1:]):
        total_saved, total_forgone = total_saved + a, total_forgone + b
    sums = spend.agg(total_saved.alias("saved"), total_forgone.alias("forgone"),
                     (as_double(F.sum("spend")) * F.lit(share)).alias("target"))
    return sums.crossJoin(F.broadcast(margin)).select(
        round_to("saved", 2).alias("total_spend_saved"), round_to("target", 2).alias("cut_target"),
        round_to(F.col("saved") - F.col("forgone") * F.col("margin"), 2).alias("estimated_net_profit_impact"))
