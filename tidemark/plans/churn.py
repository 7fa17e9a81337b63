"""Subscription and churn analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import (
    as_double,
    band,
    flag,
    month_index,
    month_key,
    month_start,
    months_open,
    pct,
    round_to,
    safe_div,
    verdict,
    year_of_key,
)
from tidemark.operators.aggregate import (
    Measures,
    count_where,
    mean,
    product_of_means,
    rows,
    sum_where,
    weighted_mean,
)
from tidemark.operators.ranks import histogram_offset, value_histogram
from tidemark.operators.window import period_shift, previous, top_k, trailing_mean, with_change

# Bands and the at-risk rule.
USAGE_EDGES = [20, 40, 60, 80]
USAGE_LABELS = ["0-19%", "20-39%", "40-59%", "60-79%", "80-100%"]
NPS_EDGES = [6, 8]
NPS_LABELS = ["Detractor (0-6)", "Passive (7-8)", "Promoter (9-10)"]
AT_RISK_USAGE = 30
AT_RISK_NPS = 6


def subscription_view(raw: DataFrame, snapshot: str) -> DataFrame:
    """Flags, month keys and the (right-censored) lifespan in months."""
    out = raw.withColumns({
        "signup_month": month_key("signup_date"),
        "is_churned": flag("churned"),
        "churn_month": month_key("churn_date"),
        "lifespan_months": months_open("signup_date", "churn_date", snapshot),
    })
    return out.withColumn("upgraded", flag("upgraded")) if "upgraded" in raw.columns else out


def lifetime_churn_rate(subs: DataFrame) -> DataFrame:
    return subs.agg(rows().alias("total_customers_ever"), F.sum("is_churned").alias("total_churned"),
                    pct(F.sum("is_churned"), rows()).alias("lifetime_churn_rate_pct"))


def monthly_churn_series(monthly: DataFrame, rows_back: int = 3) -> DataFrame:
    """Monthly rate beside its trailing mean."""
    series = monthly.select("month", "total_active_customers", "new_customers", "churned_customers",
                            "monthly_churn_rate_pct")
    return trailing_mean(series, "month", "monthly_churn_rate_pct", rows_back, "trailing_avg_churn_pct")


def yearly_churn(monthly: DataFrame) -> DataFrame:
    return monthly.groupBy(year_of_key("month").alias("year")).agg(
        round_to(mean("monthly_churn_rate_pct"), 2).alias("avg_monthly_churn_rate_pct"),
        F.sum("churned_customers").alias("total_churned_that_year"),
        F.sum("new_customers").alias("total_new_that_year"),
    )


def largest_swings(monthly: DataFrame, k: int = 5) -> DataFrame:
    """Months with the largest change against the month before."""
    series = monthly.select("month", "monthly_churn_rate_pct")
    moved = with_change(series, "month", "monthly_churn_rate_pct", prev="prev_month_churn_pct",
                        diff="pct_point_change", pct=None).dropna(subset=["prev_month_churn_pct"])
    return top_k(moved, F.abs("pct_point_change"), k, "month")


def blended_cac(monthly: DataFrame) -> DataFrame:
    """Acquisition cost weighted by the customers acquired each month."""
    cost = weighted_mean(as_double("customer_acquisition_cost"), as_double("new_customers"))
    return monthly.agg(round_to(cost, 2).alias("blended_cac"))


def clv_by(subs: DataFrame, by: str = "plan", churned_only: bool = False) -> DataFrame:
    """Mean revenue x mean lifespan (a product of means)."""
    base = subs.where(F.col("is_churned") == 1) if churned_only else subs
    return base.groupBy(by).agg(
        rows().alias("customers"),
        round_to(mean("monthly_revenue"), 2).alias("avg_mrr"),
        round_to(_life(), 1).alias("avg_lifespan_months"),
        round_to(_clv(), 2).alias("avg_clv"),
    )


def _life() -> Column:
    # lifespan has one decimal: summed exactly as DECIMAL
    return mean(F.col("lifespan_months").cast("decimal(10,1)"))


def _clv() -> Column:
    return product_of_means("monthly_revenue", F.col("lifespan_months").cast("decimal(10,1)"))


def censoring_share(subs: DataFrame, by: str = "plan") -> DataFrame:
    active = F.col("is_churned") == 0
    return subs.groupBy(by).agg(rows().alias("customers"), count_where(active).alias("still_active"),
                                pct(count_where(active), rows(), 1).alias("pct_still_active"))


def clv_to_cac(subs: DataFrame, monthly: DataFrame, by: str = "plan") -> DataFrame:
    """Rounded lifetime value over rounded blended acquisition cost."""
    clv = subs.groupBy(by).agg(round_to(_clv(), 2).alias("avg_clv"))
    return clv.crossJoin(F.broadcast(blended_cac(monthly))).withColumn(
        "clv_to_cac_ratio", round_to(safe_div("avg_clv", "blended_cac"), 2))


def mrr_flow(subs: DataFrame, month: str, name: str) -> DataFrame:
    """Revenue by signup_month or churn_month: one date role per call."""
    return subs.dropna(subset=[month]).groupBy(F.col(month).alias("month")).agg(F.sum("monthly_revenue").alias(name))


def mrr_events(subs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Signup and churn of every subscription as rows (month, event, mrr): both date roles in one pass."""
    gone = F.when(F.col("is_churned") == 1, F.col("churn_month"))
    roles = [F.struct(m.alias("month"), F.lit(e).alias("event")) for m, e in ((F.col("signup_month"), "new"),
                                                                              (gone, "churned"))]
    return subs.select(*keep, F.col("monthly_revenue").alias("mrr"), F.inline(F.array(*roles))).dropna(subset=["month"])


def _event_sum(event: str) -> Column:
    return F.sum(F.when(F.col("event") == event, F.col("mrr")))


# Measures over `mrr_events`, for any slice of its columns.
MRR_MEASURES = Measures(
    new_mrr=lambda: F.coalesce(_event_sum("new"), F.lit(0)),
    churned_mrr=lambda: F.coalesce(_event_sum("churned"), F.lit(0)),
    net_new_mrr=lambda: round_to(
        F.coalesce(_event_sum("new"), F.lit(0)) - F.coalesce(_event_sum("churned"), F.lit(0)), 2),
)


def mrr_flows(subs: DataFrame) -> DataFrame:
    """New and churned revenue per month; NULL where there is no such event."""
    return mrr_events(subs).groupBy("month").agg(
        _event_sum("new").alias("new_mrr"), _event_sum("churned").alias("churned_mrr"))


def net_new_mrr(monthly: DataFrame, subs: DataFrame) -> DataFrame:
    """New minus churned revenue on the month spine.

    The flows are summed per month before they are joined.
    """
    joined = monthly.select("month", "total_mrr").join(mrr_flows(subs), "month", "left")
    new, lost = F.coalesce("new_mrr", F.lit(0)), F.coalesce("churned_mrr", F.lit(0))
    return joined.select("month", "total_mrr", new.alias("new_mrr"), lost.alias("churned_mrr"),
                         round_to(new - lost, 2).alias("net_new_mrr"))


def mom_anomaly(monthly: DataFrame, sigma: float = 1.5) -> DataFrame:
    """Month-on-month changes more than sigma deviations from their mean.

    The statistics use the percentages rounded to two decimals, as displayed.
    """
    change = with_change(monthly.select("month", "total_mrr"), "month", "total_mrr", prev="_prev", diff=None,
                         pct="mom_pct_change").drop("_prev").dropna(subset=["mom_pct_change"])
    stats = change.agg(F.avg("mom_pct_change").alias("_mean"), F.stddev_pop("mom_pct_change").alias("_sd"))
    far = F.abs(F.col("mom_pct_change") - F.col("_mean")) > F.lit(sigma) * F.col("_sd")
    return change.crossJoin(F.broadcast(stats)).withColumn("flag", verdict(far, "FLAGGED", "")).drop("_mean", "_sd")


def nrr(monthly: DataFrame, subs: DataFrame, opening_balance: bool = False,
        calendar: bool = False) -> DataFrame:
    """Net revenue retention: (total - new) / total of the month before.

    With opening_balance the monthly total is read as an opening figure, so
    the new revenue of the month before is taken off instead. With calendar
    the month before is the calendar month; by default it is the previous row.
    """
    new = mrr_flow(subs, "signup_month", "new_mrr")
    base = monthly.select("month", "total_mrr").join(new, "month", "left").withColumn(
        "new_mrr", F.coalesce("new_mrr", F.lit(0)))
    if opening_balance:
        base = base.withColumn("new_mrr", F.coalesce(previous("new_mrr", "month"), F.lit(0)))
    kept = F.col("total_mrr") - F.col("new_mrr")
    if calendar:
        numbered = base.withColumn("_no", month_index(month_start("month")))
        base = period_shift(numbered, "_no", "total_mrr", "prev_total_mrr")
    else:
        base = base.withColumn("prev_total_mrr", previous("total_mrr", "month"))
    return (
        base
        .dropna(subset=["prev_total_mrr"])
        .select("month", "prev_total_mrr", "new_mrr", round_to(kept, 2).alias("retained_mrr_from_existing_base"),
                pct(kept, "prev_total_mrr").alias("nrr_pct"))
    )


def status_profile(subs: DataFrame) -> DataFrame:
    status = verdict(F.col("is_churned") == 1, "Churned", "Active")
    return subs.groupBy(status.alias("status")).agg(
        rows().alias("customers"),
        round_to(mean("feature_usage_pct"), 1).alias("avg_feature_usage_pct"),
        round_to(mean("nps_score"), 1).alias("avg_nps_score"),
        round_to(mean("support_tickets_12mo"), 1).alias("avg_support_tickets_12mo"),
    )


def usage_band(col: str = "feature_usage_pct") -> Column:
    return band(col, USAGE_EDGES, USAGE_LABELS)


def nps_band(col: str = "nps_score") -> Column:
    return band(col, NPS_EDGES, NPS_LABELS, inclusive=True)


def threshold_from_churned(subs: DataFrame, p: float = 0.6) -> DataFrame:
    """Mean and rank-offset percentile of usage among churned customers."""
    usage = "feature_usage_pct"
    hist = value_histogram(subs.where(F.col("is_churned") == 1), usage)
    average = hist.agg(round_to(safe_div(F.sum(F.col(usage) * F.col("n")), F.sum("n")), 1).alias("avg_usage_at_churn"))
    return average.crossJoin(F.broadcast(histogram_offset(hist, usage, p, name="usage_p60_at_churn")))


def at_risk(usage: str = "feature_usage_pct", nps: str = "nps_score") -> Column:
    return (F.col(usage) < AT_RISK_USAGE) & (F.col(nps) <= AT_RISK_NPS)


def at_risk_summary(subs: DataFrame) -> DataFrame:
    active = subs.where(F.col("is_churned") == 0)
    return active.agg(
        rows().alias("active_customers"), count_where(at_risk()).alias("at_risk_customers"),
        pct(count_where(at_risk()), rows()).alias("pct_of_active_base"),
        round_to(sum_where("monthly_revenue", at_risk()), 2).alias("at_risk_mrr"),
    )


def at_risk_by(subs: DataFrame, by: str = "plan") -> DataFrame:
    active = subs.where(F.col("is_churned") == 0)
    return active.groupBy(by).agg(
        rows().alias("active_customers"), count_where(at_risk()).alias("at_risk_customers"),
        pct(count_where(at_risk()), rows()).alias("pct_at_risk"),
    )


def at_risk_list(subs: DataFrame) -> DataFrame:
    """The active customers to call, highest revenue first."""
    chosen = subs.where((F.col("is_churned") == 0) & at_risk())
    return chosen.select("customer_id", "plan", "monthly_revenue", "nps_score", "feature_usage_pct").orderBy(
        F.col("monthly_revenue").desc(), "customer_id")


def _gone() -> Column:
    return F.col("churned") == "Yes"


# Named measures; each may be sliced by any columns.
SUBSCRIPTION_MEASURES = Measures(
    total_customers_ever=rows,
    active_customers=lambda: count_where(F.col("churned") == "No"),
    churned_customers=lambda: count_where(_gone()),
    overall_churn_rate_pct=lambda: pct(count_where(_gone()), rows(), 6),
    avg_lifespan_months=lambda: round_to(_life(), 6),
    avg_clv=lambda: round_to(_clv(), 4),
    at_risk_customers_active=lambda: count_where((F.col("churned") == "No") & at_risk()),
    at_risk_mrr_active=lambda: round_to(
        sum_where("monthly_revenue", (F.col("churned") == "No") & at_risk()), 2),
    at_risk_pct_of_active_base=lambda: pct(
        count_where((F.col("churned") == "No") & at_risk()), count_where(F.col("churned") == "No"), 6),
    avg_feature_usage_pct=lambda: round_to(mean("feature_usage_pct"), 6),
    avg_nps_score=lambda: round_to(mean("nps_score"), 6),
)

MONTHLY_MEASURES = Measures(
    monthly_churn_rate_pct=lambda: round_to(mean("monthly_churn_rate_pct"), 6),
    total_mrr=lambda: round_to(F.sum("total_mrr"), 2),
    blended_cac=lambda: round_to(
        weighted_mean(as_double("customer_acquisition_cost"), as_double("new_customers")), 6),
)


def role_playing_mrr(calendar_months: DataFrame, subs: DataFrame) -> DataFrame:
    """New, churned and net MRR per calendar month: one calendar, two roles."""
    return (
        calendar_months.select(F.col("month_key").alias("month")).join(mrr_flows(subs), "month", "left")
        .withColumn("net_new_mrr", round_to(
            F.coalesce("new_mrr", F.lit(0)) - F.coalesce("churned_mrr", F.lit(0)), 2))
    )

