"""Models of the subscription and incident reports: every named measure, in any slice and period.

Facts of the subscription model: `subs` (subscription_view), `events` (mrr_events,
a row per signup and churn) and `monthly`. Columns they share slice them together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import as_double, month_index, month_start, pct, round_to, safe_div
from tidemark.operators.contexts import Base, Model, Scope, row_count
from tidemark.plans.churn import at_risk
from tidemark.plans.incidents import SPEEDING, known_cause

TRAILING_MONTHS = 3


def with_month_no(rows: DataFrame, month: str = "month") -> DataFrame:
    """Add the index of a 'YYYY-MM' key."""
    return rows.withColumn("month_no", month_index(month_start(month)))


def days_of(month_no: Column) -> Column:
    """Days of a month by its index."""
    return F.dayofmonth(F.last_day(F.make_date(F.floor(month_no / 12).cast("int"), (month_no % 12 + 1).cast("int"), F.lit(1))))


def _mean(m: Scope, value: str, count: str) -> Column:
    return safe_div(m.total(value), m.total(count))


def _change(m: Scope, measure: str, earlier: Scope) -> Column:
    return pct(m[measure] - earlier[measure], earlier[measure], 4)


def _life() -> Column:
    return F.col("lifespan_months").cast("decimal(10,1)")


SUBSCRIPTIONS = Model(
    bases={
        "customers": row_count("subs"),
        "revenue": Base("subs", lambda: F.col("monthly_revenue")),
        "lifespan": Base("subs", _life),
        "event_mrr": Base("events", lambda: F.col("mrr")),
        "event_count": row_count("events"),
        "mrr": Base("monthly", lambda: F.col("total_mrr")),
        "rate": Base("monthly", lambda: F.col("monthly_churn_rate_pct")),
        "months": Base("monthly", lambda: F.when(F.col("monthly_churn_rate_pct").isNotNull(), 1)),
        "cost": Base("monthly", lambda: as_double("customer_acquisition_cost") * as_double("new_customers")),
        "new_customers": Base("monthly", lambda: as_double("new_customers")),
    },
    filters={
        "active": lambda: F.col("is_churned") == 0, "churned": lambda: F.col("is_churned") == 1, "at_risk": at_risk,
        "new": lambda: F.col("event") == "new", "lost": lambda: F.col("event") == "churned",
    },
    measures={
        "total_customers_ever": lambda m: m.total("customers"),
        "active_customers": lambda m: m.where("active")["total_customers_ever"],
        "churned_customers": lambda m: m.where("churned")["total_customers_ever"],
        "overall_churn_rate_pct": lambda m: pct(m["churned_customers"], m["total_customers_ever"], 4),
        "churn_rate_of_all_pct": lambda m: m.all()["overall_churn_rate_pct"],
        "share_of_customers_pct": lambda m: pct(m["total_customers_ever"], m.all()["total_customers_ever"], 4),
        "at_risk_mrr_active": lambda m: round_to(m.where("active", "at_risk").total("revenue"), 2),
        "avg_clv": lambda m: round_to(_mean(m, "revenue", "customers") * _mean(m, "lifespan", "customers"), 2),
        "blended_cac": lambda m: round_to(_mean(m, "cost", "new_customers"), 2),
        "clv_to_cac_ratio": lambda m: round_to(safe_div(m["avg_clv"], m["blended_cac"]), 2),
        "monthly_churn_rate_pct": lambda m: round_to(_mean(m, "rate", "months"), 4),
        "churn_rate_3mo_trailing_avg": lambda m: round_to(
            m.trailing_mean("monthly_churn_rate_pct", TRAILING_MONTHS, days_of(F.col("month_no"))), 4),
        "total_mrr": lambda m: round_to(m.total("mrr"), 2),
        "new_mrr": lambda m: F.coalesce(m.where("new").total("event_mrr"), F.lit(0)),
        "churned_mrr": lambda m: F.coalesce(m.where("lost").total("event_mrr"), F.lit(0)),
        "net_new_mrr": lambda m: round_to(m["new_mrr"] - m["churned_mrr"], 2),
        "net_new_mrr_trailing": lambda m: m.trailing(TRAILING_MONTHS)["net_new_mrr"],
        "new_mrr_last_month": lambda m: m.shift(1).where("new").total("event_mrr"),
        "new_mrr_yoy_pct": lambda m: pct(m["new_mrr"] - m.last_year().where("new").total("event_mrr"),
                                         m.last_year().where("new").total("event_mrr"), 4),
        "new_mrr_share_pct": lambda m: pct(m["new_mrr"], m.all()["new_mrr"], 4),
        "nrr_pct": lambda m: pct(m["total_mrr"] - m["new_mrr"], m.shift(1)["total_mrr"], 4),
    },
)


def _incidents(period: str, per_year: int) -> Model:
    return Model(
        bases={"crashes": row_count("incidents"), "injured": Base("incidents", lambda: F.col("persons_injured")),
               "killed": Base("incidents", lambda: F.col("persons_killed"))},
        filters={"known_cause": known_cause, "speeding": lambda: F.col("contributing_factor_1") == SPEEDING,
                 "injury": lambda: F.col("persons_injured") > 0},
        measures={
            "total_crashes": lambda m: m.total("crashes"),
            "total_killed": lambda m: m.total("killed"),
            "fatalities_per_1000_crashes": lambda m: round_to(
                safe_div(F.lit(1000.0) * m["total_killed"], m["total_crashes"]), 4),
            "injury_crashes": lambda m: m.where("injury")["total_crashes"],
            "pct_speeding": lambda m: pct(m.where("speeding")["total_crashes"], m["total_crashes"], 4),
            "pct_unspecified_cause": lambda m: pct(
                m["total_crashes"] - F.coalesce(m.where("known_cause")["total_crashes"], F.lit(0)), m["total_crashes"], 4),
            "all_borough_crashes": lambda m: m.all("borough")["total_crashes"],
            "all_crashes": lambda m: m.all("borough", period)["total_crashes"],
            "crashes_last_year": lambda m: m.last_year()["total_crashes"],
            "yoy_crash_change_pct": lambda m: _change(m, "total_crashes", m.last_year()),
            "yoy_all_boroughs_pct": lambda m: _change(m.all("borough"), "total_crashes", m.all("borough").last_year()),
            "killed_trailing_year": lambda m: m.trailing(per_year)["total_killed"],
        },
        period=period, per_year=per_year)


# The same measures by calendar month and by calendar year.
INCIDENTS_MONTHLY = _incidents("month_no", 12)
INCIDENTS_YEARLY = _incidents("crash_year", 1)
