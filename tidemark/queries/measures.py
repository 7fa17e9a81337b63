"""Measures in changed contexts and periods, subtotals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import round_to
from tidemark.operators.aggregate import rows
from tidemark.operators.contexts import subtotals
from tidemark.plans import churn as ch
from tidemark.plans import measures as ms
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, D, I, MEAN, N, P, Q, R

NO = "CAST(CAST(substr(month, 1, 4) AS INTEGER) * 12 + CAST(substr(month, 6, 2) AS INTEGER) - 1 AS INTEGER)"
EVENTS = """e AS (SELECT signup_month AS month, plan, monthly_revenue AS n, NULL AS c FROM subs_v WHERE signup_month IS NOT NULL
  UNION ALL SELECT churn_month, plan, NULL, monthly_revenue FROM subs_v WHERE is_churned = 1 AND churn_month IS NOT NULL)"""
RISK = "feature_usage_pct < 30 AND nps_score <= 6"
LIFE = MEAN("CAST(lifespan_months AS DECIMAL(10,1))")
CAC = R(f"SUM({D('new_customers')} * customer_acquisition_cost) / NULLIF({D('SUM(new_customers)')}, 0)")


def _facts(t) -> dict:
    return {"subs": t.subs_v, "events": ms.with_month_no(ch.mrr_events(t.subs_v, ["plan"])),
            "monthly": ms.with_month_no(t.monthly_revenue)}


@query("agg_21_retention_by_month", "subs_v", "monthly", sql=f"""
WITH {EVENTS}, f AS (SELECT month, SUM(n) AS n, SUM(c) AS c FROM e GROUP BY month),
m AS (SELECT {NO.replace("month,", "monthly.month,")} AS month_no, monthly.month, total_mrr, monthly_churn_rate_pct AS rate, COALESCE(n, 0) AS n, COALESCE(c, 0) AS c
  FROM monthly LEFT JOIN f ON f.month = monthly.month),
d AS (SELECT *, day(last_day(CAST(month || '-01' AS DATE))) AS days FROM m)
SELECT m.month_no, {D('m.total_mrr')} AS total_mrr, {D('m.n')} AS new_mrr, {R('m.n - m.c')} AS net_new_mrr,
       {R('m.rate', 4)} AS monthly_churn_rate_pct,
       {R('(SELECT SUM(d.rate * d.days) / SUM(d.days) FROM d WHERE d.month_no BETWEEN m.month_no - 2 AND m.month_no)', 4)}
         AS churn_rate_3mo_trailing_avg,
       {P('m.total_mrr - m.n', 'p.total_mrr', 4)} AS nrr_pct
FROM m LEFT JOIN m p ON p.month_no = m.month_no - 1""")
def _(t):
    facts = _facts(t)
    return ms.SUBSCRIPTIONS.evaluate(
        facts, ["total_mrr", "new_mrr", "net_new_mrr", "monthly_churn_rate_pct", "churn_rate_3mo_trailing_avg", "nrr_pct"],
        by=["month_no"], spine=facts["monthly"])


@query("agg_21_mrr_periods_by_plan", "subs_v", sql=f"""
WITH {EVENTS}, f AS (SELECT {NO} AS month_no, plan, SUM(n) AS n, SUM(c) AS c FROM e GROUP BY 1, 2),
w AS (SELECT a.month_no, a.plan, SUM(COALESCE(b.n, 0) - COALESCE(b.c, 0)) AS net
  FROM f a JOIN f b ON b.plan = a.plan AND b.month_no BETWEEN a.month_no - 2 AND a.month_no GROUP BY ALL),
s AS (SELECT month_no, SUM(n) AS n FROM f GROUP BY month_no)
SELECT f.month_no, f.plan, {D('COALESCE(f.n, 0)')} AS new_mrr, {R('COALESCE(f.n, 0) - COALESCE(f.c, 0)')} AS net_new_mrr,
       {R('w.net')} AS net_new_mrr_trailing, {D('p.n')} AS new_mrr_last_month,
       {P('COALESCE(f.n, 0) - y.n', 'y.n', 4)} AS new_mrr_yoy_pct, {P('COALESCE(f.n, 0)', 's.n', 4)} AS new_mrr_share_pct
FROM f JOIN w ON w.month_no = f.month_no AND w.plan = f.plan JOIN s ON s.month_no = f.month_no
LEFT JOIN f p ON p.plan = f.plan AND p.month_no = f.month_no - 1
LEFT JOIN f y ON y.plan = f.plan AND y.month_no = f.month_no - 12""")
def _(t):
    names = ["new_mrr", "net_new_mrr", "net_new_mrr_trailing", "new_mrr_last_month", "new_mrr_yoy_pct", "new_mrr_share_pct"]
    return ms.SUBSCRIPTIONS.evaluate(_facts(t), names, by=["month_no", "plan"])


@query("udf_2_unit_economics_by_plan", "subs_v", "monthly", sql=f"""
WITH cac AS (SELECT {CAC} AS blended_cac FROM monthly),
p AS (SELECT plan, {N} AS customers, {CW('is_churned = 1')} AS gone, {R(MEAN('monthly_revenue') + ' * ' + LIFE)} AS avg_clv,
             {R(f'SUM(CASE WHEN is_churned = 0 AND {RISK} THEN monthly_revenue END)')} AS risk FROM subs_v GROUP BY plan)
SELECT plan, customers AS total_customers_ever, NULLIF(gone, 0) AS churned_customers, {P('NULLIF(gone, 0)', 'customers', 4)}
         AS overall_churn_rate_pct, {P('(SELECT SUM(gone) FROM p)', '(SELECT SUM(customers) FROM p)', 4)} AS churn_rate_of_all_pct,
       {P('customers', '(SELECT SUM(customers) FROM p)', 4)} AS share_of_customers_pct, risk AS at_risk_mrr_active, avg_clv,
       blended_cac, {R(Q('avg_clv', 'blended_cac'))} AS clv_to_cac_ratio
FROM p CROSS JOIN cac""")
def _(t):
    names = ["total_customers_ever", "churned_customers", "overall_churn_rate_pct", "churn_rate_of_all_pct",
             "share_of_customers_pct", "at_risk_mrr_active", "avg_clv", "blended_cac", "clv_to_cac_ratio"]
    return ms.SUBSCRIPTIONS.evaluate(_facts(t), names, by=["plan"])


KNOWN = "contributing_factor_1 <> 'Unspecified'"


@query("agg_21_yoy_by_borough_year", "inc", sql=f"""
WITH c AS (SELECT borough, crash_year, {N} AS n, {CW('persons_injured > 0')} AS hurt,
    {CW("contributing_factor_1 = 'Unsafe Speed'")} AS fast FROM inc GROUP BY borough, crash_year),
y AS (SELECT crash_year, SUM(n) AS n FROM c GROUP BY crash_year)
SELECT c.borough, c.crash_year, c.n AS total_crashes, NULLIF(c.hurt, 0) AS injury_crashes, {I('y.n')} AS all_borough_crashes,
       {I('(SELECT SUM(n) FROM c)')} AS all_crashes, {P('NULLIF(c.fast, 0)', 'c.n', 4)} AS pct_speeding, p.n AS crashes_last_year,
       {P('c.n - p.n', 'p.n', 4)} AS yoy_crash_change_pct, {P('y.n - z.n', 'z.n', 4)} AS yoy_all_boroughs_pct
FROM c JOIN y ON y.crash_year = c.crash_year LEFT JOIN c p ON p.borough IS NOT DISTINCT FROM c.borough AND p.crash_year = c.crash_year - 1
LEFT JOIN y z ON z.crash_year = c.crash_year - 1""")
def _(t):
    names = ["total_crashes", "injury_crashes", "all_borough_crashes", "all_crashes", "pct_speeding", "crashes_last_year",
             "yoy_crash_change_pct", "yoy_all_boroughs_pct"]
    return ms.INCIDENTS_YEARLY.evaluate({"incidents": t.incidents}, names, by=["borough", "crash_year"])


@query("agg_21_yoy_by_month", "inc", sql=f"""
WITH c AS (SELECT CAST(crash_year * 12 + crash_month - 1 AS INTEGER) AS month_no, {N} AS n, SUM(persons_killed) AS k FROM inc GROUP BY 1)
SELECT c.month_no, c.n AS total_crashes, p.n AS crashes_last_year, {P('c.n - p.n', 'p.n', 4)} AS yoy_crash_change_pct,
       {I('(SELECT SUM(k) FROM c d WHERE d.month_no BETWEEN c.month_no - 11 AND c.month_no)')} AS killed_trailing_year,
       {R('CAST(1000 AS DOUBLE) * CAST(c.k AS DOUBLE) / c.n', 4)} AS fatalities_per_1000_crashes
FROM c LEFT JOIN c p ON p.month_no = c.month_no - 12""")
def _(t):
    monthly = t.incidents.withColumn("month_no", (F.col("crash_year") * 12 + F.col("crash_month") - 1).cast("int"))
    names = ["total_crashes", "crashes_last_year", "yoy_crash_change_pct", "killed_trailing_year", "fatalities_per_1000_crashes"]
    return ms.INCIDENTS_MONTHLY.evaluate({"incidents": monthly}, names, by=["month_no"])


@query("agg_21_kpi_cards", "inc", sql=f"""
SELECT {N} AS total_crashes, {I('SUM(persons_killed)')} AS total_killed,
       {P(f'COUNT(*) - {CW(KNOWN)}', N, 4)} AS pct_unspecified_cause FROM inc""")
def _(t):
    return ms.INCIDENTS_YEARLY.evaluate({"incidents": t.incidents}, ["total_crashes", "total_killed", "pct_unspecified_cause"])


@query("prf_2_profitability_cube", "lines", sql=f"""
SELECT CASE WHEN GROUPING(category) = 1 THEN '(all)' ELSE COALESCE(category, '(none)') END AS category,
       CASE WHEN GROUPING(channel) = 1 THEN '(all)' ELSE COALESCE(channel, '(none)') END AS channel,
       CASE WHEN GROUPING(order_month) = 1 THEN '(all)' ELSE COALESCE(order_month, '(none)') END AS order_month,
       CAST(3 - GROUPING(category) - GROUPING(channel) - GROUPING(order_month) AS INTEGER) AS level,
       {N} AS order_lines, {R('SUM(net_revenue)')} AS total_revenue, {R('SUM(net_revenue) - SUM(total_cost)')} AS total_profit
FROM lines GROUP BY CUBE (category, channel, order_month)""")
def _(t):
    return subtotals(t.lines, ["category", "channel", "order_month"], [
        rows().alias("order_lines"), round_to(F.sum("net_revenue"), 2).alias("total_revenue"),
        round_to(F.sum("net_revenue") - F.sum("total_cost"), 2).alias("total_profit")])
