"""Subscription and churn analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import ordinal
from tidemark.operators.aggregate import Calculated
from tidemark.plans import churn as ch
from tidemark.plans import segments as sg
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, D, I, MEAN, N, P, Q, R
from tidemark.runtime import stage
from tidemark.sources.dims import COMPANY_SIZE_ORDER, calendar_of, months_of

CH = I("SUM(is_churned)")
RATE = P("SUM(is_churned)", "COUNT(*)")
LIFE = MEAN("CAST(lifespan_months AS DECIMAL(10,1))")
CLV = f"{MEAN('monthly_revenue')} * {LIFE}"
RISK = "feature_usage_pct < 30 AND nps_score <= 6"
CAC = R(f"SUM({D('new_customers')} * customer_acquisition_cost) / NULLIF({D('SUM(new_customers)')}, 0)")


@query("chn_1_subscription_view", "subs_v", sql=f"""
SELECT customer_id, plan, billing_cycle, company_size, region, {D('monthly_revenue')} AS monthly_revenue,
       signup_date, signup_month, is_churned, churn_date, churn_month, churn_reason, lifespan_months
FROM subs_v""")
def _(t):
    return t.subs_v.select("customer_id", "plan", "billing_cycle", "company_size", "region", "monthly_revenue",
                           "signup_date", "signup_month", "is_churned", "churn_date", "churn_month", "churn_reason",
                           "lifespan_months")


@query("chn_2_lifetime_churn_rate", "subs_v",
       sql=f"SELECT {N} AS total_customers_ever, {CH} AS total_churned, {RATE} AS lifetime_churn_rate_pct FROM subs_v")
def _(t):
    return ch.lifetime_churn_rate(t.subs_v)


@query("chn_3_monthly_churn_series", "monthly", sql=f"""
SELECT month, {I('total_active_customers')} AS total_active_customers, {I('new_customers')} AS new_customers,
       {I('churned_customers')} AS churned_customers, monthly_churn_rate_pct,
       {R('AVG(monthly_churn_rate_pct) OVER (ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')}
         AS trailing_avg_churn_pct
FROM monthly""")
def _(t):
    return ch.monthly_churn_series(t.monthly_revenue).orderBy("month")


@query("chn_4_yearly_churn", "monthly", sql=f"""
SELECT substr(month, 1, 4) AS year, {R('AVG(monthly_churn_rate_pct)')} AS avg_monthly_churn_rate_pct,
       {I('SUM(churned_customers)')} AS total_churned_that_year, {I('SUM(new_customers)')} AS total_new_that_year
FROM monthly GROUP BY substr(month, 1, 4)""")
def _(t):
    return ch.yearly_churn(t.monthly_revenue).orderBy("year")


@query("chn_5_largest_swings", "monthly", sql=f"""
WITH l AS (SELECT month, monthly_churn_rate_pct, LAG(monthly_churn_rate_pct) OVER (ORDER BY month) AS p FROM monthly)
SELECT month, monthly_churn_rate_pct, p AS prev_month_churn_pct, {R('monthly_churn_rate_pct - p')} AS pct_point_change
FROM l WHERE p IS NOT NULL ORDER BY ABS({R('monthly_churn_rate_pct - p')}) DESC, month LIMIT 5""")
def _(t):
    return ch.largest_swings(t.monthly_revenue, 5)


def _rate(by: str, extra: str = "") -> str:
    return f"SELECT {by}, {N} AS customers, {CH} AS churned, {RATE} AS churn_rate_pct{extra} FROM subs_v GROUP BY {by}"


@query("chn_6_segment_rate_plan", "subs_v", sql=_rate("plan", f", {R(MEAN('monthly_revenue'))} AS avg_mrr"))
def _(t):
    return sg.segment_rate(t.subs_v, ["plan"], means={"avg_mrr": "monthly_revenue"})


@query("chn_6_segment_rate_billing", "subs_v", sql=_rate("billing_cycle"))
def _(t):
    return sg.segment_rate(t.subs_v, ["billing_cycle"])


@query("chn_6_segment_rate_plan_billing", "subs_v", sql=_rate("plan, billing_cycle"))
def _(t):
    return sg.segment_rate(t.subs_v, ["plan", "billing_cycle"]).orderBy("plan", "billing_cycle")


@query("chn_6_segment_rate_region", "subs_v", sql=_rate("region"))
def _(t):
    return sg.segment_rate(t.subs_v, ["region"])


@query("chn_6_segment_rate_company_size", "subs_v", sql=_rate("company_size"))
def _(t):
    return sg.segment_rate(t.subs_v, ["company_size"]).orderBy(ordinal("company_size", COMPANY_SIZE_ORDER))


CUTS = [["billing_cycle"], ["billing_cycle", "plan"], ["company_size"], ["plan"], ["region"]]


def _cuts_sql() -> str:
    names = ["billing_cycle", "company_size", "plan", "region"]
    parts = []
    for cut in CUTS:
        cols = ", ".join(c if c in cut else f"CAST(NULL AS VARCHAR) AS {c}" for c in names)
        label = " x ".join(sorted(cut))
        parts.append(f"SELECT {cols}, '{label}' AS cut, {N} AS customers, {CH} AS churned, {RATE} AS churn_rate_pct "
                     f"FROM subs_v GROUP BY {', '.join(cut)}")
    return "\nUNION ALL\n".join(parts)


@query("chn_6_segment_rate_all_cuts", "subs_v", sql=_cuts_sql())
def _(t):
    return sg.segment_rate_cuts(t.subs_v, CUTS)


@query("chn_7_riskiest_segments", "subs_v", sql=f"""
SELECT plan, company_size, {N} AS customers, {CH} AS churned, {RATE} AS churn_rate_pct
FROM subs_v GROUP BY plan, company_size HAVING COUNT(*) >= 15
ORDER BY {RATE} DESC, plan, company_size LIMIT 10""")
def _(t):
    return sg.riskiest_segments(t.subs_v, ["plan", "company_size"], 15, 10)


@query("chn_8_reason_share", "subs_v", sql=f"""
SELECT churn_reason, {N} AS churned_customers,
       {P('COUNT(*)', '(SELECT COUNT(*) FROM subs_v WHERE is_churned = 1)')} AS pct_of_all_churn
FROM subs_v WHERE is_churned = 1 GROUP BY churn_reason""")
def _(t):
    return sg.reason_share(t.subs_v.where(F.col("is_churned") == 1), "churn_reason", "churned_customers",
                           "pct_of_all_churn")


def _top_reason(by: str) -> str:
    return f"""
SELECT {by}, churn_reason, churned_customers FROM (
  SELECT {by}, churn_reason, {N} AS churned_customers, RANK() OVER (PARTITION BY {by} ORDER BY COUNT(*) DESC) AS rnk
  FROM subs_v WHERE is_churned = 1 GROUP BY {by}, churn_reason) WHERE rnk = 1"""


@query("chn_9_top_reason_per_plan", "subs_v", sql=_top_reason("plan"))
def _(t):
    return sg.top_reason_per(t.subs_v.where(F.col("is_churned") == 1), "plan", "churn_reason", "churned_customers")


@query("chn_9_top_reason_per_company_size", "subs_v", sql=_top_reason("company_size"))
def _(t):
    top = sg.top_reason_per(t.subs_v.where(F.col("is_churned") == 1), "company_size", "churn_reason",
                            "churned_customers")
    return top.orderBy(ordinal("company_size", COMPANY_SIZE_ORDER), "churn_reason")


@query("chn_10_reason_matrix", "subs_v", sql=f"""
SELECT plan, churn_reason, {N} AS churned_customers,
       {P('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY plan)')} AS pct_within_plan
FROM subs_v WHERE is_churned = 1 GROUP BY plan, churn_reason""")
def _(t):
    return sg.reason_matrix(t.subs_v.where(F.col("is_churned") == 1), "plan", "churn_reason", "churned_customers",
                            "pct_within_plan")


@query("chn_11_blended_cac", "monthly", sql=f"SELECT {CAC} AS blended_cac FROM monthly")
def _(t):
    return ch.blended_cac(t.monthly_revenue)


def _clv(where: str) -> str:
    return f"""
SELECT plan, {N} AS customers, {R(MEAN('monthly_revenue'))} AS avg_mrr, {R(LIFE, 1)} AS avg_lifespan_months,
       {R(CLV)} AS avg_clv
FROM subs_v {where} GROUP BY plan"""


@query("chn_12_clv_by", "subs_v", sql=_clv(""))
def _(t):
    return ch.clv_by(t.subs_v)


@query("chn_12_clv_by_churned_only", "subs_v", sql=_clv("WHERE is_churned = 1"))
def _(t):
    return ch.clv_by(t.subs_v, churned_only=True)


@query("chn_13_censoring_share", "subs_v", sql=f"""
SELECT plan, {N} AS customers, {CW('is_churned = 0')} AS still_active, {P(CW('is_churned = 0'), N, 1)} AS pct_still_active
FROM subs_v GROUP BY plan""")
def _(t):
    return ch.censoring_share(t.subs_v)


@query("chn_14_clv_to_cac", "subs_v", "monthly", sql=f"""
WITH clv AS (SELECT plan, {R(CLV)} AS avg_clv FROM subs_v GROUP BY plan),
cac AS (SELECT {CAC} AS blended_cac FROM monthly)
SELECT plan, avg_clv, blended_cac, {R(Q('avg_clv', 'blended_cac'))} AS clv_to_cac_ratio FROM clv CROSS JOIN cac""")
def _(t):
    return ch.clv_to_cac(t.subs_v, t.monthly_revenue)


NEW_MRR = "n AS (SELECT signup_month AS month, SUM(monthly_revenue) AS new_mrr FROM subs_v GROUP BY signup_month)"
LOST_MRR = ("c AS (SELECT churn_month AS month, SUM(monthly_revenue) AS churned_mrr FROM subs_v "
            "WHERE is_churned = 1 GROUP BY churn_month)")


@query("chn_15_net_new_mrr", "subs_v", "monthly", sql=f"""
WITH {NEW_MRR}, {LOST_MRR}
SELECT m.month, {D('m.total_mrr')} AS total_mrr, {D('COALESCE(n.new_mrr, 0)')} AS new_mrr,
       {D('COALESCE(c.churned_mrr, 0)')} AS churned_mrr,
       {R('COALESCE(n.new_mrr, 0) - COALESCE(c.churned_mrr, 0)')} AS net_new_mrr
FROM monthly m LEFT JOIN n ON n.month = m.month LEFT JOIN c ON c.month = m.month""")
def _(t):
    return ch.net_new_mrr(t.monthly_revenue, t.subs_v).orderBy("month")


@query("chn_16_mom_anomaly", "monthly", sql=f"""
WITH l AS (SELECT month, total_mrr, LAG(total_mrr) OVER (ORDER BY month) AS p FROM monthly),
x AS (SELECT month, total_mrr, {P('total_mrr - p', 'p')} AS chg FROM l),
s AS (SELECT AVG(chg) AS a, STDDEV_POP(chg) AS sd FROM x WHERE chg IS NOT NULL)
SELECT month, {D('total_mrr')} AS total_mrr, chg AS mom_pct_change,
       CASE WHEN ABS(chg - a) > 1.5 * sd THEN 'FLAGGED' ELSE '' END AS flag
FROM x CROSS JOIN s WHERE chg IS NOT NULL""")
def _(t):
    return ch.mom_anomaly(t.monthly_revenue).orderBy("month")


@query("chn_17_nrr", "subs_v", "monthly", sql=f"""
WITH {NEW_MRR}, j AS (
  SELECT m.month, m.total_mrr, LAG(m.total_mrr) OVER (ORDER BY m.month) AS p, COALESCE(n.new_mrr, 0) AS new_mrr
  FROM monthly m LEFT JOIN n ON n.month = m.month)
SELECT month, {D('p')} AS prev_total_mrr, {D('new_mrr')} AS new_mrr,
       {R('total_mrr - new_mrr')} AS retained_mrr_from_existing_base, {P('total_mrr - new_mrr', 'p')} AS nrr_pct
FROM j WHERE p IS NOT NULL""")
def _(t):
    return ch.nrr(t.monthly_revenue, t.subs_v).orderBy("month")


@query("chn_17_nrr_opening_balance", "subs_v", "monthly", sql=f"""
WITH {NEW_MRR}, j AS (
  SELECT m.month, m.total_mrr, LAG(m.total_mrr) OVER (ORDER BY m.month) AS p,
         COALESCE(LAG(COALESCE(n.new_mrr, 0)) OVER (ORDER BY m.month), 0) AS new_mrr
  FROM monthly m LEFT JOIN n ON n.month = m.month)
SELECT month, {D('p')} AS prev_total_mrr, {D('new_mrr')} AS new_mrr,
       {R('total_mrr - new_mrr')} AS retained_mrr_from_existing_base, {P('total_mrr - new_mrr', 'p')} AS nrr_pct
FROM j WHERE p IS NOT NULL""")
def _(t):
    return ch.nrr(t.monthly_revenue, t.subs_v, opening_balance=True).orderBy("month")


@query("chn_17_nrr_calendar", "subs_v", "monthly", sql=f"""
WITH {NEW_MRR}, j AS (
  SELECT m.month, m.total_mrr, b.total_mrr AS p, COALESCE(n.new_mrr, 0) AS new_mrr
  FROM monthly m LEFT JOIN n ON n.month = m.month
  LEFT JOIN monthly b ON b.month = strftime(CAST(m.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m'))
SELECT month, {D('p')} AS prev_total_mrr, {D('new_mrr')} AS new_mrr,
       {R('total_mrr - new_mrr')} AS retained_mrr_from_existing_base, {P('total_mrr - new_mrr', 'p')} AS nrr_pct
FROM j WHERE p IS NOT NULL""")
def _(t):
    # the series is read twice by the shift: one row per month, written once
    return ch.nrr(stage(t.monthly_revenue), t.subs_v, calendar=True).orderBy("month")


@query("chn_18_status_profile", "subs_v", sql=f"""
SELECT CASE WHEN is_churned = 1 THEN 'Churned' ELSE 'Active' END AS status, {N} AS customers,
       {R(MEAN('feature_usage_pct'), 1)} AS avg_feature_usage_pct, {R(MEAN('nps_score'), 1)} AS avg_nps_score,
       {R(MEAN('support_tickets_12mo'), 1)} AS avg_support_tickets_12mo
FROM subs_v GROUP BY is_churned""")
def _(t):
    return ch.status_profile(t.subs_v)


USAGE_BAND = """CASE WHEN feature_usage_pct < 20 THEN '0-19%' WHEN feature_usage_pct < 40 THEN '20-39%'
     WHEN feature_usage_pct < 60 THEN '40-59%' WHEN feature_usage_pct < 80 THEN '60-79%' ELSE '80-100%' END"""
NPS_BAND = """CASE WHEN nps_score <= 6 THEN 'Detractor (0-6)' WHEN nps_score <= 8 THEN 'Passive (7-8)'
     ELSE 'Promoter (9-10)' END"""


@query("chn_19_rate_by_band_usage", "subs_v", sql=f"""
SELECT {USAGE_BAND} AS usage_band, {N} AS customers, {CH} AS churned, {RATE} AS churn_rate_pct
FROM subs_v GROUP BY 1""")
def _(t):
    return sg.rate_by_band(t.subs_v, ch.usage_band(), "usage_band").orderBy("usage_band")


@query("chn_19_rate_by_band_nps", "subs_v", sql=f"""
SELECT {NPS_BAND} AS nps_band, {N} AS customers, {CH} AS churned, {RATE} AS churn_rate_pct
FROM subs_v GROUP BY 1""")
def _(t):
    return sg.rate_by_band(t.subs_v, ch.nps_band(), "nps_band")


@query("chn_20_threshold_from_churned", "subs_v", sql=f"""
SELECT {R(MEAN('feature_usage_pct'), 1)} AS avg_usage_at_churn,
       (SELECT feature_usage_pct FROM subs_v WHERE is_churned = 1 ORDER BY feature_usage_pct
        LIMIT 1 OFFSET (SELECT CAST(FLOOR(0.6::DOUBLE * COUNT(*)) AS BIGINT) FROM subs_v WHERE is_churned = 1))
         AS usage_p60_at_churn
FROM subs_v WHERE is_churned = 1""")
def _(t):
    return ch.threshold_from_churned(t.subs_v)


@query("chn_21_at_risk_summary", "subs_v", sql=f"""
SELECT {N} AS active_customers, {CW(RISK)} AS at_risk_customers, {P(CW(RISK), N)} AS pct_of_active_base,
       {R(f'SUM(CASE WHEN {RISK} THEN monthly_revenue ELSE 0 END)')} AS at_risk_mrr
FROM subs_v WHERE is_churned = 0""")
def _(t):
    return ch.at_risk_summary(t.subs_v)


@query("chn_21_at_risk_by", "subs_v", sql=f"""
SELECT plan, {N} AS active_customers, {CW(RISK)} AS at_risk_customers, {P(CW(RISK), N)} AS pct_at_risk
FROM subs_v WHERE is_churned = 0 GROUP BY plan""")
def _(t):
    return ch.at_risk_by(t.subs_v)


@query("chn_22_at_risk_list", "subs_v", sql=f"""
SELECT customer_id, plan, {D('monthly_revenue')} AS monthly_revenue, nps_score, feature_usage_pct
FROM subs_v WHERE is_churned = 0 AND {RISK}""")
def _(t):
    return ch.at_risk_list(t.subs_v)


def _measures(by: str) -> str:
    gone, here = "churned = 'Yes'", "churned = 'No'"
    head = f"{by}, " if by else ""
    tail = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {head}{N} AS total_customers_ever, {CW(here)} AS active_customers, {CW(gone)} AS churned_customers,
       {P(CW(gone), N, 6)} AS overall_churn_rate_pct, {R(LIFE, 6)} AS avg_lifespan_months, {R(CLV, 4)} AS avg_clv,
       {CW(f'{here} AND {RISK}')} AS at_risk_customers_active,
       {R(f'SUM(CASE WHEN {here} AND {RISK} THEN monthly_revenue ELSE 0 END)')} AS at_risk_mrr_active,
       {P(CW(f'{here} AND {RISK}'), CW(here), 6)} AS at_risk_pct_of_active_base,
       {R(MEAN('feature_usage_pct'), 6)} AS avg_feature_usage_pct, {R(MEAN('nps_score'), 6)} AS avg_nps_score
FROM subs_v{tail}"""


@query("udf_2_measures_total", "subs_v", sql=_measures(""))
def _(t):
    return ch.SUBSCRIPTION_MEASURES.evaluate(t.subs_v)


@query("udf_2_measures_by_plan", "subs_v", sql=_measures("plan"))
def _(t):
    return ch.SUBSCRIPTION_MEASURES.evaluate(t.subs_v, by=["plan"])


@query("udf_2_measures_monthly_by_year", "monthly", sql=f"""
SELECT substr(month, 1, 4) AS year, {R('AVG(monthly_churn_rate_pct)', 6)} AS monthly_churn_rate_pct,
       {R('SUM(total_mrr)')} AS total_mrr,
       {R(f"SUM({D('new_customers')} * customer_acquisition_cost) / NULLIF({D('SUM(new_customers)')}, 0)", 6)}
         AS blended_cac
FROM monthly GROUP BY substr(month, 1, 4)""")
def _(t):
    yearly = t.monthly_revenue.withColumn("year", F.substring("month", 1, 4))
    return ch.MONTHLY_MEASURES.evaluate(yearly, by=["year"])


@query("agg_21_mrr_measures", "subs_v", sql=f"""
WITH e AS (SELECT signup_month AS month, plan, monthly_revenue AS n, 0 AS c FROM subs_v
  UNION ALL SELECT churn_month, plan, 0, monthly_revenue FROM subs_v WHERE is_churned = 1)
SELECT month, plan, {D('SUM(n)')} AS new_mrr, {D('SUM(c)')} AS churned_mrr, {R('SUM(n) - SUM(c)')} AS net_new_mrr,
       {D('SUM(SUM(n)) OVER (PARTITION BY month)')} AS new_mrr_all_plans
FROM e WHERE month IS NOT NULL GROUP BY month, plan""")
def _(t):
    return ch.MRR_MEASURES.evaluate(ch.mrr_events(t.subs_v, ["plan"]), by=["month", "plan"],
                                    calculated={"new_mrr_all_plans": Calculated("new_mrr", all_of=("plan",))})


@query("jon_13_role_playing_date", "subs_v", sql=f"""
WITH cal AS (SELECT DISTINCT strftime(d, '%Y-%m') AS month FROM (
  SELECT UNNEST(generate_series(MIN(signup_date), MAX(signup_date), INTERVAL 1 DAY)) AS d FROM subs_v)),
{NEW_MRR}, {LOST_MRR}
SELECT cal.month, {D('n.new_mrr')} AS new_mrr, {D('c.churned_mrr')} AS churned_mrr,
       {R('COALESCE(n.new_mrr, 0) - COALESCE(c.churned_mrr, 0)')} AS net_new_mrr
FROM cal LEFT JOIN n ON n.month = cal.month LEFT JOIN c ON c.month = cal.month""")
def _(t):
    return ch.role_playing_mrr(months_of(calendar_of(t.subs, "signup_date")), t.subs_v)


