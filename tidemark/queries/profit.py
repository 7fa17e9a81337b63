"""Order profitability and marketing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans import marketing as mk
from tidemark.plans import profit as pf
from tidemark.plans.segments import reason_share, top_reason_per
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, D, I, MEAN, N, P, Q, R
from tidemark.runtime import stage

RET = "is_returned = 'Yes'"
MARGIN = P("SUM(net_revenue) - SUM(total_cost)", "SUM(net_revenue)", 1)
BM = "bm AS (SELECT " + Q("SUM(net_revenue) - SUM(total_cost)", "SUM(net_revenue)") + " AS margin FROM lines)"
LOST = f"SUM(CASE WHEN {RET} THEN gross_revenue ELSE 0 END)"

FULL_CUT, HALF_CUT, WEAK = "5-LOW", "4-NOT SPECIFIED", 3.9


@query("prf_1_order_profit_view", "lines", sql=f"""
SELECT order_id, line_no, supplier_id, order_date, order_month, product_id, category, channel, quantity,
       {D('gross_revenue')} AS gross_revenue, {D('discount_amount')} AS discount_amount,
       {D('shipping_cost')} AS shipping_cost, {D('product_cost')} AS product_cost,
       {D('net_revenue')} AS net_revenue, {D('total_cost')} AS total_cost
FROM lines""")
def _(t):
    return t.lines.select("order_id", "line_no", "supplier_id", "order_date", "order_month", "product_id", "category",
                          "channel", "quantity", "gross_revenue", "discount_amount", "shipping_cost",
                          "product_cost", "net_revenue", "total_cost")


def _profitability(by: str) -> str:
    return f"""
SELECT {by}, {N} AS order_lines, {R('SUM(net_revenue)')} AS total_revenue, {R('SUM(total_cost)')} AS total_cost,
       {R('SUM(net_revenue) - SUM(total_cost)')} AS total_profit, {MARGIN} AS profit_margin_pct,
       {R(MEAN('gross_revenue'))} AS avg_order_value, {R(MEAN('net_revenue - total_cost'))} AS avg_profit_per_order
FROM lines GROUP BY {by}"""


@query("prf_2_profitability", "lines", sql=_profitability("category"))
def _(t):
    return pf.profitability(t.lines, ["category"]).orderBy(F.col("profit_margin_pct").desc())


@query("prf_2_profitability_channel", "lines", sql=_profitability("channel"))
def _(t):
    return pf.profitability(t.lines, ["channel"]).orderBy(F.col("profit_margin_pct").desc())


@query("prf_3_cost_structure", "lines", sql=f"""
SELECT category, {R('SUM(gross_revenue)')} AS gross_revenue,
       {P('SUM(product_cost)', 'SUM(gross_revenue)', 1)} AS product_cost_pct_of_gross,
       {P('SUM(shipping_cost)', 'SUM(gross_revenue)', 1)} AS shipping_pct_of_gross,
       {P('SUM(platform_fee)', 'SUM(gross_revenue)', 1)} AS platform_fee_pct_of_gross,
       {P('SUM(discount_amount)', 'SUM(gross_revenue)', 1)} AS discount_pct_of_gross,
       {P(LOST, 'SUM(gross_revenue)', 1)} AS revenue_lost_to_returns_pct
FROM lines GROUP BY category""")
def _(t):
    return pf.cost_structure(t.lines, ["category"])


def _return_rate(by: str) -> str:
    return f"""
SELECT {by}, {N} AS order_lines, {CW(RET)} AS returned_lines, {P(CW(RET), N, 1)} AS return_rate_pct,
       {MARGIN} AS profit_margin_pct
FROM lines GROUP BY {by}"""


@query("prf_4_return_rate", "lines", sql=_return_rate("category"))
def _(t):
    return pf.return_rate(t.lines, ["category"])


@query("prf_4_return_rate_channel", "lines", sql=_return_rate("channel"))
def _(t):
    return pf.return_rate(t.lines, ["channel"])


@query("prf_5_discount_profile", "lines", sql=f"""
SELECT category, {P('SUM(discount_amount)', 'SUM(gross_revenue)', 1)} AS avg_discount_rate_pct,
       {P(CW('discount_amount > 0'), N, 1)} AS pct_orders_discounted
FROM lines GROUP BY category""")
def _(t):
    return pf.discount_profile(t.lines, ["category"])


@query("prf_6_fee_drag", "lines", sql=f"""
SELECT channel, {R('SUM(gross_revenue)')} AS gross_revenue, {R('SUM(platform_fee)')} AS total_platform_fees,
       {P('SUM(platform_fee)', 'SUM(gross_revenue)')} AS platform_fee_pct_of_gross, {MARGIN} AS actual_margin_pct,
       {P('SUM(net_revenue) - (SUM(total_cost) - SUM(platform_fee))', 'SUM(net_revenue)', 1)}
         AS margin_pct_excl_platform_fee
FROM lines GROUP BY channel""")
def _(t):
    return pf.fee_drag(t.lines, ["channel"])


@query("prf_7_margin_matrix", "lines", sql=f"""
SELECT channel, category, {N} AS order_lines, {MARGIN} AS profit_margin_pct
FROM lines GROUP BY channel, category HAVING COUNT(*) >= 30""")
def _(t):
    return pf.margin_matrix(t.lines, "channel", "category", 30).orderBy("channel", "profit_margin_pct")


@query("prf_8_returns_summary", "lines", sql=f"""
SELECT {N} AS total_order_lines, {CW(RET)} AS returned_lines, {P(CW(RET), N, 1)} AS overall_return_rate_pct,
       {R(LOST)} AS gross_revenue_lost_to_returns,
       {R(f"SUM(CASE WHEN {RET} THEN shipping_cost + platform_fee + return_processing_cost ELSE 0 END)")}
         AS additional_costs_still_incurred_on_returns
FROM lines""")
def _(t):
    return pf.returns_summary(t.lines)


def _returns_by(by: str) -> str:
    return f"""
SELECT {by}, {N} AS order_lines, {P(CW(RET), N, 1)} AS return_rate_pct, {R(LOST)} AS revenue_lost_to_returns
FROM lines GROUP BY {by}"""


@query("prf_9_returns_by", "lines", sql=_returns_by("category"))
def _(t):
    return pf.returns_by(t.lines, ["category"])


@query("prf_9_returns_by_channel", "lines", sql=_returns_by("channel"))
def _(t):
    return pf.returns_by(t.lines, ["channel"])


@query("prf_10_return_reason_share", "lines", sql=f"""
SELECT return_reason, {N} AS occurrences,
       {P('COUNT(*)', f"(SELECT COUNT(*) FROM lines WHERE {RET})", 1)} AS pct_of_all_returns
FROM lines WHERE {RET} GROUP BY return_reason""")
def _(t):
    back = t.lines.where(pf.returned())
    return reason_share(back, "return_reason", "occurrences", "pct_of_all_returns", 1)


@query("prf_11_top_return_reason_per", "lines", sql=f"""
SELECT category, return_reason, occurrences FROM (
  SELECT category, return_reason, {N} AS occurrences,
         RANK() OVER (PARTITION BY category ORDER BY COUNT(*) DESC) AS rnk
  FROM lines WHERE {RET} GROUP BY category, return_reason) WHERE rnk = 1""")
def _(t):
    return top_reason_per(t.lines.where(pf.returned()), "category", "return_reason", "occurrences")


@query("prf_12_return_rate_trend", "lines", sql=f"""
SELECT order_month, {N} AS order_lines, {P(CW(RET), N, 1)} AS return_rate_pct FROM lines GROUP BY order_month""")
def _(t):
    return pf.return_rate_trend(t.lines).orderBy("order_month")


ROAS = Q("SUM(attributed_revenue)", "SUM(spend)")


@query("mkt_1_platform_efficiency", "marketing", sql=f"""
SELECT platform, {R('SUM(spend)')} AS total_spend, {R('SUM(attributed_revenue)')} AS total_attributed_revenue,
       {R(ROAS)} AS roas, {R(Q('SUM(spend)', 'SUM(conversions)'))} AS cost_per_acquisition,
       {R(Q('SUM(spend)', 'SUM(clicks)'))} AS cost_per_click,
       {I('SUM(clicks)')} AS total_clicks, {I('SUM(conversions)')} AS total_conversions
FROM marketing GROUP BY platform""")
def _(t):
    return mk.platform_efficiency(t.marketing).orderBy(F.col("roas").desc())


@query("mkt_2_profit_adjusted_roi", "lines", "marketing", sql=f"""
WITH {BM}, p AS (SELECT platform, {D('SUM(spend)')} AS s, {D('SUM(attributed_revenue)')} AS r
                 FROM marketing GROUP BY platform)
SELECT platform, {R('s')} AS total_spend, {R(Q('r', 's'))} AS roas, {R('r * margin')} AS estimated_gross_profit,
       {R('r * margin - s')} AS net_profit_after_ad_spend,
       CASE WHEN r * margin - s > 0 THEN 'Profitable' ELSE 'Losing money after ad spend' END AS verdict
FROM p CROSS JOIN bm""")
def _(t):
    return mk.profit_adjusted_roi(t.marketing, pf.blended_margin(t.lines))


@query("mkt_3_roas_trend", "marketing", sql=f"""
SELECT month, platform, {R('spend')} AS spend, {R('attributed_revenue')} AS attributed_revenue,
       {R(Q('attributed_revenue', 'spend'))} AS roas
FROM marketing""")
def _(t):
    return mk.roas_trend(t.marketing).orderBy("platform", "month")


@query("mkt_4_recent_vs_full", "marketing", sql=f"""
WITH cut AS (SELECT strftime(strptime(MAX(month) || '-01', '%Y-%m-%d') - INTERVAL 2 MONTH, '%Y-%m') AS m FROM marketing),
recent AS (SELECT platform, {ROAS} AS x FROM marketing WHERE month >= (SELECT m FROM cut) GROUP BY platform),
everything AS (SELECT platform, {ROAS} AS x FROM marketing GROUP BY platform)
SELECT f.platform, {R('f.x')} AS full_period_roas, {R('r.x')} AS last_3mo_roas, {R('r.x - f.x')} AS roas_change
FROM everything f JOIN recent r ON r.platform = f.platform""")
def _(t):
    return mk.recent_vs_full(stage(t.marketing), 3)


@query("mkt_5_budget_target", "marketing", sql=f"""
SELECT {R('SUM(spend)')} AS total_marketing_spend, {R(f"{D('SUM(spend)')} * CAST(0.2 AS DOUBLE)")} AS cut_target
FROM marketing""")
def _(t):
    return mk.budget_target(t.marketing, 0.2)


def _scenario(label: str, where: str, share: str) -> str:
    return f"""
WITH {BM}, x AS (
  SELECT {N} AS months_flagged, MIN(month) AS a, MAX(month) AS b, {D('SUM(spend)')} AS scope,
         {MEAN(Q('attributed_revenue', 'spend'))} AS avg_roas,
         {D('SUM(spend)')} * {share} AS saved, {D('SUM(attributed_revenue)')} * {share} AS forgone
  FROM marketing WHERE {where})
SELECT '{label}' AS recommendation, months_flagged, a AS earliest_flagged_month, b AS latest_flagged_month,
       {R('scope')} AS spend_in_flagged_months, {R('avg_roas')} AS avg_roas_in_flagged_months,
       {R('saved')} AS spend_saved, {R('forgone')} AS attributed_revenue_forgone,
       {R('forgone * margin')} AS estimated_gross_profit_forgone,
       {R('saved - forgone * margin')} AS net_profit_impact_of_cutting
FROM x CROSS JOIN bm"""


WEAK_SQL = f"platform = '{HALF_CUT}' AND {Q('attributed_revenue', 'spend')} < {WEAK}"


@query("mkt_6_cut_scenario", "lines", "marketing",
       sql=_scenario(f"Eliminate {FULL_CUT}", f"platform = '{FULL_CUT}'", "CAST(1 AS DOUBLE)"))
def _(t):
    return mk.cut_scenario(t.marketing, pf.blended_margin(t.lines), f"Eliminate {FULL_CUT}",
                           F.col("platform") == FULL_CUT)


@query("mkt_7_cut_weak_months", "lines", "marketing",
       sql=_scenario(f"Trim {HALF_CUT} in weak months", WEAK_SQL, "CAST(0.5 AS DOUBLE)"))
def _(t):
    return mk.cut_scenario(t.marketing, pf.blended_margin(t.lines), f"Trim {HALF_CUT} in weak months",
                           (F.col("platform") == HALF_CUT) & mk.weak(WEAK), 0.5)


@query("mkt_8_combined_scenarios", "lines", "marketing", sql=f"""
WITH {BM},
a AS (SELECT {D('SUM(spend)')} AS s, {D('SUM(attributed_revenue)')} AS r FROM marketing WHERE platform = '{FULL_CUT}'),
b AS (SELECT {D('SUM(spend)')} * 0.5::DOUBLE AS s, {D('SUM(attributed_revenue)')} * 0.5::DOUBLE AS r
      FROM marketing WHERE {WEAK_SQL})
SELECT {R('a.s + b.s')} AS total_spend_saved,
       {R(f"(SELECT {D('SUM(spend)')} * CAST(0.2 AS DOUBLE) FROM marketing)")} AS cut_target,
       {R('(a.s + b.s) - (a.r + b.r) * margin')} AS estimated_net_profit_impact
FROM a CROSS JOIN b CROSS JOIN bm""")
def _(t):
    levers = [(F.col("platform") == FULL_CUT, 1.0), ((F.col("platform") == HALF_CUT) & mk.weak(WEAK), 0.5)]
    return mk.combined_scenarios(t.marketing, pf.blended_margin(t.lines), levers)


@query("mkt_9_blended_margin", "lines", sql=f"WITH {BM} SELECT {R('margin', 9)} AS margin FROM bm")
def _(t):
    from tidemark.functions import round_to

    return pf.blended_margin(t.lines).select(round_to("margin", 9).alias("margin"))


