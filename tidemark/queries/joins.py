"""Joins and subqueries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import pct, round_to, safe_div
from tidemark.operators.aggregate import mean, rows, share_of_total
from tidemark.operators.window import period_shift, top_k
from tidemark.plans import incidents as ic
from tidemark.plans import marketing as mk
from tidemark.plans import profit as pf
from tidemark.plans.churn import mrr_events
from tidemark.queries.base import query
from tidemark.queries.oracle import D, I, MEAN, N, P, Q, R
from tidemark.runtime import attach, stage
from tidemark.sources.dims import COMPANY_SIZE_ORDER, ordered_dim


@query("jon_1_inner_many_to_one", "lines_raw", "products", sql=f"""
SELECT p.category, {N} AS n, {D('SUM(p.list_price)')} AS list_value
FROM lines_raw l JOIN products p ON p.product_id = l.product_id GROUP BY p.category""")
def _(t):
    joined = t.order_lines_raw.select("product_id").join(t.products, "product_id")
    return joined.groupBy("category").agg(rows().alias("n"), F.sum("list_price").alias("list_value"))


@query("jon_2_left_join_to_aggregate", sql=f"""
WITH m AS (SELECT o_custkey, {MEAN('CAST(o_totalprice AS DECIMAL(18,2))')} AS m FROM orders GROUP BY o_custkey)
SELECT o_orderkey, {R('o_totalprice - m.m', 4)} AS off_mean FROM orders o LEFT JOIN m ON m.o_custkey = o.o_custkey""")
def _(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    means = orders.groupBy("o_custkey").agg(mean(F.col("o_totalprice").cast("decimal(18,2)")).alias("m"))
    joined = attach(orders, means, "o_custkey")
    return joined.select("o_orderkey", round_to(F.col("o_totalprice") - F.col("m"), 4).alias("off_mean"))


@query("jon_3_left_join_aggregates_on_spine", "months", "subs_v", sql=f"""
WITH n AS (SELECT signup_month AS month, COUNT(*) AS c FROM subs_v GROUP BY 1),
g AS (SELECT churn_month AS month, COUNT(*) AS c FROM subs_v WHERE is_churned = 1 GROUP BY 1)
SELECT months.month, {I('COALESCE(n.c, 0)')} AS signups, {I('COALESCE(g.c, 0)')} AS churns
FROM months LEFT JOIN n ON n.month = months.month LEFT JOIN g ON g.month = months.month""")
def _(t):
    spine = t.monthly_revenue.select("month")
    events = mrr_events(t.subs_v).groupBy("month").agg(
        F.count_if(F.col("event") == "new").alias("signups"), F.count_if(F.col("event") == "churned").alias("churns"))
    joined = spine.join(events, "month", "left")
    return joined.fillna(0, ["signups", "churns"])


@query("jon_4_two_aggregates_of_one_table", "marketing", sql=f"""
WITH cut AS (SELECT strftime(strptime(MAX(month) || '-01', '%Y-%m-%d') - INTERVAL 11 MONTH, '%Y-%m') AS m FROM marketing),
r AS (SELECT platform, SUM(attributed_revenue) AS a, SUM(spend) AS s FROM marketing
      WHERE month >= (SELECT m FROM cut) GROUP BY platform),
f AS (SELECT platform, SUM(attributed_revenue) AS a, SUM(spend) AS s FROM marketing GROUP BY platform)
SELECT f.platform, {R(Q('f.a', 'f.s'))} AS full_period_roas, {R(Q('r.a', 'r.s'))} AS last_3mo_roas,
       {R(f"{Q('r.a', 'r.s')} - {Q('f.a', 'f.s')}")} AS roas_change
FROM f JOIN r ON r.platform = f.platform""")
def _(t):
    return mk.recent_vs_full(stage(t.marketing), 12)


@query("jon_5_semi_join_top_k", sql=f"""
WITH top5 AS (SELECT l_suppkey FROM lineitem GROUP BY l_suppkey ORDER BY COUNT(*) DESC, l_suppkey LIMIT 5)
SELECT l_suppkey, l_returnflag, {N} AS n FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM top5)
GROUP BY l_suppkey, l_returnflag""")
def _(t):
    # the five rows are broadcast; leaders and result read the same counted cells
    cells = t.lineitem.where("l_suppkey is not null").groupBy("l_suppkey", "l_returnflag").agg(rows().alias("n"))
    leaders = top_k(cells.groupBy("l_suppkey").agg(F.sum("n").alias("n")), "n", 5, "l_suppkey")
    # an inner join with five distinct keys: a semi-join would be pushed below the counting
    return cells.join(F.broadcast(leaders.select("l_suppkey")), "l_suppkey")


@query("jon_7_cross_join_one_row", sql=f"""
SELECT o_orderkey, {R('o_totalprice / (SELECT MAX(o_totalprice) FROM orders)', 6)} AS of_largest FROM orders""")
def _(t):
    top = t.orders.agg(F.max("o_totalprice").alias("top"))
    return t.orders.crossJoin(F.broadcast(top)).select(
        "o_orderkey", round_to(safe_div("o_totalprice", "top"), 6).alias("of_largest"))


@query("jon_8_scalar_subquery_share", sql=f"""
SELECT o_orderstatus, {N} AS n, {P('COUNT(*)', '(SELECT COUNT(*) FROM orders)')} AS pct_of_all
FROM orders GROUP BY o_orderstatus""")
def _(t):
    return share_of_total(t.orders.groupBy("o_orderstatus").agg(rows().alias("n")), "n", "pct_of_all")


@query("jon_9_aggregate_then_cross_join", "lines", "marketing", sql=f"""
WITH bm AS (SELECT {Q('SUM(net_revenue) - SUM(total_cost)', 'SUM(net_revenue)')} AS margin FROM lines)
SELECT {R(f"{D('SUM(attributed_revenue)')} * MAX(margin)")} AS profit_share FROM marketing CROSS JOIN bm""")
def _(t):
    total = t.marketing.agg(F.sum("attributed_revenue").cast("double").alias("r"))
    return total.crossJoin(F.broadcast(pf.blended_margin(t.lines))).select(
        round_to(F.col("r") * F.col("margin"), 2).alias("profit_share"))


@query("jon_10_merge_inner", sql=f"""
SELECT c.c_mktsegment, {N} AS n, {R('SUM(CAST(o.o_totalprice AS DECIMAL(18,2)))')} AS total
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment""")
def _(t):
    # orders are summed per customer before they meet the customers
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        rows().alias("k"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    return per.join(t.customer, "c_custkey").groupBy("c_mktsegment").agg(
        F.sum("k").alias("n"), round_to(F.sum("v"), 2).alias("total"))


@query("jon_11_dictionary_map", sql=f"""
SELECT CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' END AS status, {N} AS n FROM orders GROUP BY 1""")
def _(t):
    names = F.create_map(F.lit("F"), F.lit("Finished"), F.lit("O"), F.lit("Open"))
    return t.orders.groupBy(F.try_element_at(names, "o_orderstatus").alias("status")).agg(rows().alias("n"))


@query("jon_12_star_dimension", "subs", sql=f"""
SELECT company_size, CAST(CASE company_size WHEN '1-10' THEN 1 WHEN '11-50' THEN 2 WHEN '51-200' THEN 3
       WHEN '201-500' THEN 4 WHEN '500+' THEN 5 END AS INTEGER) AS sort_order, {N} AS n
FROM subs GROUP BY 1, 2""")
def _(t):
    dim = ordered_dim(t.spark, "company_size", COMPANY_SIZE_ORDER)
    joined = t.subs.join(F.broadcast(dim), "company_size", "left").dropna(subset=["sort_order"])
    return joined.groupBy("company_size", "sort_order").agg(rows().alias("n")).orderBy("sort_order")


@query("jon_14_period_shift", "inc", sql=f"""
WITH m AS (SELECT crash_year * 12 + crash_month - 1 AS month_no, {N} AS crashes FROM inc GROUP BY 1)
SELECT CAST(a.month_no AS INTEGER) AS month_no, a.crashes, b.crashes AS crashes_last_month, c.crashes AS crashes_last_year,
       {P('a.crashes - c.crashes', 'c.crashes', 4)} AS yoy_pct
FROM m a LEFT JOIN m b ON b.month_no = a.month_no - 1 LEFT JOIN m c ON c.month_no = a.month_no - 12""")
def _(t):
    index = F.col("crash_year") * 12 + F.col("crash_month") - 1
    months = ic.monthly_trend(t.incidents).select(index.alias("month_no"), "crashes")
    # both shifts read the same short series; one self-join per shift
    last = period_shift(months, "month_no", "crashes", "crashes_last_month", 1)
    both = last.join(period_shift(months, "month_no", "crashes", "crashes_last_year", 12).drop("crashes"), "month_no")
    return both.withColumn("yoy_pct", pct(F.col("crashes") - F.col("crashes_last_year"), "crashes_last_year", 4))


@query("jon_15_aligned_divide", "marketing", sql=f"""
SELECT month, platform, {P('spend', 'SUM(spend) OVER (PARTITION BY month)', 4)} AS pct_of_month,
       {P('spend', 'SUM(spend) OVER (PARTITION BY platform)', 4)} AS pct_of_platform
FROM marketing""")
def _(t):
    cells = t.marketing.select("month", "platform", "spend")
    both = cells.withColumns({c: F.sum("spend").over(Window.partitionBy(by)) for c, by in (("m", "month"), ("p", "platform"))})
    return both.select(
        "month", "platform", pct("spend", "m", 4).alias("pct_of_month"), pct("spend", "p", 4).alias("pct_of_platform"))


