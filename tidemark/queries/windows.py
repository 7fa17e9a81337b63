"""Windows, sorting and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import window as wn
from tidemark.operators.aggregate import rows, share_within
from tidemark.operators.clean import dedup_key
from tidemark.operators.ranks import exact_quantiles
from tidemark.queries.base import query
from tidemark.queries.oracle import D, N, P, R
from tidemark.runtime import attach


def _daily(t):
    return t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(rows().alias("n"))


DAILY = "d AS (SELECT CAST(ts AS DATE) AS day, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1)"


@query("win_1_lag_change", sql=f"""
WITH {DAILY}, l AS (SELECT day, n, LAG(n) OVER (ORDER BY day) AS p FROM d)
SELECT day, n, p AS previous, {R('n - p')} AS change, {P('n - p', 'p')} AS pct_change FROM l""")
def _(t):
    return wn.with_change(_daily(t), "day", "n").orderBy("day")


@query("win_1_lag_change_by_series", "marketing", sql=f"""
WITH l AS (SELECT month, platform, spend, LAG(spend) OVER (PARTITION BY platform ORDER BY month) AS p FROM marketing)
SELECT month, platform, {D('spend')} AS spend, {D('p')} AS previous, {R('spend - p')} AS change,
       {P('spend - p', 'p')} AS pct_change
FROM l""")
def _(t):
    return wn.with_change(t.marketing.select("month", "platform", "spend"), "month", "spend", by=["platform"])


@query("win_2_trailing_mean", sql=f"""
WITH {DAILY} SELECT day, n, {R('AVG(n) OVER (ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)')} AS trailing FROM d""")
def _(t):
    return wn.trailing_mean(_daily(t), "day", "n", 3, "trailing").orderBy("day")


@query("win_3_trailing_calendar_mean", "monthly", sql=f"""
WITH x AS (SELECT month, monthly_churn_rate_pct AS r, CAST(substr(month, 1, 4) AS INTEGER) * 12
             + CAST(substr(month, 6, 2) AS INTEGER) AS k, day(last_day(CAST(month || '-01' AS DATE))) AS days FROM monthly)
SELECT a.month, a.r AS monthly_churn_rate_pct,
       {R('SUM(b.r * b.days) / SUM(CASE WHEN b.r IS NOT NULL THEN b.days END)')} AS churn_rate_3mo
FROM x a JOIN x b ON b.k BETWEEN a.k - 2 AND a.k GROUP BY a.month, a.r""")
def _(t):
    series = t.monthly_revenue.select("month", "monthly_churn_rate_pct")
    return wn.trailing_month_mean(series, "month", "monthly_churn_rate_pct", 3, "churn_rate_3mo")


@query("win_4_row_number", sql="""
SELECT o_custkey, o_orderkey, o_orderdate FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(t):
    latest = dedup_key(t.orders, "o_custkey", [F.col("o_orderdate").desc(), "o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", "o_orderdate")


@query("win_5_rank_top_with_ties", sql=f"""
SELECT user_id, event_type, n FROM (
  SELECT user_id, event_type, {N} AS n, RANK() OVER (PARTITION BY user_id ORDER BY COUNT(*) DESC) AS r
  FROM events GROUP BY user_id, event_type) WHERE r = 1""")
def _(t):
    return wn.top_per_group(t.events.groupBy("user_id", "event_type").agg(rows().alias("n")), ["user_id"], "n")


@query("win_6_share_within", sql=f"""
SELECT user_id, event_type, {N} AS n, {P('COUNT(*)', 'SUM(COUNT(*)) OVER (PARTITION BY user_id)')} AS pct
FROM events GROUP BY user_id, event_type""")
def _(t):
    grouped = t.events.groupBy("user_id", "event_type").agg(rows().alias("n"))
    return share_within(grouped, "n", ["user_id"], "pct")


@query("win_7_group_transform", sql="""
SELECT event_id, CAST(CAST(quantile_cont(value, 0.5) OVER (PARTITION BY event_type) AS DECIMAL(18,6)) AS DOUBLE)
       AS group_median
FROM events""")
def _(t):
    stats = exact_quantiles(t.events, "value", ["event_type"], {"group_median": 0.5}).select(
        "event_type", F.col("group_median").cast("decimal(18,6)").alias("group_median"))
    return attach(t.events.select("event_id", "event_type"), stats, "event_type").select(
        "event_id", "group_median")


@query("srt_1_order_by", sql="SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey, n_name DESC")
def _(t):
    return t.nation.select("n_name", "n_regionkey").orderBy("n_regionkey", F.col("n_name").desc())


@query("srt_2_top_k", sql=f"""
SELECT l_partkey, {N} AS n FROM lineitem GROUP BY l_partkey ORDER BY COUNT(*) DESC, l_partkey LIMIT 10""")
def _(t):
    return wn.top_k(t.lineitem.groupBy("l_partkey").agg(rows().alias("n")), "n", 10, "l_partkey")


@query("srt_3_sort_by_expression", sql="""
SELECT c_custkey, c_acctbal FROM customer ORDER BY ABS(c_acctbal) DESC, c_custkey LIMIT 15""")
def _(t):
    return wn.top_k(t.customer.select("c_custkey", "c_acctbal"), F.abs("c_acctbal"), 15, "c_custkey")


@query("srt_4_sort_matrix", "inc_raw", sql=f"""
SELECT borough, contributing_factor_1 AS factor, {N} AS crashes FROM inc_raw
GROUP BY borough, contributing_factor_1 ORDER BY borough NULLS FIRST, crashes DESC""")
def _(t):
    grouped = t.incidents_raw.groupBy(F.col("BOROUGH").alias("borough"),
                                      F.col("CONTRIBUTING FACTOR VEHICLE 1").alias("factor"))
    return grouped.agg(rows().alias("crashes")).orderBy("borough", F.col("crashes").desc(), "factor")

