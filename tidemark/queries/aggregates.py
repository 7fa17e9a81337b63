"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import as_double, pct, round_to
from tidemark.operators import aggregate as ag
from tidemark.operators.ranks import exact_quantiles, percentile_offset
from tidemark.plans import rfm as rf
from tidemark.plans import stats as st
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, D, I, MEAN, N, P, Q, R
from tidemark.runtime import attach


@query("agg_1_basic_aggregates", sql=f"""
SELECT l_returnflag, l_linestatus, {N} AS n, {R('SUM(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS total,
       {R(MEAN('CAST(l_extendedprice AS DECIMAL(18,2))'), 4)} AS mean, MIN(l_quantity) AS least, MAX(l_quantity) AS most
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        ag.rows().alias("n"), round_to(F.sum(price), 2).alias("total"), round_to(ag.mean(price), 4).alias("mean"),
        F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("agg_1_global_aggregates", sql=f"""
SELECT {N} AS n, {R('SUM(CAST(o_totalprice AS DECIMAL(18,2)))')} AS total, MIN(o_orderdate) AS first_order,
       MAX(o_orderdate) AS last_order
FROM orders""")
def _(t):
    return t.orders.agg(ag.rows().alias("n"),
                        round_to(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).alias("total"),
                        F.min("o_orderdate").alias("first_order"), F.max("o_orderdate").alias("last_order"))


@query("agg_2_count_distinct", "tx_raw", sql=f"""
SELECT {I('COUNT(DISTINCT customer_id)')} AS customers,
       {I("COUNT(DISTINCT CAST(customer_id AS VARCHAR) || CAST(invoice_date AS VARCHAR))")} AS customer_days
FROM tx_raw""")
def _(t):
    return t.transactions_raw.agg(F.countDistinct("customer_id").alias("customers"),
                                  ag.count_distinct_key("customer_id", "invoice_date").alias("customer_days"))


@query("agg_3_conditional_sum", sql=f"""
SELECT l_linestatus, {CW("l_returnflag = 'R'")} AS returned,
       {R("SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END)")} AS returned_value
FROM lineitem GROUP BY l_linestatus""")
def _(t):
    back = F.col("l_returnflag") == "R"
    return t.lineitem.groupBy("l_linestatus").agg(
        ag.count_where(back).alias("returned"),
        round_to(ag.sum_where(F.col("l_extendedprice").cast("decimal(18,2)"), back), 2).alias("returned_value"))


@query("agg_4_ratio_of_sums", "marketing",
       sql=f"SELECT month, {R(Q('SUM(attributed_revenue)', 'SUM(spend)'), 4)} AS roas FROM marketing GROUP BY month")
def _(t):
    return t.marketing.groupBy("month").agg(round_to(ag.ratio("attributed_revenue", "spend"), 4).alias("roas"))


@query("agg_5_weighted_mean", "lines_raw", sql=f"""
SELECT category, {R(Q('SUM(platform_fee * quantity)', 'SUM(quantity)'), 4)} AS fee_per_piece
FROM lines_raw GROUP BY category""")
def _(t):
    return t.order_lines_raw.groupBy("category").agg(
        round_to(ag.weighted_mean("platform_fee", "quantity"), 4).alias("fee_per_piece"))


@query("agg_6_product_of_averages", "subs", sql=f"""
SELECT region, {R(f"{MEAN('monthly_revenue')} * {MEAN('nps_score')}", 4)} AS product_of_means
FROM subs GROUP BY region""")
def _(t):
    return t.subs.groupBy("region").agg(
        round_to(ag.product_of_means("monthly_revenue", "nps_score"), 4).alias("product_of_means"))


@query("agg_7_average_of_difference", "lines_raw", sql=f"""
SELECT channel, {R(MEAN('gross_revenue - shipping_cost'), 4)} AS avg_difference FROM lines_raw GROUP BY channel""")
def _(t):
    gap = F.col("gross_revenue") - F.col("shipping_cost")
    return t.order_lines_raw.groupBy("channel").agg(round_to(ag.mean(gap), 4).alias("avg_difference"))


@query("agg_8_population_variance", "subs", sql=f"""
SELECT plan, {R('VAR_POP(CAST(feature_usage_pct AS DOUBLE))', 6)} AS variance FROM subs GROUP BY plan""")
def _(t):
    return t.subs.groupBy("plan").agg(round_to(F.var_pop(as_double("feature_usage_pct")), 6).alias("variance"))


@query("agg_9_exact_quantiles", sql=f"""
SELECT l_returnflag, {I('COUNT(l_extendedprice)')} AS n, {R('quantile_cont(l_extendedprice, 0.5)', 4)} AS median,
       {R('quantile_cont(l_extendedprice, 0.995)', 4)} AS p995
FROM lineitem GROUP BY l_returnflag""")
def _(t):
    q = exact_quantiles(t.lineitem, "l_extendedprice", ["l_returnflag"], {"median": 0.5, "p995": 0.995})
    return q.select("l_returnflag", "n", round_to("median", 4).alias("median"), round_to("p995", 4).alias("p995"))


@query("agg_10_rank_offset_percentile", sql="""
SELECT (SELECT o_totalprice FROM orders ORDER BY o_totalprice
        LIMIT 1 OFFSET (SELECT CAST(FLOOR(0.6::DOUBLE * COUNT(*)) AS BIGINT) FROM orders)) AS p60""")
def _(t):
    return percentile_offset(t.orders, "o_totalprice", 0.6, name="p60")


@query("agg_10_rank_offset_percentile_by", sql="""
WITH r AS (SELECT o_orderstatus, o_totalprice, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS i,
                  COUNT(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus, o_totalprice AS p60 FROM r WHERE i = CAST(FLOOR(0.6::DOUBLE * n) AS BIGINT)""")
def _(t):
    return percentile_offset(t.orders, "o_totalprice", 0.6, ["o_orderstatus"], name="p60")


@query("agg_11_distinct_per_group", "tx_raw", sql=f"""
SELECT customer_id, {I('COUNT(DISTINCT invoice_no)')} AS invoices FROM tx_raw WHERE customer_id IS NOT NULL
GROUP BY customer_id""")
def _(t):
    known = t.transactions_raw.dropna(subset=["customer_id"])
    return known.groupBy("customer_id").agg(F.countDistinct("invoice_no").alias("invoices"))


@query("agg_12_recency", sql=f"""
SELECT o_custkey, {I("date_diff('day', CAST(MAX(o_orderdate) AS DATE), (SELECT CAST(MAX(o_orderdate) AS DATE) + 1 FROM orders))")}
       AS recency
FROM orders GROUP BY o_custkey""")
def _(t):
    last = t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))
    # the overall latest date is the latest of the latest
    snapshot = last.agg(F.date_add(F.max("last"), 1).alias("snapshot"))
    return last.crossJoin(F.broadcast(snapshot)).select(
        "o_custkey", F.datediff("snapshot", "last").cast("bigint").alias("recency"))


@query("agg_14_calendar_resample", "lines_raw", sql=f"""
WITH m AS (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, SUM(gross_revenue) AS v
           FROM lines_raw GROUP BY 1),
s AS (SELECT CAST(UNNEST(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m)
SELECT s.month, {D('COALESCE(v, 0)')} AS revenue FROM s LEFT JOIN m ON m.month = s.month""")
def _(t):
    return ag.resample_month(t.order_lines_raw, "order_date", "gross_revenue", "revenue")


@query("agg_15_value_counts", "tx_raw",
       sql=f"SELECT country, {N} AS n FROM tx_raw WHERE country IS NOT NULL GROUP BY country")
def _(t):
    return ag.value_counts(t.transactions_raw, "country")


@query("agg_15_describe", "tx_raw", sql=f"""
SELECT {I('COUNT(unit_price)')} AS "count", {R(MEAN('unit_price'), 6)} AS mean,
       {R('STDDEV_SAMP(CAST(unit_price AS DOUBLE))', 6)} AS std, {D('MIN(unit_price)')} AS "min",
       {D('MAX(unit_price)')} AS "max", {R('quantile_cont(CAST(unit_price AS DOUBLE), 0.25)', 6)} AS p25,
       {R('quantile_cont(CAST(unit_price AS DOUBLE), 0.5)', 6)} AS p50,
       {R('quantile_cont(CAST(unit_price AS DOUBLE), 0.75)', 6)} AS p75
FROM tx_raw""")
def _(t):
    out = ag.describe(t.transactions_raw, "unit_price")
    return out.withColumns({c: round_to(c, 6) for c in ("p25", "p50", "p75")})


@query("agg_16_histogram", sql=f"""
WITH v AS (SELECT o_totalprice AS x FROM orders), b AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v),
s AS (SELECT LEAST(CAST(FLOOR((x - lo) / ((hi - lo) / 40::DOUBLE)) AS INTEGER), 39) AS bin, lo, hi FROM v CROSS JOIN b)
SELECT bin, {R('lo + bin * ((hi - lo) / 40::DOUBLE)', 6)} AS bin_start,
       {R('lo + (bin + 1) * ((hi - lo) / 40::DOUBLE)', 6)} AS bin_end, {N} AS n
FROM s GROUP BY bin, lo, hi""")
def _(t):
    return ag.histogram(t.orders, "o_totalprice", 40)


@query("agg_17_box_summary", "sales", sql=f"""
WITH ov AS (SELECT invoice_no, CAST(SUM(line_total) AS DOUBLE) AS v,
                   MIN_BY(channel, (line_no, product_id, channel)) AS channel
            FROM sales WHERE customer_id IS NOT NULL GROUP BY invoice_no),
q AS (SELECT channel, {N} AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3 FROM ov GROUP BY channel)
SELECT q.channel, n, {R('q1', 4)} AS q1, {R('median', 4)} AS median, {R('q3', 4)} AS q3,
       {R('MIN(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END)', 4)} AS whisker_low,
       {R('MAX(CASE WHEN v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1) THEN v END)', 4)} AS whisker_high,
       {CW('v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)')} AS outliers
FROM q JOIN ov ON ov.channel = q.channel GROUP BY q.channel, n, q1, median, q3""")
def _(t):
    values = st.first_in_invoice(rf.customer_sales(t.sales))
    box = ag.box_summary(values, "order_value", "channel")
    cols = ["q1", "median", "q3", "whisker_low", "whisker_high"]
    return box.withColumns({c: round_to(c, 4) for c in cols})


@query("agg_18_ragged_mean", "marketing", sql=f"""
SELECT month, {R(MEAN('CAST(spend AS DECIMAL(18,4))'), 4)} AS avg_spend FROM marketing GROUP BY month""")
def _(t):
    return ag.grouped_mean(t.marketing, "spend", ["month"], "avg_spend").withColumn(
        "avg_spend", round_to("avg_spend", 4))


@query("agg_20_distinct_values", sql="SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def _(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("agg_22_iterator_measure", "lines_raw", sql=f"""
SELECT channel, {R('SUM(gross_revenue - discount_amount)')} AS sum_of_rows,
       {R(MEAN('gross_revenue - discount_amount'), 4)} AS mean_of_rows
FROM lines_raw GROUP BY channel""")
def _(t):
    net = F.col("gross_revenue") - F.col("discount_amount")
    measures = ag.Measures(sum_of_rows=lambda: round_to(F.sum(net), 2),
                           mean_of_rows=lambda: round_to(ag.mean(net), 4))
    return measures.evaluate(t.order_lines_raw, by=["channel"])


@query("agg_23_row_reconciliation", "lines_raw", sql=f"""
SELECT channel, {CW('ABS(gross_revenue - discount_amount - platform_fee) > 50000')} AS off,
       {P(CW('ABS(gross_revenue - discount_amount - platform_fee) > 50000'), N)} AS off_pct
FROM lines_raw GROUP BY channel""")
def _(t):
    gap = F.abs(F.col("gross_revenue") - F.col("discount_amount") - F.col("platform_fee")) > 50000
    return t.order_lines_raw.groupBy("channel").agg(ag.count_where(gap).alias("off"),
                                                    pct(ag.count_where(gap), ag.rows()).alias("off_pct"))


@query("set_2_distinct", "lines_raw", sql="SELECT DISTINCT category, channel, is_returned FROM lines_raw")
def _(t):
    return t.order_lines_raw.select("category", "channel", "is_returned").distinct()


@query("udf_1_user_lambdas_as_builtins", "tx_raw", sql=f"""
WITH c AS (SELECT category, CAST(quantile_cont(CAST(unit_price AS DOUBLE), 0.995) AS DECIMAL(18,6)) AS cap
           FROM tx_raw WHERE unit_price IS NOT NULL GROUP BY category)
SELECT x.category, {CW('unit_price > cap')} AS capped_rows, {R('MAX(cap)', 6)} AS cap
FROM tx_raw x JOIN c ON c.category = x.category GROUP BY x.category""")
def _(t):
    caps = exact_quantiles(t.transactions_raw, "unit_price", ["category"], {"cap": 0.995}).select(
        "category", F.col("cap").cast("decimal(18,6)").alias("cap"))
    joined = attach(t.transactions_raw.select("category", "unit_price"), caps, "category", how="inner")
    return joined.groupBy("category").agg(ag.count_where(F.col("unit_price") > F.col("cap")).alias("capped_rows"),
                                          round_to(F.max("cap"), 6).alias("cap"))
