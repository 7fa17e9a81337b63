"""Projections, filters and scalar functions over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import (
    add_months_to_key,
    band,
    flag,
    hour_of_time,
    iso_date,
    label_null,
    month_key,
    months_between_index,
    months_open,
    ordinal,
    pct,
    per_mille,
    round_to,
    safe_div,
    strip_space,
    us_date,
    verdict,
    year_of_key,
)
from tidemark.operators.aggregate import rows
from tidemark.plans.churn import NPS_EDGES, NPS_LABELS, usage_band
from tidemark.plans.marketing import last_n_months
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, D, I, N, P, Q, R
from tidemark.runtime import stage
from tidemark.sources.dims import COMPANY_SIZE_ORDER
from tidemark.sources.roles import SNAPSHOT
from tidemark.sources.schemas import CRASH_COLUMNS


@query("prj_1_projection_alias", sql="""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderpriority AS channel FROM orders""")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                           F.col("o_orderpriority").alias("channel"))


@query("prj_2_yes_no_flag", "lines_raw", sql=f"""
SELECT channel, {I("SUM(CASE WHEN is_returned = 'Yes' THEN 1 ELSE 0 END)")} AS returned FROM lines_raw GROUP BY channel""")
def _(t):
    return t.order_lines_raw.groupBy("channel").agg(F.sum(flag("is_returned")).alias("returned"))


@query("prj_3_iso_date_parse", sql="""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS order_date FROM orders""")
def _(t):
    # orders in progress get text that is no date
    text = F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", iso_date(text).alias("order_date"))


@query("prj_4_us_date_parse", "inc_raw", sql="""
SELECT collision_id, tie_1, CAST(strptime(crash_date_text, '%m/%d/%Y') AS DATE) AS crash_date FROM inc_raw""")
def _(t):
    return t.incidents_raw.select(F.col("COLLISION_ID").alias("collision_id"), "tie_1",
                                  us_date("`CRASH DATE`").alias("crash_date"))


@query("prj_5_date_parts", "inc_raw", sql=f"""
SELECT CAST(substr(crash_date_text, 7, 4) AS INTEGER) AS y, CAST(substr(crash_date_text, 1, 2) AS INTEGER) AS m,
       CAST(regexp_extract(substr(crash_time, 1, 2), '^[0-9]+') AS INTEGER) AS h, {N} AS n
FROM inc_raw GROUP BY 1, 2, 3""")
def _(t):
    parsed = t.incidents_raw.select(us_date("`CRASH DATE`").alias("d"), hour_of_time("`CRASH TIME`").alias("h"))
    return parsed.groupBy(F.year("d").alias("y"), F.month("d").alias("m"), "h").agg(rows().alias("n"))


@query("prj_6_month_key", sql=f"""
SELECT strftime(o_orderdate, '%Y-%m') AS month, {N} AS n FROM orders GROUP BY 1""")
def _(t):
    return t.orders.groupBy(month_key("o_orderdate").alias("month")).agg(rows().alias("n"))


@query("prj_7_year_of_key", "marketing", sql=f"""
SELECT substr(month, 1, 4) AS year, {I('SUM(conversions)')} AS conversions FROM marketing GROUP BY 1""")
def _(t):
    return t.marketing.groupBy(year_of_key("month").alias("year")).agg(F.sum("conversions").alias("conversions"))


@query("prj_8_duration_months", "subs_v", sql="SELECT customer_id, lifespan_months FROM subs_v")
def _(t):
    return t.subs.select("customer_id", months_open("signup_date", "churn_date", SNAPSHOT).alias("lifespan_months"))


@query("prj_9_month_arithmetic", "marketing", sql="""
SELECT month, platform, strftime(strptime(month || '-01', '%Y-%m-%d') - INTERVAL 2 MONTH, '%Y-%m') AS two_months_before
FROM marketing""")
def _(t):
    return t.marketing.select("month", "platform", add_months_to_key("month", -2).alias("two_months_before"))


@query("prj_10_month_trunc_and_difference", "subs", sql=f"""
SELECT customer_id, CAST(date_trunc('month', signup_date) AS DATE) AS signup_month_start,
       {I('(year(churn_date) - year(signup_date)) * 12 + month(churn_date) - month(signup_date)')} AS months_apart
FROM subs""")
def _(t):
    return t.subs.select("customer_id", F.trunc("signup_date", "MM").alias("signup_month_start"),
                         months_between_index("churn_date", "signup_date").cast("bigint").alias("months_apart"))


@query("prj_11_row_arithmetic", "lines_raw", "products", sql=f"""
SELECT l.order_id, l.line_no, l.product_id, {D('p.unit_cost * l.quantity')} AS product_cost,
       {D('p.unit_cost * l.quantity + l.shipping_cost + l.platform_fee + l.return_processing_cost')} AS total_cost
FROM lines_raw l JOIN products p ON p.product_id = l.product_id""")
def _(t):
    joined = t.order_lines_raw.join(t.products.select("product_id", "unit_cost"), "product_id")
    cost = F.col("unit_cost") * F.col("quantity")
    return joined.select("order_id", "line_no", "product_id", cost.alias("product_cost"),
                         (cost + F.col("shipping_cost") + F.col("platform_fee") + F.col("return_processing_cost"))
                         .alias("total_cost"))


@query("prj_12_banding", "subs", sql=f"""
SELECT CASE WHEN feature_usage_pct < 20 THEN '0-19%' WHEN feature_usage_pct < 40 THEN '20-39%'
            WHEN feature_usage_pct < 60 THEN '40-59%' WHEN feature_usage_pct < 80 THEN '60-79%'
            ELSE '80-100%' END AS usage_band,
       CASE WHEN churn_nps IS NULL THEN 'unknown' WHEN churn_nps <= 6 THEN 'Detractor (0-6)'
            WHEN churn_nps <= 8 THEN 'Passive (7-8)' ELSE 'Promoter (9-10)' END AS churn_nps_band, {N} AS n
FROM (SELECT feature_usage_pct, CASE WHEN churned = 'Yes' THEN nps_score END AS churn_nps FROM subs) GROUP BY 1, 2""")
def _(t):
    nps = F.when(F.col("churned") == "Yes", F.col("nps_score"))
    banded = t.subs.select(usage_band().alias("usage_band"),
                           band(nps, NPS_EDGES, NPS_LABELS, inclusive=True, null_label="unknown")
                           .alias("churn_nps_band"))
    return banded.groupBy("usage_band", "churn_nps_band").agg(rows().alias("n"))


@query("prj_13_ordinal_sort_key", "subs", sql=f"""
SELECT company_size, CAST(CASE company_size WHEN '1-10' THEN 1 WHEN '11-50' THEN 2 WHEN '51-200' THEN 3
       WHEN '201-500' THEN 4 WHEN '500+' THEN 5 END AS BIGINT) AS sort_key, {N} AS n
FROM subs GROUP BY 1, 2""")
def _(t):
    grouped = t.subs.groupBy("company_size").agg(rows().alias("n"))
    return grouped.withColumn("sort_key", ordinal("company_size", COMPANY_SIZE_ORDER)).orderBy("sort_key")


@query("prj_14_safe_division", sql=f"""
SELECT l_orderkey, l_linenumber, l_partkey, {R(Q('l_extendedprice', 'l_discount'), 4)} AS price_per_discount FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             round_to(safe_div("l_extendedprice", "l_discount"), 4).alias("price_per_discount"))


@query("prj_15_percent_and_per_mille", "inc_raw", sql=f"""
SELECT borough, {P(CW('persons_injured > 0'), N)} AS pct_injured,
       {R(f"CAST(1000 AS DOUBLE) * CAST({CW('persons_killed > 0')} AS DOUBLE) / COUNT(*)")} AS killed_per_mille
FROM inc_raw GROUP BY borough""")
def _(t):
    named = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    hurt, dead = F.count_if(F.col("persons_injured") > 0), F.count_if(F.col("persons_killed") > 0)
    return named.groupBy("borough").agg(pct(hurt, rows()).alias("pct_injured"),
                                        per_mille(dead, rows()).alias("killed_per_mille"))


@query("prj_16_round_abs_sqrt", sql=f"""
SELECT c_custkey, {R('c_acctbal', 1)} AS rounded, ABS(c_acctbal) AS magnitude, {R('sqrt(ABS(c_acctbal))', 6)} AS root
FROM customer""")
def _(t):
    return t.customer.select("c_custkey", round_to("c_acctbal", 1).alias("rounded"),
                             F.abs("c_acctbal").alias("magnitude"), round_to(F.sqrt(F.abs("c_acctbal")), 6).alias("root"))


@query("prj_17_text_helpers", "tx_raw", sql="""
SELECT invoice_no, line_no, product_id, lower(trim(country, ' ' || chr(9))) AS spelled, substr(category, 1, 3) AS short_category,
       category || '/' || channel AS path, CAST(customer_id AS VARCHAR) || '-' || channel AS tag,
       COALESCE(CAST(customer_id AS VARCHAR), 'guest') AS customer
FROM tx_raw""")
def _(t):
    text_id = F.col("customer_id").cast("string")
    return t.transactions_raw.select(
        "invoice_no", "line_no", "product_id", F.lower(strip_space("country")).alias("spelled"),
        F.substring("category", 1, 3).alias("short_category"),
        F.concat("category", F.lit("/"), "channel").alias("path"),
        F.concat(text_id, F.lit("-"), "channel").alias("tag"), F.coalesce(text_id, F.lit("guest")).alias("customer"))


@query("prj_19_null_label", "inc_raw", sql=f"""
SELECT COALESCE(borough, 'UNKNOWN/UNASSIGNED') AS borough, n FROM (
  SELECT borough, {N} AS n FROM inc_raw GROUP BY borough)""")
def _(t):
    grouped = t.incidents_raw.groupBy(F.col("BOROUGH").alias("borough")).agg(rows().alias("n"))
    return grouped.withColumn("borough", label_null("borough", "UNKNOWN/UNASSIGNED"))


@query("prj_20_verdict_labels", "marketing", sql=f"""
SELECT month, platform, CASE WHEN {Q('attributed_revenue', 'spend')} > 4 THEN 'Profitable'
       ELSE 'Losing money after ad spend' END AS verdict
FROM marketing""")
def _(t):
    test = safe_div("attributed_revenue", "spend") > 4
    return t.marketing.select("month", "platform",
                              verdict(test, "Profitable", "Losing money after ad spend").alias("verdict"))


@query("prj_21_scenario_label", "marketing", sql=f"""
SELECT 'Keep all platforms' AS recommendation, {R('SUM(spend)')} AS spend FROM marketing""")
def _(t):
    return t.marketing.agg(round_to(F.sum("spend"), 2).alias("spend")).select(
        F.lit("Keep all platforms").alias("recommendation"), "spend")


@query("flt_1_comparison_filters", "inc_raw", sql="""
SELECT collision_id, tie_1, persons_injured FROM inc_raw
WHERE (borough <> 'ASIA' AND persons_injured >= 1 AND persons_killed = 0) OR persons_injured > 2""")
def _(t):
    df = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    keep = ((F.col("borough") != "ASIA") & (F.col("persons_injured") >= 1) & (F.col("persons_killed") == 0)) | (
        F.col("persons_injured") > 2)
    return df.where(keep).select("collision_id", "tie_1", "persons_injured")


@query("flt_2_in_list", sql=f"""
SELECT l_linestatus, {N} AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY l_linestatus""")
def _(t):
    return t.lineitem.where(F.col("l_returnflag").isin("A", "R")).groupBy("l_linestatus").agg(rows().alias("n"))


@query("flt_3_null_filters", "inc_raw", sql=f"""
SELECT {N} AS n FROM inc_raw WHERE borough IS NULL AND on_street IS NOT NULL""")
def _(t):
    df = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    return df.where(F.col("borough").isNull() & F.col("on_street").isNotNull()).agg(rows().alias("n"))


@query("flt_4_column_to_column", "lines_raw", sql=f"""
SELECT channel, {N} AS n FROM lines_raw WHERE platform_fee > discount_amount GROUP BY channel""")
def _(t):
    return t.order_lines_raw.where(F.col("platform_fee") > F.col("discount_amount")).groupBy("channel").agg(
        rows().alias("n"))


@query("flt_5_group_filter_min_n", sql=f"""
SELECT l_suppkey, {N} AS n FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) >= 600""")
def _(t):
    return t.lineitem.groupBy("l_suppkey").agg(rows().alias("n")).where(F.col("n") >= 600)


@query("flt_6_trailing_period", "marketing", sql=f"""
SELECT month, platform, {D('spend')} AS spend FROM marketing
WHERE month >= (SELECT strftime(strptime(MAX(month) || '-01', '%Y-%m-%d') - INTERVAL 2 MONTH, '%Y-%m') FROM marketing)""")
def _(t):
    return last_n_months(stage(t.marketing), 3).select("month", "platform", "spend")


