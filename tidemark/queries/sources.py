"""Sources, sinks and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import round_to
from tidemark.operators.aggregate import rows
from tidemark.queries.base import query
from tidemark.queries.oracle import D, I, N, R
from tidemark.runtime import scratch_path
from tidemark.sources import dims
from tidemark.sources.schemas import CRASH_COLUMNS
from tidemark.sources.tables import (
    append_load,
    cast_columns,
    conform,
    export,
    read_table,
    register_view,
    rejected_values,
    rename_map,
)
from tidemark.streaming.loads import append_available, read_stream

SPEND = "month STRING, platform STRING, spend DECIMAL(18,4), clicks BIGINT, conversions BIGINT, " \
        "attributed_revenue DECIMAL(18,4)"


@query("src_1_csv_scan", "marketing", sql=f"""
SELECT month, platform, {D('spend')} AS spend, clicks, conversions, {D('attributed_revenue')} AS attributed_revenue
FROM marketing""")
def _(t):
    path = export(t.marketing, ["month", "platform", "spend", "clicks", "conversions", "attributed_revenue"],
                  scratch_path(t.spark, "spend"))
    return read_table(t.spark, path, SPEND)


@query("src_2_declared_schema", "products", sql=f"""
SELECT CAST(product_id AS VARCHAR) AS product_id, category, product_name, {D('unit_cost')} AS unit_cost,
       {D('list_price')} AS list_price
FROM products""")
def _(t):
    return conform(t.products, "products")


@query("src_2_declared_schema_subscriptions", "subs", sql=f"""
SELECT CAST(customer_id AS VARCHAR) AS customer_id, plan, {D('monthly_revenue')} AS monthly_revenue,
       CAST(signup_date AS VARCHAR) AS signup_date, CAST(churn_date AS VARCHAR) AS churn_date, nps_score
FROM subs""")
def _(t):
    return conform(t.subs, "subscriptions").select("customer_id", "plan", "monthly_revenue", "signup_date",
                                                   "churn_date", "nps_score")


@query("src_3_cast_columns", sql="""
SELECT p_partkey, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, TRY_CAST(p_type AS INTEGER) AS type_no FROM part""")
def _(t):
    text = t.part.select("p_partkey", F.substring("p_brand", 7, 10).alias("brand_no"), F.col("p_type").alias("type_no"))
    return cast_columns(text, {"brand_no": "int", "type_no": "int"})


@query("src_3_rejected_values", sql=f"""
SELECT 'brand_no' AS column_name, {I('COUNT(*) - COUNT(TRY_CAST(substr(p_brand, 7) AS INTEGER))')} AS rejected FROM part
UNION ALL
SELECT 'type_no', {I('COUNT(*) - COUNT(TRY_CAST(p_type AS INTEGER))')} FROM part""")
def _(t):
    text = t.part.select(F.substring("p_brand", 7, 10).alias("brand_no"), F.col("p_type").alias("type_no"))
    return rejected_values(text, {"brand_no": "int", "type_no": "int"})


@query("src_4_rename_map", "inc_raw", sql="""
SELECT collision_id, crash_date_text, crash_time, borough, zip_code, on_street, cross_street, persons_injured,
       vehicle_type_1
FROM inc_raw""")
def _(t):
    return rename_map(t.incidents_raw, CRASH_COLUMNS).select(
        "collision_id", "crash_date_text", "crash_time", "borough", "zip_code", "on_street", "cross_street",
        "persons_injured", "vehicle_type_1")


@query("src_5_append_load", "marketing", sql=f"""
SELECT platform, {I('2 * COUNT(*)')} AS stored_rows, {I('(SELECT COUNT(*) FROM marketing)')} AS receipt
FROM marketing GROUP BY platform""")
def _(t):
    path = scratch_path(t.spark, "spend")
    first = append_load(t.marketing, path)
    second = append_load(t.marketing, path)
    receipt = F.lit(first if first == second else -1).cast("bigint")
    return t.spark.read.parquet(path).groupBy("platform").agg(rows().alias("stored_rows")).withColumn("receipt", receipt)


@query("src_5_append_load_incremental", "marketing", sql=f"""
SELECT month, platform, {D('spend')} AS spend, clicks, conversions, {D('attributed_revenue')} AS attributed_revenue
FROM marketing""")
def _(t):
    cols = ["month", "platform", "spend", "clicks", "conversions", "attributed_revenue"]
    folder = export(t.marketing, cols, scratch_path(t.spark, "arrivals"))
    target, memory = scratch_path(t.spark, "loaded"), scratch_path(t.spark, "loaded-files")
    for _ in range(2):  # the second run finds nothing new
        append_available(read_stream(t.spark, folder, SPEND), target, memory)
    return t.spark.read.parquet(target)


@query("src_6_registered_view", "lines", sql=f"""
SELECT category, {N} AS order_lines, {R('SUM(net_revenue)')} AS net_revenue FROM lines GROUP BY category""")
def _(t):
    register_view(t.lines, "v_order_profit")
    viewed = t.spark.table("v_order_profit")
    return viewed.groupBy("category").agg(rows().alias("order_lines"),
                                          round_to(F.sum("net_revenue"), 2).alias("net_revenue"))


@query("src_7_csv_sink", "subs", sql=f"SELECT customer_id, plan, region, {D('monthly_revenue')} AS monthly_revenue FROM subs")
def _(t):
    path = export(t.subs, ["customer_id", "plan", "region", "monthly_revenue"], scratch_path(t.spark, "customers"))
    return read_table(t.spark, path, "customer_id BIGINT, plan STRING, region STRING, monthly_revenue DECIMAL(18,2)")


@query("src_8_static_dimension", "subs", sql=f"""
SELECT company_size, CAST(CASE company_size WHEN '1-10' THEN 1 WHEN '11-50' THEN 2 WHEN '51-200' THEN 3
       WHEN '201-500' THEN 4 WHEN '500+' THEN 5 END AS INTEGER) AS sort_order,
       {R('SUM(monthly_revenue)')} AS revenue
FROM subs GROUP BY 1, 2""")
def _(t):
    dim = dims.ordered_dim(t.spark, "company_size", dims.COMPANY_SIZE_ORDER)
    per = t.subs.groupBy("company_size").agg(round_to(F.sum("monthly_revenue"), 2).alias("revenue"))
    return per.join(F.broadcast(dim), "company_size").orderBy("sort_order")


@query("src_9_calendar", sql="""
SELECT CAST(d AS DATE) AS date, strftime(d, '%Y-%m') AS month_key, CAST(year(d) AS INTEGER) AS year,
       strftime(d, '%b') AS month_name
FROM (SELECT UNNEST(generate_series(CAST(MIN(o_orderdate) AS DATE), CAST(MAX(o_orderdate) AS DATE), INTERVAL 1 DAY)) AS d
      FROM orders)""")
def _(t):
    return dims.calendar_of(t.orders, "o_orderdate")
