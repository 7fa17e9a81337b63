"""Cleaning operators, each on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import null_if_sentinel
from tidemark.operators import clean as cl
from tidemark.operators.aggregate import rows
from tidemark.operators.quality import orphans
from tidemark.plans.rfm import with_line_total
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, D, I, MEAN, N
from tidemark.sources.schemas import CRASH_COLUMNS


@query("cln_1_dedup_rows", "tx_raw", sql=f"""
SELECT DISTINCT invoice_no, line_no, product_id, invoice_date, customer_id, category, channel, country, quantity,
       {D('unit_price')} AS unit_price
FROM tx_raw""")
def _(t):
    return cl.dedup_rows(t.transactions_raw)


@query("cln_2_dedup_key", "inc", sql="SELECT collision_id, tie_1, tie_2, tie_3, tie_4 FROM inc")
def _(t):
    raw = t.incidents_raw.select("COLLISION_ID", "tie_1", "tie_2", "tie_3", "tie_4")
    return cl.dedup_key(raw, "COLLISION_ID", ["tie_1", "tie_2", "tie_3", "tie_4"]).withColumnRenamed(
        "COLLISION_ID", "collision_id")


@query("cln_3_first_per_key", "tx_raw", sql="""
SELECT customer_id, ARG_MIN(channel, (invoice_date, invoice_no, line_no, product_id)) AS channel,
       ARG_MIN(category, (invoice_date, invoice_no, line_no, product_id)) AS category
FROM tx_raw WHERE customer_id IS NOT NULL GROUP BY customer_id""")
def _(t):
    known = cl.require(t.transactions_raw, ["customer_id"])
    return cl.first_per_key(known, "customer_id", ["channel", "category"],
                            ["invoice_date", "invoice_no", "line_no", "product_id"])


@query("cln_4_canonicalize_map", "inc_raw", sql=f"""
SELECT CASE WHEN lower(vehicle_type_1) IN ('economy', 'large', 'promo') THEN upper(vehicle_type_1)
            ELSE vehicle_type_1 END AS vehicle_type, {N} AS n
FROM inc_raw GROUP BY 1""")
def _(t):
    spellings = {k: v for k, v in t.vehicle_spellings.items() if k in ("economy", "large", "promo")}
    named = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    return cl.canonicalize(named, "vehicle_type_1", spellings, into="vehicle_type").groupBy("vehicle_type").agg(
        rows().alias("n"))


@query("cln_4_canonicalize_table", "tx_raw", sql=f"""
SELECT COALESCE(n.n_name, x.country) AS country, {N} AS n
FROM tx_raw x LEFT JOIN nation n ON lower(n.n_name) = lower(trim(x.country, ' ' || chr(9))) GROUP BY 1""")
def _(t):
    return cl.canonicalize(t.transactions_raw, "country", t.country_names, strip=True).groupBy("country").agg(
        rows().alias("n"))


@query("cln_5_trim_text", "tx_raw", sql=f"""
SELECT trim(replace(country, chr(9), '')) AS country, {N} AS n FROM tx_raw GROUP BY 1""")
def _(t):
    return cl.trim_text(t.transactions_raw, ["country", "channel", "category"]).groupBy("country").agg(
        rows().alias("n"))


@query("cln_6_negative_clamp", "lines_raw", sql=f"""
SELECT order_id, line_no, product_id, {D('CASE WHEN discount_amount < 0 THEN 0 ELSE discount_amount END')} AS discount_amount
FROM lines_raw""")
def _(t):
    return cl.clamp_column(t.order_lines_raw, "discount_amount", lo=0).select(
        "order_id", "line_no", "product_id", "discount_amount")


@query("cln_7_sentinel_to_null", "inc_raw", sql="""
SELECT collision_id, tie_1, tie_2, CASE WHEN latitude = 0 AND longitude = 0 THEN NULL ELSE latitude END AS latitude,
       CASE WHEN latitude = 0 AND longitude = 0 THEN NULL ELSE longitude END AS longitude
FROM inc_raw""")
def _(t):
    named = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    island = {"latitude": 0.0, "longitude": 0.0}
    return named.withColumns({c: null_if_sentinel(c, island) for c in island}).select(
        "collision_id", "tie_1", "tie_2", "latitude", "longitude")


@query("cln_8_group_mean_imputation", "lines_raw", sql=f"""
WITH f AS (SELECT category, CAST({MEAN('shipping_cost')} AS DECIMAL(18,6)) AS fill FROM lines_raw GROUP BY category)
SELECT order_id, line_no, product_id, r.category, {D('COALESCE(CAST(shipping_cost AS DECIMAL(18,6)), fill)')} AS shipping_cost
FROM lines_raw r LEFT JOIN f ON f.category = r.category""")
def _(t):
    return cl.impute_group(t.order_lines_raw, "shipping_cost", "category").select(
        "order_id", "line_no", "product_id", "category", "shipping_cost")


@query("cln_9_group_median_imputation", "tx_raw", sql=f"""
WITH f AS (SELECT category, CAST(quantile_cont(CAST(unit_price AS DOUBLE), 0.5) AS DECIMAL(18,6)) AS fill
           FROM tx_raw WHERE unit_price IS NOT NULL GROUP BY category)
SELECT invoice_no, line_no, product_id, x.category, {D('COALESCE(CAST(unit_price AS DECIMAL(18,6)), fill)')} AS unit_price
FROM tx_raw x LEFT JOIN f ON f.category = x.category""")
def _(t):
    return cl.impute_group(t.transactions_raw, "unit_price", "category", "median").select(
        "invoice_no", "line_no", "product_id", "category", "unit_price")


@query("cln_10_quantile_cap", "tx_raw", sql=f"""
WITH c AS (SELECT category, CAST(quantile_cont(CAST(unit_price AS DOUBLE), 0.995) AS DECIMAL(18,6)) AS cap
           FROM tx_raw WHERE unit_price IS NOT NULL GROUP BY category)
SELECT invoice_no, line_no, product_id, x.category,
       {D('CASE WHEN unit_price > cap THEN cap ELSE CAST(unit_price AS DECIMAL(18,6)) END')} AS unit_price
FROM tx_raw x LEFT JOIN c ON c.category = x.category""")
def _(t):
    return cl.cap_quantile(t.transactions_raw, "unit_price", "category", 0.995).select(
        "invoice_no", "line_no", "product_id", "category", "unit_price")


@query("cln_11_orphan_exclusion", "lines_raw", "products", sql=f"""
SELECT l.category, {N} AS kept_lines, {D('SUM(p.unit_cost)')} AS unit_costs
FROM lines_raw l JOIN products p ON p.product_id = l.product_id GROUP BY l.category""")
def _(t):
    kept = cl.drop_orphans(t.order_lines_raw, t.products.select("product_id", "unit_cost"), "product_id")
    return kept.groupBy("category").agg(rows().alias("kept_lines"), F.sum("unit_cost").alias("unit_costs"))


@query("cln_12_sign_split", "tx_raw", sql=f"""
SELECT CASE WHEN quantity > 0 THEN 'sale' ELSE 'return' END AS kind, {N} AS n,
       {D('SUM(quantity * unit_price)')} AS line_total
FROM tx_raw WHERE quantity <> 0 GROUP BY 1""")
def _(t):
    # both kinds in one scan
    valued = with_line_total(t.transactions_raw).where(F.col("quantity") != 0)
    kind = F.when(F.col("quantity") > 0, "sale").otherwise("return")
    return valued.groupBy(kind.alias("kind")).agg(rows().alias("n"), F.sum("line_total").alias("line_total"))


@query("cln_12_returns_only", "tx_raw", sql=f"""
SELECT invoice_no, line_no, product_id, quantity, {D('quantity * unit_price')} AS line_total
FROM tx_raw WHERE quantity < 0""")
def _(t):
    returns = cl.split_sales_returns(t.transactions_raw, "quantity", "unit_price")[1]
    return returns.select("invoice_no", "line_no", "product_id", "quantity", "line_total")


@query("cln_13_require_key", "tx_raw", sql=f"""
SELECT channel, {N} AS n, {I('COUNT(DISTINCT customer_id)')} AS customers
FROM tx_raw WHERE customer_id IS NOT NULL GROUP BY channel""")
def _(t):
    known = cl.require(t.transactions_raw, ["customer_id"])
    return known.groupBy("channel").agg(rows().alias("n"), F.countDistinct("customer_id").alias("customers"))


@query("cln_14_leave_as_null", "inc", sql=f"""
SELECT {CW('borough IS NULL')} AS null_borough, {CW('on_street IS NULL')} AS null_on_street,
       {CW('cross_street IS NULL')} AS null_cross_street, {CW('latitude IS NULL')} AS null_latitude
FROM inc""")
def _(t):
    cols = ["borough", "on_street", "cross_street", "latitude"]
    return t.incidents.agg(*[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


@query("jon_6_anti_join", "lines_raw", "products", sql="""
SELECT order_id, line_no, product_id FROM lines_raw o
WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = o.product_id)""")
def _(t):
    return orphans(t.order_lines_raw, t.products, "product_id").select("order_id", "line_no", "product_id")


