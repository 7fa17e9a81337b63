"""Data-quality audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import quality as q
from tidemark.operators.aggregate import rows
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, D, I, N, P, R
from tidemark.sources.schemas import CRASH_COLUMNS


def _key_counts(table: str, key: str) -> str:
    return f"""
SELECT {N} AS total_rows, {I(f'COUNT(DISTINCT {key})')} AS distinct_keys,
       {I(f'COUNT(*) - COUNT(DISTINCT {key})')} AS duplicate_rows
FROM {table}"""


@query("dq_1_row_and_key_counts", "inc_raw", sql=_key_counts("inc_raw", "collision_id"))
def _(t):
    return q.row_and_key_counts(t.incidents_raw, "COLLISION_ID")


@query("dq_1_row_and_key_counts_orders", "lines_raw", sql=_key_counts("lines_raw", "order_id"))
def _(t):
    return q.row_and_key_counts(t.order_lines_raw, "order_id")


@query("dq_1_row_and_key_counts_customers", "subs", sql=_key_counts("subs", "customer_id"))
def _(t):
    return q.row_and_key_counts(t.subs, "customer_id")


@query("dq_2_likely_duplicates", "lines_raw", sql=f"""
SELECT {I('''COUNT(*) - COUNT(DISTINCT CAST(order_id AS VARCHAR) || CAST(product_id AS VARCHAR) ||
       CAST(order_date AS VARCHAR) || channel || CAST(quantity AS VARCHAR) || CAST(shipping_cost AS VARCHAR))''')}
       AS likely_duplicates
FROM lines_raw""")
def _(t):
    return q.likely_duplicates(t.order_lines_raw, ["order_id", "product_id", "order_date", "channel", "quantity",
                                                   "shipping_cost"])


def _nulls(table: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, {I(f'COUNT(*) - COUNT({c})')} AS null_count FROM {table}" for c in cols)


SUBS = ["plan", "billing_cycle", "company_size", "region", "monthly_revenue", "signup_date", "churn_date",
        "churn_reason", "nps_score", "feature_usage_pct"]
LINES = ["product_id", "quantity", "gross_revenue", "discount_amount", "shipping_cost", "platform_fee",
         "return_reason"]
TX = ["invoice_no", "line_no", "product_id", "invoice_date", "customer_id", "category", "channel", "country",
      "quantity", "unit_price"]


@query("dq_3_null_profile", "tx_raw", sql=_nulls("tx_raw", TX))
def _(t):
    return q.null_profile(t.transactions_raw)


@query("dq_3_null_profile_subscriptions", "subs", sql=_nulls("subs", SUBS))
def _(t):
    return q.null_profile(t.subs, SUBS)


@query("dq_3_null_profile_order_lines", "lines_raw", sql=_nulls("lines_raw", LINES))
def _(t):
    return q.null_profile(t.order_lines_raw, LINES)


@query("dq_4_conditional_consistency", "subs", sql=f"""
SELECT {CW("churned = 'Yes' AND churn_date IS NULL")} AS churned_missing_date,
       {CW("churned = 'Yes' AND churn_reason IS NULL")} AS churned_missing_reason,
       {CW("churned = 'No' AND churn_date IS NOT NULL")} AS active_with_churn_date
FROM subs""")
def _(t):
    gone = F.col("churned") == "Yes"
    return q.rule_violations(t.subs, {
        "churned_missing_date": gone & F.col("churn_date").isNull(),
        "churned_missing_reason": gone & F.col("churn_reason").isNull(),
        "active_with_churn_date": (F.col("churned") == "No") & F.col("churn_date").isNotNull(),
    })


def _domains(table: str, cols: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT DISTINCT '{c}' AS column_name, {c} AS value FROM {table} WHERE {c} IS NOT NULL" for c in cols)


@query("dq_5_domain_values", "subs",
       sql=_domains("subs", ["plan", "billing_cycle", "company_size", "region", "churn_reason"]))
def _(t):
    return q.domain_values(t.subs, ["plan", "billing_cycle", "company_size", "region", "churn_reason"])


@query("dq_5_domain_values_order_lines", "lines_raw", sql=_domains("lines_raw", ["category", "channel", "is_returned"]))
def _(t):
    return q.domain_values(t.order_lines_raw, ["category", "channel", "is_returned"])


@query("dq_6_range_profile", "subs", sql=f"""
SELECT {D('MIN(monthly_revenue)')} AS min_monthly_revenue, {D('MAX(monthly_revenue)')} AS max_monthly_revenue,
       MIN(nps_score) AS min_nps_score, MAX(nps_score) AS max_nps_score,
       MIN(feature_usage_pct) AS min_feature_usage_pct, MAX(feature_usage_pct) AS max_feature_usage_pct,
       MIN(signup_date) AS min_signup_date, MAX(signup_date) AS max_signup_date
FROM subs""")
def _(t):
    return q.range_profile(t.subs, ["monthly_revenue", "nps_score", "feature_usage_pct", "signup_date"])


@query("dq_6_range_profile_incidents", "inc_raw", sql="""
SELECT MIN(persons_injured) AS min_persons_injured, MAX(persons_injured) AS max_persons_injured,
       MIN(persons_killed) AS min_persons_killed, MAX(persons_killed) AS max_persons_killed,
       MIN(CAST(strptime(crash_date_text, '%m/%d/%Y') AS DATE)) AS min_crash_date,
       MAX(CAST(strptime(crash_date_text, '%m/%d/%Y') AS DATE)) AS max_crash_date
FROM inc_raw""")
def _(t):
    from tidemark.functions import us_date

    named = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS).withColumn("crash_date", us_date("crash_date_text"))
    return q.range_profile(named, ["persons_injured", "persons_killed", "crash_date"])


@query("dq_7_cross_table_reconcile", "subs", "monthly", sql=f"""
SELECT (SELECT {N} FROM subs) AS subs_total_customers, (SELECT {I('SUM(new_customers)')} FROM monthly) AS monthly_total_new,
       (SELECT {CW("churned = 'Yes'")} FROM subs) AS subs_total_churned,
       (SELECT {I('SUM(churned_customers)')} FROM monthly) AS monthly_total_churned""")
def _(t):
    left = t.subs.agg(rows().alias("subs_total_customers"),
                      F.count_if(F.col("churned") == "Yes").alias("subs_total_churned"))
    right = t.monthly_revenue.agg(F.sum("new_customers").alias("monthly_total_new"),
                                  F.sum("churned_customers").alias("monthly_total_churned"))
    return q.cross_table_reconcile(left, right)


@query("dq_8_orphan_report", "lines_raw", "products", sql=f"""
SELECT {N} AS orphan_lines, {R('SUM(gross_revenue)')} AS orphan_value,
       {P('COUNT(*)', '(SELECT COUNT(*) FROM lines_raw)')} AS pct_of_all_lines
FROM lines_raw o WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = o.product_id)""")
def _(t):
    return q.orphan_report(t.order_lines_raw, t.products, "product_id", "gross_revenue")


@query("dq_9_negative_value_report", "lines_raw", sql=f"""
SELECT {N} AS negative_rows, {R('SUM(discount_amount)')} AS total_negative_value
FROM lines_raw WHERE discount_amount < 0""")
def _(t):
    return q.negative_value_report(t.order_lines_raw, "discount_amount")


@query("dq_10_component_reconcile_costs", "lines", sql=f"""
SELECT {N} AS rows_checked, {CW('total_cost IS NULL')} AS total_cost_null,
       {CW('ABS(total_cost - (product_cost + shipping_cost + platform_fee + return_processing_cost)) > 0.01')}
         AS total_cost_mismatch
FROM lines""")
def _(t):
    parts = ["product_cost", "shipping_cost", "platform_fee", "return_processing_cost"]
    return q.component_reconcile(t.lines, {"total_cost": ("total_cost", parts)}, 0.01)


@query("dq_10_component_reconcile", "inc_raw", sql=f"""
SELECT {N} AS rows_checked, {CW('persons_injured IS NULL')} AS injured_null,
       {CW('persons_injured <> pedestrians_injured + cyclists_injured + motorists_injured')} AS injured_mismatch,
       {CW('persons_killed IS NULL')} AS killed_null,
       {CW('persons_killed <> pedestrians_killed + cyclists_killed + motorists_killed')} AS killed_mismatch
FROM inc_raw""")
def _(t):
    named = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    parts = ["pedestrians", "cyclists", "motorists"]
    return q.component_reconcile(named, {
        "injured": ("persons_injured", [f"{p}_injured" for p in parts]),
        "killed": ("persons_killed", [f"{p}_killed" for p in parts]),
    })


@query("dq_11_spine_completeness", "marketing", sql=f"""
SELECT {N} AS total_rows, {I('COUNT(DISTINCT month || platform)')} AS distinct_keys,
       {I('COUNT(DISTINCT month) * COUNT(DISTINCT platform)')} AS expected_keys
FROM marketing""")
def _(t):
    return q.spine_completeness(t.marketing, ["month", "platform"])


@query("dq_11_spine_gaps", "marketing", sql="""
SELECT m.month, p.platform FROM (SELECT DISTINCT month FROM marketing) m
CROSS JOIN (SELECT DISTINCT platform FROM marketing) p
WHERE NOT EXISTS (SELECT 1 FROM marketing x WHERE x.month = m.month AND x.platform = p.platform)""")
def _(t):
    return q.spine_gaps(t.marketing, "month", "platform")


@query("dq_12_missing_rate_report", "inc_raw", sql=f"""
SELECT {N} AS total_rows, {CW('borough IS NULL')} AS missing_borough, {P(CW('borough IS NULL'), N, 1)} AS pct_missing_borough,
       {CW('on_street IS NULL')} AS missing_on_street, {P(CW('on_street IS NULL'), N, 1)} AS pct_missing_on_street,
       {CW('latitude IS NULL OR longitude IS NULL')} AS missing_coords,
       {P(CW('latitude IS NULL OR longitude IS NULL'), N, 1)} AS pct_missing_coords
FROM inc_raw""")
def _(t):
    named = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    return q.missing_rate_report(named, {"borough": ["borough"], "on_street": ["on_street"],
                                         "coords": ["latitude", "longitude"]})


@query("dq_13_sentinel_count", "inc_raw",
       sql=f"SELECT {N} AS null_island_rows FROM inc_raw WHERE latitude = 0 AND longitude = 0")
def _(t):
    return q.sentinel_count(t.incidents_raw, {"LATITUDE": 0.0, "LONGITUDE": 0.0}, "null_island_rows")


@query("dq_14_variant_frequency", "inc_raw", sql=f"""
SELECT vehicle_type_1, {N} AS n FROM inc_raw WHERE lower(vehicle_type_1) IN ('promo', 'standard', 'economy')
GROUP BY vehicle_type_1""")
def _(t):
    named = t.incidents_raw.withColumnsRenamed(CRASH_COLUMNS)
    return q.variant_frequency(named, "vehicle_type_1", ["promo", "standard", "economy"])


@query("dq_15_exact_duplicate_count", "tx_raw", sql=f"""
SELECT {I('(SELECT COUNT(*) FROM tx_raw) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM tx_raw))')} AS duplicate_rows""")
def _(t):
    return q.exact_duplicate_count(t.transactions_raw)
