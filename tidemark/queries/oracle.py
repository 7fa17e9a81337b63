"""SQL building blocks of the checks: role views and rounding.

The views repeat FIXTURES.md; every statement inlines those it needs.
"""

from __future__ import annotations


def R(expr: str, digits: int = 2) -> str:
    """Half-up rounding of the shortest decimal text, through 12 decimals."""
    return f"CAST(ROUND(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def D(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def I(expr: str) -> str:  # noqa: E743
    return f"CAST({expr} AS BIGINT)"


def Q(a: str, b: str) -> str:
    """Quotient in doubles, NULL on a zero divisor."""
    return f"({D(a)} / NULLIF({D(b)}, 0))"


def P(a: str, b: str, digits: int = 2) -> str:
    """Percentage."""
    return R(f"CAST(100 AS DOUBLE) * {D(a)} / NULLIF({D(b)}, 0)", digits)


def MEAN(x: str) -> str:
    return f"({D(f'SUM({x})')} / NULLIF({D(f'COUNT({x})')}, 0))"


N = "CAST(COUNT(*) AS BIGINT)"


def CW(test: str) -> str:
    """Conditional count."""
    return f"CAST(SUM(CASE WHEN {test} THEN 1 ELSE 0 END) AS BIGINT)"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}

CTES["geo"] = ((), "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")

CTES["subs"] = (("geo",), """
SELECT c.c_custkey AS customer_id, c.c_mktsegment AS plan,
       CASE WHEN c.c_custkey % 2 = 0 THEN 'Annual' ELSE 'Monthly' END AS billing_cycle,
       CASE WHEN o.n <= 5 THEN '1-10' WHEN o.n <= 8 THEN '11-50' WHEN o.n <= 11 THEN '51-200'
            WHEN o.n <= 14 THEN '201-500' ELSE '500+' END AS company_size,
       g.r_name AS region, o.total AS monthly_revenue, o.first_d AS signup_date,
       CASE WHEN o.last_d < DATE '2001-02-02' THEN 'Yes' ELSE 'No' END AS churned,
       CASE WHEN o.last_d < DATE '2001-02-02' THEN o.last_d END AS churn_date,
       CASE WHEN o.last_d < DATE '2001-02-02' THEN r.o_orderpriority END AS churn_reason,
       CAST(o.n % 13 AS INT) AS support_tickets_12mo,
       CAST(LEAST(FLOOR((c.c_acctbal + 1000) / 1100), 9) + 1 AS INT) AS nps_score,
       CAST(LEAST(o.n * 5, 100) AS INT) AS feature_usage_pct
FROM customer c JOIN (
  SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS first_d, CAST(MAX(o_orderdate) AS DATE) AS last_d,
         COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total
  FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
JOIN (SELECT o_custkey, o_orderpriority,
             ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
      FROM orders) r ON r.o_custkey = c.c_custkey AND r.rn = 1
JOIN geo g ON g.n_nationkey = c.c_nationkey""")

CTES["subs_v"] = (("subs",), f"""
SELECT *, strftime(signup_date, '%Y-%m') AS signup_month,
       CASE WHEN churned = 'Yes' THEN 1 ELSE 0 END AS is_churned,
       strftime(churn_date, '%Y-%m') AS churn_month,
       {R("CAST(date_diff('day', signup_date, COALESCE(churn_date, DATE '2001-08-01')) AS DOUBLE) / CAST(30.44 AS DOUBLE)", 1)}
         AS lifespan_months
FROM subs""")

CTES["lines_raw"] = ((), """
SELECT b.* FROM (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_no, l.l_suppkey AS supplier_id,
         CAST(o.o_orderdate AS DATE) AS order_date,
         CASE WHEN l.l_orderkey % 166 = 5 THEN -1 ELSE l.l_partkey END AS product_id,
         p.p_type AS category, o.o_orderpriority AS channel, CAST(l.l_quantity AS INT) AS quantity,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS gross_revenue,
         CASE WHEN l.l_orderkey % 500 = 7 THEN CAST(-5 AS DECIMAL(18,4))
              ELSE CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))
         END AS discount_amount,
         CASE WHEN l.l_orderkey % 100 = 3 THEN NULL ELSE CAST(l.l_quantity + 4 AS DECIMAL(18,2)) END AS shipping_cost,
         CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS platform_fee,
         CASE WHEN l.l_returnflag = 'R' THEN 'Yes' ELSE 'No' END AS is_returned,
         CASE WHEN l.l_returnflag = 'R' THEN p.p_brand END AS return_reason,
         CASE WHEN l.l_returnflag = 'R' THEN CAST(4 AS DECIMAL(18,2)) ELSE CAST(0 AS DECIMAL(18,2)) END
           AS return_processing_cost,
         l.l_shipdate AS shipped_at
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey) b
JOIN (SELECT 0 AS copy UNION ALL SELECT 1) c ON c.copy = 0 OR b.order_id % 125 = 0""")

CTES["products"] = ((), """
SELECT p_partkey AS product_id, p_type AS category, p_name AS product_name,
       CAST(ROUND(p_retailprice * 0.6, 2) AS DECIMAL(18,2)) AS unit_cost,
       CAST(p_retailprice AS DECIMAL(18,2)) AS list_price
FROM part""")

CTES["lines_dedup"] = (("lines_raw",), "SELECT DISTINCT * FROM lines_raw")
CTES["ship_fill"] = (("lines_dedup",), f"""
SELECT category, CAST({MEAN('shipping_cost')} AS DECIMAL(18,6)) AS fill
FROM lines_dedup GROUP BY category""")
CTES["lines"] = (("lines_dedup", "ship_fill", "products"), """
SELECT x.*, x.product_cost + x.shipping_cost + x.platform_fee + x.return_processing_cost AS total_cost,
       CASE WHEN is_returned = 'Yes' THEN 0 ELSE gross_revenue - discount_amount END AS net_revenue
FROM (SELECT d.order_id, d.line_no, d.supplier_id, d.order_date, strftime(d.order_date, '%Y-%m') AS order_month,
             d.product_id, d.category, d.channel, d.quantity, d.gross_revenue,
             CASE WHEN d.discount_amount < 0 THEN 0 ELSE d.discount_amount END AS discount_amount,
             COALESCE(CAST(d.shipping_cost AS DECIMAL(18,6)), f.fill) AS shipping_cost, d.platform_fee,
             d.is_returned, d.return_reason, d.return_processing_cost, d.shipped_at, p.unit_cost,
             p.unit_cost * d.quantity AS product_cost
      FROM lines_dedup d JOIN products p ON p.product_id = d.product_id
      LEFT JOIN ship_fill f ON f.category = d.category) x""")

CTES["marketing"] = ((), """
SELECT strftime(o.o_orderdate, '%Y-%m') AS month, o.o_orderpriority AS platform,
       CAST(SUM(CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)))
            AS DECIMAL(18,4)) AS spend,
       CAST(COUNT(*) * 10 AS BIGINT) AS clicks, CAST(COUNT(DISTINCT o.o_orderkey) AS BIGINT) AS conversions,
       CAST(SUM(CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)) * 3 AS DECIMAL(18,4)))
            AS DECIMAL(18,4)) AS attributed_revenue
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
GROUP BY strftime(o.o_orderdate, '%Y-%m'), o.o_orderpriority""")

CTES["months"] = (("subs_v",), """
SELECT strftime(m, '%Y-%m') AS month
FROM (SELECT UNNEST(generate_series(date_trunc('month', MIN(signup_date)), TIMESTAMP '2001-08-01',
                                    INTERVAL 1 MONTH)) AS m FROM subs_v)""")
CTES["monthly"] = (("months", "subs_v", "marketing"), f"""
SELECT x.month, active AS total_active_customers, n_new AS new_customers, n_gone AS churned_customers,
       COALESCE({P('n_gone', 'active')}, 0) AS monthly_churn_rate_pct, mrr AS total_mrr,
       {R(Q('mrr', 'active'))} AS avg_revenue_per_customer,
       {R(Q('s.spend', 'n_new'))} AS customer_acquisition_cost
FROM (SELECT m.month,
             {CW('v.signup_month < m.month AND (v.churn_month IS NULL OR v.churn_month >= m.month)')} AS active,
             {CW('v.signup_month = m.month')} AS n_new, {CW('v.churn_month = m.month')} AS n_gone,
             CAST(SUM(CASE WHEN v.signup_month < m.month AND (v.churn_month IS NULL OR v.churn_month >= m.month)
                           THEN v.monthly_revenue ELSE 0 END) AS DECIMAL(18,2)) AS mrr
      FROM months m CROSS JOIN subs_v v GROUP BY m.month) x
LEFT JOIN (SELECT month, SUM(spend) AS spend FROM marketing GROUP BY month) s ON s.month = x.month""")

CTES["inc_raw"] = (("geo",), """
SELECT strftime(l.l_shipdate, '%m/%d/%Y') AS crash_date_text,
       CASE WHEN l.l_partkey % 7 = 0 THEN CAST(l.l_suppkey % 24 AS VARCHAR)
            ELSE lpad(CAST(l.l_suppkey % 24 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(l.l_partkey % 60 AS VARCHAR), 2, '0')
         AS crash_time,
       CASE WHEN l.l_suppkey % 11 = 0 THEN NULL ELSE g.r_name END AS borough,
       lpad(CAST(l.l_suppkey % 1000 AS VARCHAR), 5, '0') AS zip_code,
       CASE WHEN l.l_partkey % 500 = 1 THEN CAST(0 AS DOUBLE)
            ELSE CAST(40 AS DOUBLE) + CAST(l.l_suppkey AS DOUBLE) / CAST(100 AS DOUBLE) END AS latitude,
       CASE WHEN l.l_partkey % 500 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(-74 AS DOUBLE) END AS longitude,
       CASE WHEN l.l_partkey % 25 = 2 THEN NULL ELSE g.n_name END AS on_street,
       CASE WHEN l.l_partkey % 6 = 3 THEN NULL ELSE p.p_brand END AS cross_street,
       CASE WHEN l.l_quantity < 5 THEN 1 WHEN l.l_quantity = 6 THEN 1 WHEN l.l_quantity BETWEEN 7 AND 14 THEN 2
            ELSE 0 END + CASE WHEN l.l_orderkey % 700 = 1 THEN 1 ELSE 0 END AS persons_injured,
       CASE WHEN l.l_quantity = 50 AND l.l_partkey % 4 < 3 THEN 1 ELSE 0 END AS persons_killed,
       CASE WHEN l.l_quantity < 5 THEN 1 ELSE 0 END AS pedestrians_injured,
       CASE WHEN l.l_quantity = 50 AND l.l_partkey % 4 = 0 THEN 1 ELSE 0 END AS pedestrians_killed,
       CASE WHEN l.l_quantity = 6 THEN 1 ELSE 0 END AS cyclists_injured,
       CASE WHEN l.l_quantity = 50 AND l.l_partkey % 4 = 1 THEN 1 ELSE 0 END AS cyclists_killed,
       CASE WHEN l.l_quantity BETWEEN 7 AND 14 THEN 2 ELSE 0 END AS motorists_injured,
       CASE WHEN l.l_quantity = 50 AND l.l_partkey % 4 = 2 THEN 1 ELSE 0 END AS motorists_killed,
       CASE WHEN p.p_size <= 15 THEN 'Unspecified' WHEN p.p_size <= 20 THEN 'Unsafe Speed' ELSE p.p_brand END
         AS contributing_factor_1,
       p.p_name AS contributing_factor_2,
       CASE WHEN l.l_linenumber = 2 THEN lower(p.p_type) ELSE p.p_type END AS vehicle_type_1,
       CASE WHEN l.l_linenumber = 3 THEN NULL ELSE lower(p.p_type) END AS vehicle_type_2,
       l.l_orderkey * 10 + l.l_linenumber AS collision_id,
       l.l_partkey AS tie_1, l.l_suppkey AS tie_2, l.l_shipdate AS tie_3, l.l_extendedprice AS tie_4
FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey
JOIN geo g ON g.n_nationkey = s.s_nationkey""")

CTES["inc"] = (("inc_raw",), """
SELECT * REPLACE (CASE WHEN latitude = 0 AND longitude = 0 THEN NULL ELSE latitude END AS latitude,
                  CASE WHEN latitude = 0 AND longitude = 0 THEN NULL ELSE longitude END AS longitude),
       CAST(strptime(crash_date_text, '%m/%d/%Y') AS DATE) AS crash_date,
       CAST(substr(crash_date_text, 7, 4) AS INTEGER) AS crash_year,
       CAST(substr(crash_date_text, 1, 2) AS INTEGER) AS crash_month,
       CAST(regexp_extract(substr(crash_time, 1, 2), '^[0-9]+') AS INTEGER) AS crash_hour,
       CASE WHEN lower(vehicle_type_1) IN ('economy', 'large', 'medium', 'promo', 'small', 'standard')
            THEN upper(vehicle_type_1) ELSE vehicle_type_1 END AS vehicle_type_1_clean,
       CASE WHEN lower(vehicle_type_2) IN ('economy', 'large', 'medium', 'promo', 'small', 'standard')
            THEN upper(vehicle_type_2) ELSE vehicle_type_2 END AS vehicle_type_2_clean
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY collision_id ORDER BY tie_1, tie_2, tie_3, tie_4) AS rn FROM inc_raw)
WHERE rn = 1""")

CTES["tx_raw"] = ((), """
SELECT b.* FROM (
  SELECT o.o_orderkey AS invoice_no, l.l_linenumber AS line_no, l.l_partkey AS product_id,
         CAST(o.o_orderdate AS DATE) AS invoice_date,
         CASE WHEN l.l_orderkey % 25 = 0 THEN NULL ELSE o.o_custkey END AS customer_id,
         p.p_type AS category, c.c_mktsegment AS channel,
         CASE WHEN l.l_orderkey % 3 = 0 THEN lower(t.n_name) WHEN l.l_orderkey % 3 = 1 THEN concat(chr(9), ' ', t.n_name)
              ELSE t.n_name END AS country,
         CASE WHEN l.l_orderkey % 50 = 9 THEN -CAST(l.l_quantity AS INT) ELSE CAST(l.l_quantity AS INT) END AS quantity,
         CASE WHEN l.l_orderkey % 331 = 2 THEN NULL
              WHEN l.l_orderkey % 500 = 3 THEN CAST(p.p_retailprice * 80 AS DECIMAL(18,2))
              ELSE CAST(p.p_retailprice AS DECIMAL(18,2)) END AS unit_price
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey
  JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation t ON t.n_nationkey = c.c_nationkey) b
JOIN (SELECT 0 AS copy UNION ALL SELECT 1) k ON k.copy = 0 OR b.invoice_no % 100 = 1""")

CTES["tx_named"] = (("tx_raw",), """
SELECT d.* REPLACE (COALESCE(t.n_name, d.country) AS country)
FROM (SELECT DISTINCT * FROM tx_raw) d LEFT JOIN nation t ON lower(t.n_name) = lower(trim(d.country, ' ' || chr(9)))""")
CTES["tx_caps"] = (("tx_named",), """
SELECT category, CAST(quantile_cont(CAST(unit_price AS DOUBLE), 0.995) AS DECIMAL(18,6)) AS cap
FROM tx_named WHERE unit_price IS NOT NULL GROUP BY category""")
CTES["tx_capped"] = (("tx_named", "tx_caps"), """
SELECT t.* REPLACE (CASE WHEN t.unit_price > c.cap THEN c.cap ELSE CAST(t.unit_price AS DECIMAL(18,6)) END AS unit_price)
FROM tx_named t LEFT JOIN tx_caps c ON c.category = t.category""")
CTES["tx_fill"] = (("tx_capped",), """
SELECT category, CAST(quantile_cont(CAST(unit_price AS DOUBLE), 0.5) AS DECIMAL(18,6)) AS fill
FROM tx_capped WHERE unit_price IS NOT NULL GROUP BY category""")
CTES["tx"] = (("tx_capped", "tx_fill"), """
SELECT t.* REPLACE (COALESCE(t.unit_price, f.fill) AS unit_price)
FROM tx_capped t LEFT JOIN tx_fill f ON f.category = t.category""")
CTES["sales"] = (("tx",), "SELECT *, quantity * unit_price AS line_total FROM tx WHERE quantity > 0")
CTES["returns"] = (("tx",), "SELECT *, quantity * unit_price AS line_total FROM tx WHERE quantity < 0")

CTES["rfm"] = (("sales",), """
SELECT customer_id, date_diff('day', MAX(invoice_date), (SELECT MAX(invoice_date) FROM sales
         WHERE customer_id IS NOT NULL) + 1) AS recency,
       COUNT(DISTINCT invoice_no) AS frequency, SUM(line_total) AS monetary,
       MIN_BY(channel, (invoice_date, invoice_no, line_no, product_id)) AS channel
FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id""")

CTES["cohorts"] = (("sales",), """
SELECT s.customer_id, s.channel, s.order_month, f.cohort_month,
       (year(s.order_month) - year(f.cohort_month)) * 12 + month(s.order_month) - month(f.cohort_month) AS cohort_index
FROM (SELECT DISTINCT customer_id, channel, CAST(date_trunc('month', invoice_date) AS DATE) AS order_month
      FROM sales WHERE customer_id IS NOT NULL) s
JOIN (SELECT customer_id, MIN(CAST(date_trunc('month', invoice_date) AS DATE)) AS cohort_month
      FROM sales WHERE customer_id IS NOT NULL GROUP BY customer_id) f ON f.customer_id = s.customer_id""")
