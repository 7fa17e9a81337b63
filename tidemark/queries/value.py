"""Sales cleaning, RFM, cohorts, rank test."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import as_double, round_to
from tidemark.operators.aggregate import resample_month
from tidemark.plans import cohort as co
from tidemark.plans import rfm as rf
from tidemark.plans import stats as st
from tidemark.queries.base import query
from tidemark.queries.oracle import D, I, MEAN, N, P, R
from tidemark.runtime import materialize, scratch_path
from tidemark.sources.tables import export, read_table


@query("rfm_1_sales_clean", "sales", sql=f"""
SELECT invoice_no, line_no, product_id, invoice_date, customer_id, category, channel, country, quantity,
       {D('unit_price')} AS unit_price, {D('line_total')} AS line_total
FROM sales""")
def _(t):
    return t.sales.select("invoice_no", "line_no", "product_id", "invoice_date", "customer_id", "category", "channel",
                          "country", "quantity", "unit_price", "line_total")


@query("rfm_2_monthly_revenue", "sales", sql=f"""
WITH m AS (SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, SUM(line_total) AS v FROM sales GROUP BY 1),
spine AS (SELECT CAST(UNNEST(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM m)
SELECT spine.month, {D('COALESCE(m.v, 0)')} AS revenue FROM spine LEFT JOIN m ON m.month = spine.month""")
def _(t):
    return resample_month(t.sales, "invoice_date", "line_total", "revenue").orderBy("month")


@query("rfm_2_revenue_by_category", "sales",
       sql=f"SELECT category, {D('SUM(line_total)')} AS revenue FROM sales GROUP BY category")
def _(t):
    return t.sales.groupBy("category").agg(F.sum("line_total").alias("revenue")).orderBy(F.col("revenue").desc())


@query("rfm_2_order_value", "sales",
       sql=f"SELECT invoice_no, {D('SUM(line_total)')} AS order_value FROM sales GROUP BY invoice_no")
def _(t):
    return rf.order_values(t.sales)


@query("rfm_3_rfm", "rfm", sql=f"""
SELECT customer_id, {I('recency')} AS recency, {I('frequency')} AS frequency, {D('monetary')} AS monetary, channel
FROM rfm""")
def _(t):
    return rf.rfm(t.sales)


def _z(c: str) -> str:
    x = f"ln(1 + {D(c)})"
    return f"ROUND(({x} - AVG({x}) OVER ()) / STDDEV_POP({x}) OVER (), 5) AS z_{c}"


@query("sta_1_log_scale", "rfm", sql=f"SELECT customer_id, {_z('recency')}, {_z('frequency')}, {_z('monetary')} FROM rfm")
def _(t):
    return rf.log_scale(materialize(rf.rfm(t.sales))).select(
        "customer_id", *[F.round(f"z_{c}", 5).alias(f"z_{c}") for c in rf.FEATURES])


@query("prj_18_log1p", "rfm", sql="SELECT customer_id, ROUND(ln(1 + CAST(frequency AS DOUBLE)), 9) AS log_frequency FROM rfm")
def _(t):
    return rf.rfm(t.sales).select("customer_id", F.round(F.log1p(as_double("frequency")), 9).alias("log_frequency"))


def _clustered(t):
    return rf.segment(rf.rfm(t.sales))


# What is fitted differs between libraries; the facts below hold for any right fit.
FOUR = "CAST(4 AS BIGINT) AS segments"


@query("sta_2_kmeans_segment", "rfm", sql=f"""
SELECT {N} AS customers, {FOUR}, CAST(0 AS BIGINT) AS nearer_elsewhere, {R('SUM(monetary)')} AS monetary FROM rfm""")
def _(t):
    scaled = rf.log_scale(materialize(rf.rfm(t.sales)))
    fit = rf.best_fits(scaled, [4])[4]
    placed = rf.assign(scaled, rf.centre_table(fit, t.spark))
    # the same distances once more, from the centres as constants
    each = [sum(((F.col(f"z_{c}") - float(x)) ** 2 for c, x in zip(rf.FEATURES, centre, strict=True)), F.lit(0.0))
            for centre in fit.centres]
    return placed.agg(
        F.count("*").alias("customers"), F.countDistinct("cluster").alias("segments"),
        F.count_if(F.col("distance") > F.least(*each) + 1e-9).alias("nearer_elsewhere"),
        round_to(F.sum("monetary"), 2).alias("monetary"))


def _between(scaled, fits) -> dict[int, float]:
    """Squared distances of the centres to the mean (zero), by the customers placed at them: one pass for all k."""
    aggs = []
    for k, fit in fits.items():
        def far(centre):
            return sum(((F.col(f"z_{c}") - float(x)) ** 2 for c, x in zip(rf.FEATURES, centre, strict=True)), F.lit(0.0))

        options = [F.struct(far(c).alias("d"), F.lit(float((c ** 2).sum())).alias("s")) for c in fit.centres]
        aggs.append(F.sum(F.array_min(F.array(*options))["s"]).alias(str(k)))
    row = scaled.agg(*aggs).first()
    return {k: row[str(k)] for k in fits}


SPREAD = " + ".join(f"CASE WHEN VAR_POP(ln(1 + {D(c)})) > 0 THEN 1 ELSE 0 END" for c in ("recency", "frequency", "monetary"))


@query("sta_3_inertia_by_k", "rfm", sql=f"""
SELECT CAST(k AS INTEGER) AS k, CASE WHEN k = 1 THEN ROUND(({SPREAD}) * {D('COUNT(*)')}, 3) END AS inertia_of_one, FALSE AS rising,
       TRUE AS adds_up
FROM rfm CROSS JOIN range(1, 9) t(k) GROUP BY k""")
def _(t):
    # one cluster has the whole spread; with more, inertia and the spread of the centres add up to it
    scaled = rf.log_scale(materialize(rf.rfm(t.sales)))
    fits = rf.best_fits(scaled, range(1, 9))
    spread = _between(scaled, fits)
    rows_ = [(k, round(f.inertia, 3) if k == 1 else None, k > 1 and f.inertia > fits[k - 1].inertia,
              abs(f.inertia + spread[k] - fits[1].inertia) < 1e-3 * fits[1].inertia) for k, f in fits.items()]
    return t.spark.createDataFrame(rows_, "k int, inertia_of_one double, rising boolean, adds_up boolean")


def _channel_centres(t):
    """Scaled customers, and the means of each channel as four fixed centres."""
    scaled = rf.log_scale(materialize(rf.rfm(t.sales)))
    return scaled, rf.update_centres(scaled, by="channel")


CENTRES = f"""z AS (SELECT customer_id, channel, {", ".join(
    f"(ln(1 + {D(c)}) - AVG(ln(1 + {D(c)})) OVER ()) / STDDEV_POP(ln(1 + {D(c)})) OVER () AS z_{c}" for c in rf.FEATURES)}
  FROM rfm),
c AS (SELECT channel AS k, {", ".join(f"AVG(z_{c}) AS c_{c}" for c in rf.FEATURES)} FROM z GROUP BY channel),
d AS (SELECT customer_id, k, {" + ".join(f"pow(z_{c} - c_{c}, 2)" for c in rf.FEATURES)} AS d,
  {", ".join(f"z_{c}" for c in rf.FEATURES)} FROM z CROSS JOIN c),
a AS (SELECT * FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY d, k) = 1)"""


@query("sta_2_assign_to_centres", "rfm", sql=f"WITH {CENTRES} SELECT customer_id, k AS channel, ROUND(d, 5) AS distance FROM a")
def _(t):
    placed = rf.assign(*_channel_centres(t), by="channel")
    return placed.select("customer_id", "channel", F.round("distance", 5).alias("distance"))


@query("sta_2_update_centres", "rfm", sql=f"""
WITH {CENTRES} SELECT k AS channel, {", ".join(f"ROUND(AVG(z_{c}), 6) AS z_{c}" for c in rf.FEATURES)} FROM a GROUP BY k""")
def _(t):
    centres = rf.update_centres(rf.assign(*_channel_centres(t), by="channel"), by="channel")
    return centres.select("channel", *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in rf.FEATURES])


@query("sta_3_inertia_at_centres", "rfm", sql=f"WITH {CENTRES} SELECT ROUND(SUM(d), 4) AS inertia FROM a")
def _(t):
    return rf.inertia(rf.assign(*_channel_centres(t), by="channel")).select(F.round("inertia", 4).alias("inertia"))


@query("rfm_4_segment_profile", "rfm", sql=f"SELECT {N} AS customers, {FOUR}, TRUE AS revenue_reconciles FROM rfm")
def _(t):
    clustered = _clustered(t)
    total = clustered.agg(as_double(F.sum("monetary")).alias("total"))
    profile = rf.segment_profile(clustered).agg(
        F.sum("customers").alias("customers"), F.count("*").alias("segments"), F.sum("total_revenue").alias("revenue"))
    return profile.crossJoin(F.broadcast(total)).select(
        "customers", "segments", (F.abs(F.col("revenue") - F.col("total")) < 0.5).alias("revenue_reconciles"))


@query("rfm_5_label_segments", sql="SELECT UNNEST(['Champions', 'Loyal Regulars', 'At Risk', 'Hibernating / Lost']) AS segment")
def _(t):
    return rf.label_segments(rf.segment_profile(_clustered(t))).select("segment")


@query("rfm_6_segment_share", sql=f"SELECT {FOUR}, TRUE AS customers_sum_to_all, TRUE AS revenue_sums_to_all")
def _(t):
    share = rf.segment_share(rf.label_segments(rf.segment_profile(_clustered(t))))
    whole = [(F.abs(F.sum(f"pct_of_{c}") - 100) < 0.25).alias(n) for c, n in (
        ("customers", "customers_sum_to_all"), ("revenue", "revenue_sums_to_all"))]
    return share.agg(F.count("*").alias("segments"), *whole)


@query("rfm_7_export_segments", "rfm", sql=f"""
SELECT {N} AS customers, {FOUR}, {I('SUM(recency)')} AS recency, {I('SUM(frequency)')} AS frequency, {R('SUM(monetary)')} AS monetary
FROM rfm""")
def _(t):
    clustered = _clustered(t)
    labelled = rf.label_customers(clustered, rf.label_segments(rf.segment_profile(clustered)))
    path = export(labelled, rf.EXPORT_COLUMNS, scratch_path(t.spark, "segments"))
    stored = read_table(t.spark, path, "customer_id bigint, channel string, recency int, frequency bigint, "
                                       "monetary decimal(38,12), segment string")
    return stored.agg(F.countDistinct("customer_id").alias("customers"), F.countDistinct("segment").alias("segments"),
                      F.sum("recency").alias("recency"), F.sum("frequency").alias("frequency"),
                      round_to(F.sum("monetary"), 2).alias("monetary"))


# Profile, labels and shares over the channel as a fixed grouping: the same
# operators where the groups do not depend on a fitted model.
PROFILE = f"""p AS (
  SELECT channel, {N} AS customers, {R(MEAN('recency'), 1)} AS avg_recency, {R(MEAN('frequency'), 1)} AS avg_frequency,
         {R(MEAN('monetary'), 1)} AS avg_monetary, {R('SUM(monetary)', 1)} AS total_revenue
  FROM rfm GROUP BY channel)"""
RANKS = """(RANK() OVER (ORDER BY avg_recency) + (COUNT(*) OVER (PARTITION BY avg_recency) - 1) / 2.0::DOUBLE
   + RANK() OVER (ORDER BY avg_frequency DESC) + (COUNT(*) OVER (PARTITION BY avg_frequency) - 1) / 2.0::DOUBLE
   + RANK() OVER (ORDER BY avg_monetary DESC) + (COUNT(*) OVER (PARTITION BY avg_monetary) - 1) / 2.0::DOUBLE) / 3.0::DOUBLE"""


@query("rfm_4_profile_by_channel", "rfm", sql=f"WITH {PROFILE} SELECT * FROM p")
def _(t):
    return rf.segment_profile(rf.rfm(t.sales), by="channel")


@query("win_8_average_rank_labels", "rfm", sql=f"""
WITH {PROFILE}, r AS (SELECT p.*, {R(RANKS, 6)} AS composite_rank FROM p),
o AS (SELECT r.*, ROW_NUMBER() OVER (ORDER BY composite_rank, channel) AS i, COUNT(*) OVER () AS n FROM r)
SELECT o.* EXCLUDE (i, n),
       CASE WHEN n = 4 THEN list_extract(['Champions', 'Loyal Regulars', 'At Risk', 'Hibernating / Lost'], i)
            ELSE 'Segment ' || i || ' (rank ' || i || ' of ' || n || ')' END AS segment
FROM o""")
def _(t):
    return rf.label_segments(rf.segment_profile(rf.rfm(t.sales), by="channel"), by="channel")


@query("agg_19_share_of_rounded_totals", "rfm", sql=f"""
WITH {PROFILE}
SELECT channel AS segment, {P('customers', 'SUM(customers) OVER ()', 1)} AS pct_of_customers,
       {P('total_revenue', 'SUM(total_revenue) OVER ()', 1)} AS pct_of_revenue
FROM p""")
def _(t):
    profile = rf.segment_profile(rf.rfm(t.sales), by="channel").withColumnRenamed("channel", "segment")
    return rf.segment_share(profile)


@query("coh_1_cohort_assign", "cohorts",
       sql=f"SELECT DISTINCT customer_id, order_month, cohort_month, {I('cohort_index')} AS cohort_index FROM cohorts")
def _(t):
    return co.cohort_assign(t.sales).withColumn("cohort_index", F.col("cohort_index").cast("bigint"))


CELLS = """cells AS (SELECT strftime(cohort_month, '%Y-%m') AS cohort, CAST(cohort_index AS BIGINT) AS cohort_index,
                 CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS buyers FROM cohorts GROUP BY 1, 2),
full_cells AS (SELECT a.*, b.buyers AS cohort_size FROM cells a JOIN cells b ON b.cohort = a.cohort AND b.cohort_index = 0)"""


@query("coh_2_cohort_retention", "cohorts", sql=f"""
WITH {CELLS} SELECT *, {P('buyers', 'cohort_size', 6)} AS retention_pct FROM full_cells""")
def _(t):
    return co.cohort_retention(t.sales).withColumn("cohort_index", F.col("cohort_index").cast("bigint"))


@query("resh_2_pivot_matrix", "cohorts", sql=f"""
WITH {CELLS}, x AS (SELECT *, ROUND({P('buyers', 'cohort_size', 6)}, 0) AS r FROM full_cells)
SELECT cohort, {', '.join(f"MAX(CASE WHEN cohort_index = {i} THEN r END) AS m{i}" for i in range(12))}
FROM x GROUP BY cohort""")
def _(t):
    return co.retention_matrix(co.cohort_retention(t.sales))


CURVE = f"""WITH {CELLS}
SELECT cohort_index, {R(MEAN(f"CAST({P('buyers', 'cohort_size', 6)} AS DECIMAL(18,6))"), 4)} AS avg_retention_pct
FROM full_cells GROUP BY cohort_index"""


@query("coh_3_avg_retention_curve", "cohorts", sql=CURVE)
def _(t):
    curve = co.avg_retention_curve(co.cohort_retention(t.sales))
    return curve.withColumn("cohort_index", F.col("cohort_index").cast("bigint")).orderBy("cohort_index")


@query("coh_4_channel_retention", "cohorts", sql=f"""
WITH c AS (SELECT channel, CAST(cohort_index AS BIGINT) AS cohort_index,
                  CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS buyers FROM cohorts GROUP BY 1, 2),
s AS (SELECT channel, CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS channel_customers FROM cohorts GROUP BY 1)
SELECT c.*, s.channel_customers, {P('c.buyers', 's.channel_customers', 6)} AS retention_pct
FROM c JOIN s ON s.channel = c.channel""")
def _(t):
    return co.channel_retention(t.sales).withColumn("cohort_index", F.col("cohort_index").cast("bigint"))


VALUES = """ov AS (SELECT invoice_no, SUM(line_total) AS order_value, MIN_BY(channel, (line_no, product_id, channel)) AS channel
      FROM sales WHERE customer_id IS NOT NULL GROUP BY invoice_no)"""
A, B = "MACHINERY", "BUILDING"


def _order_channel(t):
    return st.first_in_invoice(rf.customer_sales(t.sales))


@query("agg_13_first_in_group", "sales",
       sql=f"WITH {VALUES} SELECT invoice_no, {D('order_value')} AS order_value, channel FROM ov")
def _(t):
    return _order_channel(t)


RANK_SQL = f"""
WITH {VALUES},
v AS (SELECT order_value, COUNT(*) AS t, SUM(CASE WHEN channel = '{A}' THEN 1 ELSE 0 END) AS ta
      FROM ov WHERE channel IN ('{A}', '{B}') GROUP BY order_value),
k AS (SELECT *, COALESCE(SUM(t) OVER (ORDER BY order_value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + (t + 1) / 2.0::DOUBLE AS mid FROM v),
s AS (SELECT {D('SUM(ta)')} AS n1, {D('SUM(t - ta)')} AS n2, {D('SUM(ta * mid)')} AS r1,
             {D('SUM(t * t * t - t)')} AS tie_term FROM k),
u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u_statistic, n1 + n2 AS n FROM s)
SELECT n1, n2, r1, tie_term, u_statistic,
       ROUND((GREATEST(u_statistic, n1 * n2 - u_statistic) - n1 * n2 / 2 - 0.5)
             / sqrt(n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1)))), 6) AS z
FROM u"""


@query("sta_4_rank_sums", "sales", sql=RANK_SQL)
def _(t):
    sums = st.rank_sums(_order_channel(t), "order_value", "channel", A, B)
    return sums.withColumn("z", F.round("z", 6))


# Two-sided p of the normal approximation: Simpson's rule over the density on
# [0, z], since the SQL engine has no error function.
P_SQL = RANK_SQL.rsplit("SELECT n1", 1)[0].rstrip() + """,
f AS (SELECT *, (GREATEST(u_statistic, n1 * n2 - u_statistic) - n1 * n2 / 2 - 0.5)
             / sqrt(n1 * n2 / 12 * ((n + 1) - tie_term / (n * (n - 1)))) AS z0 FROM u),
g AS (SELECT i, CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w
      FROM (SELECT UNNEST(range(0, 2001)) AS i)),
area AS (SELECT SUM(w * exp(-(z0 * i / 2000::DOUBLE) * (z0 * i / 2000::DOUBLE) / 2)) * MAX(z0) / 6000
                / sqrt(2 * pi()) AS a FROM f CROSS JOIN g)
SELECT n1, n2, r1, tie_term, u_statistic, ROUND(z0, 6) AS z,
       ROUND(LEAST(1, 1 - 2 * a), 6) AS p_value
FROM f CROSS JOIN area"""


@query("sta_4_rank_sum_test", "sales", sql=P_SQL)
def _(t):
    test = st.rank_sum_test(_order_channel(t), "order_value", "channel", A, B)
    return test.withColumns({"z": F.round("z", 6), "p_value": F.round("p_value", 6)})


@query("win_9_mid_rank", "sales", sql=f"""
WITH {VALUES}, v AS (SELECT order_value, COUNT(*) AS t FROM ov GROUP BY order_value)
SELECT {D('order_value')} AS order_value, {I('t')} AS n,
       CAST(COALESCE(SUM(t) OVER (ORDER BY order_value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         + (t + 1) / 2.0::DOUBLE AS mid_rank
FROM v""")
def _(t):
    from tidemark.operators.ranks import value_ranks

    ranked = value_ranks(_order_channel(t), "order_value")
    return ranked.select("order_value", "n", (as_double("before") + (as_double("n") + 1) / 2).alias("mid_rank"))


