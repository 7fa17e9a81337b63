"""Customer value: sales cleaning, RFM, clustering, segments."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import as_double, clamp, round_to
from tidemark.operators.aggregate import mean, one_row, rows, share_of_total
from tidemark.operators.clean import canonicalize, dedup_rows, require
from tidemark.operators.positions import tile_table
from tidemark.operators.ranks import lerp, order_statistics
from tidemark.operators.window import average_rank
from tidemark.plans.lloyd import Fit, fit_all
from tidemark.runtime import attach, materialize, spread, stage

# Segment names from best to worst composite rank.
SEGMENT_NAMES = ["Champions", "Loyal Regulars", "At Risk", "Hibernating / Lost"]
# Known spellings of country names.
COUNTRY_SPELLINGS = {
    "united kingdom": "United Kingdom",
    "uk": "United Kingdom",
    "germany": "Germany",
    "de": "Germany",
    "france": "France",
    "united states": "United States",
    "usa": "United States",
    "us": "United States",
    "ireland": "Ireland",
}
FEATURES = ["recency", "frequency", "monetary"]
PRICE = "decimal(18,6)"
# A customer's invoices are dealt to so many tasks at most.
INVOICE_PARTS = 64


def clean_transactions(raw: DataFrame, countries, q: float = 0.995, within: Sequence[str] = ()) -> DataFrame:
    """Exact duplicates, country spellings, price caps, missing prices.

    Prices are capped at the category's q-quantile, then missing prices take
    the median of the capped prices. Capping keeps the order of the prices, so
    that median follows from the two middle prices and the cap: one histogram
    serves both steps. The distinct rows are written once; the histogram and the
    view read them. Reports that share the view read it through `runtime.kept`.
    `within` is that of `dedup_rows`.
    """
    rows_once = stage(dedup_rows(raw, within))
    df = canonicalize(rows_once, "country", countries, strip=True)
    stats = order_statistics(rows_once, "unit_price", ["category"], {"cap": q, "mid": 0.5})
    cap = lerp(F.col("cap_lo"), F.col("cap_hi"), F.col("cap_frac"))
    middle = lerp(F.least(as_double("mid_lo"), cap), F.least(as_double("mid_hi"), cap), F.col("mid_frac"))
    stats = stats.select("category", cap.cast(PRICE).alias("_cap"), middle.cast(PRICE).alias("_median"))
    price = F.coalesce(clamp(F.col("unit_price").cast(PRICE), hi=F.col("_cap")), F.col("_median"))
    return attach(df, stats, "category").withColumn("unit_price", price).drop("_cap", "_median")


def with_line_total(df: DataFrame) -> DataFrame:
    return df.withColumn("line_total", F.col("quantity") * F.col("unit_price"))


def sales_of(cleaned: DataFrame) -> DataFrame:
    return with_line_total(cleaned).where(F.col("quantity") > 0)


def customer_sales(sales: DataFrame) -> DataFrame:
    """Sales with a known customer; guests count only in revenue totals."""
    return require(sales, ["customer_id"])


def order_values(sales: DataFrame) -> DataFrame:
    return spread(sales, "invoice_no").groupBy("invoice_no").agg(F.sum("line_total").alias("order_value"))


def rfm(sales: DataFrame, first_by: Sequence[str] = ("invoice_date", "invoice_no", "line_no", "product_id")) -> DataFrame:
    """Recency, frequency, monetary value and first channel per customer.

    Invoices are summed first: a customer with very many lines is spread over
    `INVOICE_PARTS` tasks by its invoices, and distinct invoices become a plain
    count. The parts of a customer then meet in as many tasks as the files ask for.
    """
    part = F.pmod(F.xxhash64("invoice_no"), F.lit(INVOICE_PARTS)).alias("_part")
    known = spread(customer_sales(sales).select("*", part), "customer_id", "_part")
    first = F.min(F.struct(*first_by, "channel"))
    invoices = known.groupBy("customer_id", "_part", "invoice_no").agg(
        F.max("invoice_date").alias("_last"), F.sum("line_total").alias("_value"), first.alias("_first"))
    parts = invoices.groupBy("customer_id", "_part").agg(
        F.max("_last").alias("_last"), rows().alias("_invoices"), F.sum("_value").alias("_value"),
        F.min("_first").alias("_first"))
    people = spread(parts, "customer_id").groupBy("customer_id").agg(
        F.max("_last").alias("_last"), F.sum("_invoices").alias("frequency"), F.sum("_value").alias("monetary"),
        F.min("_first").alias("_first"))
    snapshot = one_row(people, F.date_add(F.max("_last"), 1).alias("_snapshot"))
    return people.crossJoin(F.broadcast(snapshot)).select(
        "customer_id", F.datediff("_snapshot", "_last").alias("recency"), "frequency", "monetary",
        F.col("_first.channel").alias("channel"))


def quintiles(people: DataFrame, count: int = 5) -> DataFrame:
    """Scores r, f and m from 1 to `count`: tiles over all customers, the most recent and highest last.

    Customers of equal values are dealt by their id; one without an id has no scores.
    The customers are written once; the three tiles and the result read them.
    """
    values = stage(people).select("customer_id", (-F.col("recency")).alias("_r"), F.col("frequency").alias("_f"),
                                  F.col("monetary").alias("_m"))
    out = values
    for score in "rfm":
        out = attach(out, tile_table(values, f"_{score}", "customer_id", count, score), [f"_{score}", "customer_id"])
    return out.select("customer_id", *"rfm")


def log_scale(df: DataFrame, cols: Sequence[str] = FEATURES) -> DataFrame:
    """z-scores of log(1 + x) with the POPULATION standard deviation."""
    logs = df.withColumns({f"log_{c}": F.log1p(as_double(c)) for c in cols})
    stats = logs.agg(*[F.avg(f"log_{c}").alias(f"_m_{c}") for c in cols],
                     *[F.stddev_pop(f"log_{c}").alias(f"_s_{c}") for c in cols])
    scaled = {f"z_{c}": F.coalesce(F.try_divide(F.col(f"log_{c}") - F.col(f"_m_{c}"), F.col(f"_s_{c}")), F.lit(0.0))
              for c in cols}
    drop = [f"_{k}_{c}" for k in "ms" for c in cols] + [f"log_{c}" for c in cols]
    return logs.crossJoin(F.broadcast(stats)).withColumns(scaled).drop(*drop)


def best_fits(scaled: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42,
              cols: Sequence[str] = FEATURES) -> dict[int, Fit]:
    """For each k the fit of lowest inertia out of n_init starts; all runs share their passes."""
    fits = fit_all(scaled, list(ks), [f"z_{c}" for c in cols], n_init, seed)
    return {k: min((f for f in fits if f.k == k), key=lambda f: f.inertia) for k in ks}


def inertia_by_k(scaled: DataFrame, ks: Sequence[int] = range(2, 9), n_init: int = 10,
                 seed: int = 42) -> dict[int, float]:
    return {k: f.inertia for k, f in best_fits(scaled, list(ks), n_init, seed).items()}


def centre_table(fit: Fit, spark: SparkSession, cols: Sequence[str] = FEATURES) -> DataFrame:
    """The k centres of a fit, one row each."""
    rows_ = [(i, *map(float, c)) for i, c in enumerate(fit.centres)]
    return spark.createDataFrame(rows_, "cluster int, " + ", ".join(f"z_{c} double" for c in cols))


def assign(scaled: DataFrame, centres: DataFrame, by: str = "cluster", cols: Sequence[str] = FEATURES) -> DataFrame:
    """Nearest centre and squared distance on every row; equal distances go to the least centre.

    The k centres travel as one row.
    """
    packed = centres.agg(F.collect_list(F.struct(by, *[f"z_{c}" for c in cols])).alias("_centres"))

    def distance(c) -> Column:
        return reduce(lambda a, b: a + b, [F.pow(F.col(f"z_{x}") - c[f"z_{x}"], F.lit(2.0)) for x in cols])

    nearest = F.array_min(F.transform("_centres", lambda c: F.struct(distance(c).alias("d"), c[by].alias("k"))))
    return scaled.drop(by).crossJoin(F.broadcast(packed)).withColumn("_nearest", nearest).withColumns(
        {by: F.col("_nearest.k"), "distance": F.col("_nearest.d")}).drop("_centres", "_nearest")


def update_centres(assigned: DataFrame, by: str = "cluster", cols: Sequence[str] = FEATURES) -> DataFrame:
    """Means of the rows assigned to each centre."""
    return assigned.groupBy(by).agg(*[F.avg(f"z_{c}").alias(f"z_{c}") for c in cols])


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("distance").alias("inertia"))


def segment(rfm_table: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42) -> DataFrame:
    """RFM rows with their cluster.

    The customer table is computed once; scaling, fits and assignment read it.
    """
    scaled = log_scale(materialize(rfm_table))
    fit = best_fits(scaled, [k], n_init, seed)[k]
    return assign(scaled, centre_table(fit, scaled.sparkSession)).drop("distance", *[f"z_{c}" for c in FEATURES])


def segment_profile(clustered: DataFrame, by: str = "cluster") -> DataFrame:
    """Size, mean R, F, M and revenue per cluster, rounded to one decimal."""
    return clustered.groupBy(by).agg(
        rows().alias("customers"), round_to(mean("recency"), 1).alias("avg_recency"),
        round_to(mean("frequency"), 1).alias("avg_frequency"),
        round_to(mean("monetary"), 1).alias("avg_monetary"),
        round_to(F.sum("monetary"), 1).alias("total_revenue"))


def label_segments(profile: DataFrame, by: str = "cluster", names: Sequence[str] = SEGMENT_NAMES) -> DataFrame:
    """Name clusters by the mean of their three (rounded) ranks.

    Recent, frequent and high spending ranks first; equal composites are
    settled by the cluster id. With another number of clusters the names are
    generic.
    """
    composite = (average_rank(F.col("avg_recency")) + average_rank(-F.col("avg_frequency"))
                 + average_rank(-F.col("avg_monetary"))) / F.lit(3.0)
    ranked = profile.withColumn("composite_rank", round_to(composite, 6))
    place = F.row_number().over(Window.orderBy("composite_rank", by))
    size = F.count(F.lit(1)).over(Window.partitionBy())
    named = F.get(F.array(*[F.lit(n) for n in names]), F.col("_place") - 1)
    generic = F.concat(F.lit("Segment "), "_place", F.lit(" (rank "), "_place", F.lit(" of "), "_size", F.lit(")"))
    return (
        ranked.withColumn("_place", place).withColumn("_size", size)
        .withColumn("segment", F.when(F.col("_size") == len(names), named).otherwise(generic))
        .drop("_place", "_size")
    )


def segment_share(labelled: DataFrame) -> DataFrame:
    """Percent of customers and of (rounded) revenue per segment."""
    grouped = labelled.groupBy("segment").agg(F.sum("customers").alias("customers"),
                                              F.sum("total_revenue").alias("total_revenue"))
    both = share_of_total(share_of_total(grouped, "customers", "pct_of_customers", 1),
                          "total_revenue", "pct_of_revenue", 1)
    return both.select("segment", "pct_of_customers", "pct_of_revenue")


def label_customers(clustered: DataFrame, labelled: DataFrame, by: str = "cluster") -> DataFrame:
    """Segment name on every customer (one row per cluster is broadcast)."""
    return clustered.join(F.broadcast(labelled.select(by, "segment")), by, "left")


EXPORT_COLUMNS = ["customer_id", "channel", "recency", "frequency", "monetary", "segment"]
