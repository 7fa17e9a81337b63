"""Role views: the generated test tables in the shape of the six inputs.

The planted defects follow FIXTURES.md; they touch some rows of every table and
filter none away.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import month_key, month_start, pct, round_to, safe_div
from tidemark.operators.aggregate import one_row
from tidemark.runtime import spread

SNAPSHOT = "2001-08-01"
ACTIVE_SINCE = "2001-02-02"


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def product4(a: Column | str, b: Column | str) -> Column:
    """Money times a rate, kept at four decimals."""
    return (money(a) * F.col(b).cast("decimal(4,2)")).cast("decimal(18,4)")


def with_copies(df: DataFrame, test: Column) -> DataFrame:
    """Rows meeting the test twice, all others once, in one pass."""
    copies = F.when(test, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_copy", F.explode(copies)).drop("_copy")


class Tables:
    """The tables of one data directory and the role views over them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"}:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def geography(self) -> DataFrame:
        return self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def subs(self) -> DataFrame:
        """One row per ordering customer, as a subscription."""
        o = self.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
            F.min("o_orderdate").cast("date").alias("first_d"),
            F.max("o_orderdate").cast("date").alias("last_d"),
            F.count(F.lit(1)).alias("n"),
            F.sum(money("o_totalprice")).cast("decimal(18,2)").alias("total"),
            F.max(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("latest"),
        )
        gone = F.col("last_d") < F.to_date(F.lit(ACTIVE_SINCE))
        size = (
            F.when(F.col("n") <= 5, "1-10").when(F.col("n") <= 8, "11-50")
            .when(F.col("n") <= 11, "51-200").when(F.col("n") <= 14, "201-500").otherwise("500+")
        )
        joined = self.customer.join(o, "c_custkey").join(
            self.geography, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_mktsegment").alias("plan"),
            F.when(F.col("c_custkey") % 2 == 0, "Annual").otherwise("Monthly").alias("billing_cycle"),
            size.alias("company_size"),
            F.col("r_name").alias("region"),
            F.col("total").alias("monthly_revenue"),
            F.col("first_d").alias("signup_date"),
            F.when(gone, "Yes").otherwise("No").alias("churned"),
            F.when(gone, F.col("last_d")).alias("churn_date"),
            F.when(gone, F.col("latest.o_orderpriority")).alias("churn_reason"),
            (F.col("n") % 13).cast("int").alias("support_tickets_12mo"),
            (F.least(F.floor((F.col("c_acctbal") + 1000) / 1100), F.lit(9)) + 1).cast("int").alias("nps_score"),
            F.least(F.col("n") * 5, F.lit(100)).cast("int").alias("feature_usage_pct"),
        )

    @cached_property
    def order_lines_raw(self) -> DataFrame:
        returned = F.col("l_returnflag") == "R"
        # orders are joined last: the lines of an order lie together then
        lines = (
            self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(self.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_no"),
                F.col("l_suppkey").alias("supplier_id"),
                F.col("o_orderdate").cast("date").alias("order_date"),
                F.when(F.col("l_orderkey") % 166 == 5, F.lit(-1)).otherwise(F.col("l_partkey")).alias("product_id"),
                F.col("p_type").alias("category"),
                F.col("o_orderpriority").alias("channel"),
                F.col("l_quantity").cast("int").alias("quantity"),
                money("l_extendedprice").alias("gross_revenue"),
                F.when(F.col("l_orderkey") % 500 == 7, F.lit(-5).cast("decimal(18,4)"))
                .otherwise(product4("l_extendedprice", "l_discount")).alias("discount_amount"),
                F.when(F.col("l_orderkey") % 100 == 3, F.lit(None))
                .otherwise(money(F.col("l_quantity") + 4)).alias("shipping_cost"),
                product4("l_extendedprice", "l_tax").alias("platform_fee"),
                F.when(returned, "Yes").otherwise("No").alias("is_returned"),
                F.when(returned, F.col("p_brand")).alias("return_reason"),
                money(F.when(returned, F.lit(4)).otherwise(F.lit(0))).alias("return_processing_cost"),
                F.col("l_shipdate").alias("shipped_at"),
            )
        )
        return with_copies(lines, F.col("order_id") % 125 == 0)

    @cached_property
    def products(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_type").alias("category"),
            F.col("p_name").alias("product_name"),
            money(F.round(F.col("p_retailprice") * 0.6, 2)).alias("unit_cost"),
            money("p_retailprice").alias("list_price"),
        )

    @cached_property
    def marketing(self) -> DataFrame:
        """One row per month and platform; lines are summed per order first."""
        per_order = spread(self.lineitem, "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(product4("l_extendedprice", "l_tax")).alias("spend"),
            F.sum((money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)") * 3)
                  .cast("decimal(18,4)")).alias("revenue"),
        )
        return (
            self.orders.join(per_order, "o_orderkey")
            .groupBy(month_key("o_orderdate").alias("month"), F.col("o_orderpriority").alias("platform"))
            .agg(
                F.sum("spend").cast("decimal(18,4)").alias("spend"),
                (F.sum("lines") * 10).alias("clicks"),
                F.count(F.lit(1)).alias("conversions"),
                F.sum("revenue").cast("decimal(18,4)").alias("attributed_revenue"),
            )
        )

    @cached_property
    def monthly_revenue(self) -> DataFrame:
        """Month spine with opening balances, from running sums of the flows."""
        flow = F.explode(F.array(
            F.struct(month_key("signup_date").alias("month"), F.lit(1).alias("new"), F.lit(0).alias("gone"),
                     F.col("monthly_revenue").alias("mrr")),
            F.struct(month_key("churn_date").alias("month"), F.lit(0).alias("new"), F.lit(1).alias("gone"),
                     (-F.col("monthly_revenue")).cast("decimal(18,2)").alias("mrr")),
        ))
        flows = (
            self.subs.select(flow.alias("f")).select("f.*").dropna(subset=["month"])
            .groupBy("month").agg(F.sum("new").alias("new"), F.sum("gone").alias("gone"), F.sum("mrr").alias("mrr"))
        )
        # the first month with any flow is a signup month
        months = one_row(flows, month_start(F.min("month")).alias("a")).select(
            F.explode(F.expr(f"sequence(a, date'{SNAPSHOT}', interval 1 month)")).alias("m")
        ).select(month_key("m").alias("month"))
        spend = self.marketing.groupBy("month").agg(F.sum("spend").alias("spend"))
        before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
        new, gone = F.coalesce("new", F.lit(0)), F.coalesce("gone", F.lit(0))
        active = F.coalesce(F.sum(new - gone).over(before), F.lit(0))
        mrr = F.coalesce(F.sum("mrr").over(before), F.lit(0)).cast("decimal(18,2)")
        return (
            months.join(flows, "month", "left").join(spend, "month", "left")
            .select("month", active.alias("total_active_customers"), new.alias("new_customers"),
                    gone.alias("churned_customers"), mrr.alias("total_mrr"), "spend")
            .select(
                "month", "total_active_customers", "new_customers", "churned_customers",
                F.coalesce(pct("churned_customers", "total_active_customers"), F.lit(0.0))
                .alias("monthly_churn_rate_pct"),
                "total_mrr",
                round_to(safe_div("total_mrr", "total_active_customers"), 2).alias("avg_revenue_per_customer"),
                round_to(safe_div("spend", "new_customers"), 2).alias("customer_acquisition_cost"),
            )
        )

    @cached_property
    def incidents_raw(self) -> DataFrame:
        """Export-style incident rows, with tie columns for a total order."""
        q, p = F.col("l_quantity"), F.col("l_partkey")
        ped = F.when(q < 5, 1).otherwise(0)
        cyc = F.when(q == 6, 1).otherwise(0)
        mot = F.when(q.between(7, 14), 2).otherwise(0)
        killed = [F.when((q == 50) & (p % 4 == k), 1).otherwise(0) for k in range(3)]
        lost = p % 500 == 1
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        return (
            self.lineitem.join(self.part, p == F.col("p_partkey"))
            .join(self.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self.geography, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(
                F.date_format("l_shipdate", "MM/dd/yyyy").alias("CRASH DATE"),
                F.concat(F.when(p % 7 == 0, (F.col("l_suppkey") % 24).cast("string")).otherwise(two(F.col("l_suppkey") % 24)),
                         F.lit(":"), two(p % 60)).alias("CRASH TIME"),
                F.when(F.col("l_suppkey") % 11 == 0, None).otherwise(F.col("r_name")).alias("BOROUGH"),
                F.lpad((F.col("l_suppkey") % 1000).cast("string"), 5, "0").alias("ZIP CODE"),
                F.when(lost, 0.0).otherwise(F.lit(40.0) + F.col("l_suppkey") / F.lit(100.0)).alias("LATITUDE"),
                F.when(lost, 0.0).otherwise(-74.0).alias("LONGITUDE"),
                F.when(p % 25 == 2, None).otherwise(F.col("n_name")).alias("ON STREET NAME"),
                F.when(p % 6 == 3, None).otherwise(F.col("p_brand")).alias("CROSS STREET NAME"),
                (ped + cyc + mot + F.when(F.col("l_orderkey") % 700 == 1, 1).otherwise(0))
                .alias("NUMBER OF PERSONS INJURED"),
                (killed[0] + killed[1] + killed[2]).alias("NUMBER OF PERSONS KILLED"),
                ped.alias("NUMBER OF PEDESTRIANS INJURED"),
                killed[0].alias("NUMBER OF PEDESTRIANS KILLED"),
                cyc.alias("NUMBER OF CYCLIST INJURED"),
                killed[1].alias("NUMBER OF CYCLIST KILLED"),
                mot.alias("NUMBER OF MOTORIST INJURED"),
                killed[2].alias("NUMBER OF MOTORIST KILLED"),
                F.when(F.col("p_size") <= 15, "Unspecified").when(F.col("p_size") <= 20, "Unsafe Speed")
                .otherwise(F.col("p_brand"))
                .alias("CONTRIBUTING FACTOR VEHICLE 1"),
                F.col("p_name").alias("CONTRIBUTING FACTOR VEHICLE 2"),
                F.when(F.col("l_linenumber") == 2, F.lower("p_type")).otherwise(F.col("p_type"))
                .alias("VEHICLE TYPE CODE 1"),
                F.when(F.col("l_linenumber") == 3, None).otherwise(F.lower("p_type")).alias("VEHICLE TYPE CODE 2"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("COLLISION_ID"),
                p.alias("tie_1"), F.col("l_suppkey").alias("tie_2"),
                F.col("l_shipdate").alias("tie_3"), F.col("l_extendedprice").alias("tie_4"),
            )
        )

    @cached_property
    def transactions_raw(self) -> DataFrame:
        key = F.col("l_orderkey")
        price = F.col("p_retailprice")
        # customers are joined to the orders, which are fewer than the lines
        placed = (
            self.orders.join(self.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        )
        # and last, so that the lines of an invoice lie together then
        rows = (
            self.lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .join(placed, key == F.col("o_orderkey"))
            .select(
                F.col("o_orderkey").alias("invoice_no"),
                F.col("l_linenumber").alias("line_no"),
                F.col("l_partkey").alias("product_id"),
                F.col("o_orderdate").cast("date").alias("invoice_date"),
                F.when(key % 25 == 0, None).otherwise(F.col("o_custkey")).alias("customer_id"),
                F.col("p_type").alias("category"),
                F.col("c_mktsegment").alias("channel"),
                F.when(key % 3 == 0, F.lower("n_name")).when(key % 3 == 1, F.concat(F.lit("\t "), "n_name"))
                .otherwise(F.col("n_name")).alias("country"),
                F.when(key % 50 == 9, -F.col("l_quantity").cast("int"))
                .otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
                F.when(key % 331 == 2, None).when(key % 500 == 3, money(price * 80))
                .otherwise(money(price)).alias("unit_price"),
            )
        )
        return with_copies(rows, F.col("invoice_no") % 100 == 1)

    @cached_property
    def country_names(self) -> DataFrame:
        return self.nation.select(F.lower("n_name").alias("spelling"), F.col("n_name").alias("canonical"))

    @property
    def vehicle_spellings(self) -> dict[str, str]:
        # The part types of the test tables.
        return {v.lower(): v for v in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]}
