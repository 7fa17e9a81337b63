"""Partitions that grow with the stored rows, and rows that are cleaned once."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.operators import quality
from tidemark.operators.clean import dedup_rows
from tidemark.plans.cohort import cohort_assign
from tidemark.plans.profit import order_profit_view
from tidemark.plans.rfm import clean_transactions, order_values, quintiles, rfm
from tidemark.plans.stats import first_in_invoice
from tidemark.runtime import drop_kept, kept, partitions_for, spread, stage, stored_bytes

SALES = "customer_id long, invoice_no long, line_no int, product_id long, invoice_date date, channel string, line_total decimal(18,2)"
DAY = datetime.date(2024, 1, 2)


def sale(customer, invoice, line=1, value="1.00"):
    return customer, invoice, line, 1, DAY, "web", Decimal(value)


@pytest.fixture
def small_partitions(monkeypatch):
    monkeypatch.setattr(runtime, "PARTITION_BYTES", 100)


def test_partitions_grow_with_the_files(spark, small_partitions):
    few, many = stage(spark.range(50)), stage(spark.range(50_000))
    assert stored_bytes(spark, many.inputFiles()) > stored_bytes(spark, few.inputFiles()) > 0
    assert partitions_for(spark, many.inputFiles()) > partitions_for(spark, few.inputFiles()) >= 8
    assert spread(many, "id").rdd.getNumPartitions() == partitions_for(spark, many.inputFiles())
    assert partitions_for(spark, ["/no/such/folder"]) == 8
    assert stored_bytes(spark, ["/no/such/folder"]) == 0


def test_rows_without_files_are_left_alone(spark):
    df = spark.range(3)
    assert spread(df, "id") is df


def first_step_is_a_shuffle(df):
    """Nothing is gathered in the tasks of the scan: the lowest exchange lies below every aggregate."""
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    lowest = max(i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line)
    return all("Aggregate" not in line for line in plan[lowest:]) and "REPARTITION_BY_NUM" in plan[lowest]


def test_wide_rows_are_not_gathered_before_the_shuffle(spark, frame, collected):
    df = stage(frame([(1, None, "a"), (1, None, "a"), (2, 0.0, "b"), (2, -0.0, "b"), (None, None, None), (None, None, None)],
                     "k long, x double, `a b` string"))
    assert first_step_is_a_shuffle(dedup_rows(df))
    assert [r[0] for r in collected(dedup_rows(df).select("k"))] == [1, 2, None]


def test_duplicates_are_counted_in_many_partitions(spark, frame, monkeypatch):
    df = stage(frame([(1, None), (1, None), (2, 0.0), (2, -0.0), (None, None), (None, None)], "k long, x double"))
    seen, name = [], "spark.sql.shuffle.partitions"
    monkeypatch.setattr(quality, "materialize", lambda found: seen.append((spark.conf.get(name), first_step_is_a_shuffle(found))) or found)
    monkeypatch.setattr(runtime, "PARTITION_BYTES", 10)
    before = spark.conf.get(name)
    assert quality.exact_duplicate_count(df).first()[0] == 3
    assert seen == [(str(partitions_for(spark, df.inputFiles())), True)] and int(seen[0][0]) > int(before)
    assert spark.conf.get(name) == before


def test_invoices_are_not_gathered_before_the_shuffle(frame, collected):
    sales = stage(frame([sale(1, 1), sale(1, 1, 2, "2.00"), sale(1, 2), sale(2, 3, value="4.00"), sale(None, 4)], SALES))
    assert first_step_is_a_shuffle(order_values(sales))
    assert first_step_is_a_shuffle(first_in_invoice(sales))
    assert first_step_is_a_shuffle(rfm(sales).drop("recency"))
    assert collected(rfm(sales).select("customer_id", "frequency", "monetary")) == [(1, 2, Decimal("4.00")), (2, 1, Decimal("4.00"))]


def test_kept_tables_are_built_in_many_partitions(spark, tmp_path, small_partitions):
    spark.range(5000).write.parquet(str(tmp_path / "t"))
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before, seen = [spark.conf.get(n) for n in names], []

    def build():
        seen.append([spark.conf.get(n) for n in names])
        return spark.read.parquet(str(tmp_path / "t")).groupBy("id").count()

    def fail():
        raise ValueError("no rows")

    assert kept(spark, "many", build, [str(tmp_path / "t")]).count() == 5000
    assert seen == [[str(partitions_for(spark, [str(tmp_path / "t")])), "false"]] and int(seen[0][0]) > int(before[0])
    with pytest.raises(ValueError):
        kept(spark, "none", fail, [str(tmp_path / "t")])
    assert [spark.conf.get(n) for n in names] == before
    drop_kept(spark)


def test_cleaned_views_read_the_raw_rows_once(spark, tmp_path):
    spark.range(20).select(
        (F.col("id") % 10).alias("product_id"), F.lit("c").alias("category"), F.lit(DAY).alias("order_date"), F.lit(1).alias("quantity"),
        *[F.lit(2).cast("decimal(18,2)").alias(c) for c in ("gross_revenue", "discount_amount", "platform_fee", "return_processing_cost")],
        F.when(F.col("id") % 2 == 0, 3).cast("decimal(18,2)").alias("shipping_cost"), F.lit("No").alias("is_returned"),
    ).write.parquet(str(tmp_path / "lines"))
    products = spark.range(10).select(F.col("id").alias("product_id"), F.lit(1).cast("decimal(18,2)").alias("unit_cost"))
    view = order_profit_view(spark.read.parquet(str(tmp_path / "lines")), products)
    assert view.inputFiles() and not [f for f in view.inputFiles() if str(tmp_path) in f]
    assert view.count() == 10 and view.agg(F.sum("shipping_cost")).first()[0] == 30

    spark.range(4).select(
        F.lit("c").alias("category"), F.lit("uk").alias("country"), F.lit(1).alias("quantity"),
        F.when(F.col("id") > 0, F.col("id")).cast("decimal(18,2)").alias("unit_price")).write.parquet(str(tmp_path / "tx"))
    clean = clean_transactions(spark.read.parquet(str(tmp_path / "tx")), {"uk": "United Kingdom"})
    assert clean.inputFiles() and not [f for f in clean.inputFiles() if str(tmp_path) in f]
    assert sorted(r.unit_price for r in clean.collect()) == [Decimal(1), Decimal(2), Decimal(2), Decimal("2.99")]


def shuffles(df):
    """Keys and origin of every shuffle in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


def test_rows_of_an_order_stay_where_the_join_put_them(spark, frame, collected):
    lines = stage(frame([(1, "a"), (1, "a"), (1, None), (1, None), (2, "a")], "l long, x string"))
    orders = stage(frame([(1, 5), (2, 5), (2, 5)], "o long, day int"))
    files, name = [*lines.inputFiles(), *orders.inputFiles()], "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        with runtime.shuffled_wide(spark, partitions_for(spark, files)):
            joined = lines.join(orders, F.col("l") == F.col("o")).select(F.col("l").alias("order_id"), "x", "day")
            assert len(shuffles(dedup_rows(joined, ["order_id"]))) == 2 and len(shuffles(dedup_rows(joined))) == 3
            assert collected(dedup_rows(joined, ["order_id"])) == collected(dedup_rows(joined)) == [(1, "a", 5), (1, None, 5), (2, "a", 5)]
    finally:
        spark.conf.set(name, before)


def test_parts_of_a_customer_meet_in_many_partitions(spark, frame, collected, small_partitions):
    sales = stage(frame([sale(c, (c or 0) * 1000 + i, value=f"{i}.00") for c in (1, 2, None) for i in range(200)] + [sale(3, None), sale(3, None, 2)], SALES))
    wanted = f"{partitions_for(spark, sales.inputFiles())}), REPARTITION_BY_NUM"
    found = shuffles(rfm(sales))
    assert len(found) >= 2 and all(wanted in keys for keys in found)
    assert collected(rfm(sales).select("customer_id", "frequency", "monetary")) == [
        (1, 200, Decimal("19900.00")), (2, 200, Decimal("19900.00")), (3, 1, Decimal("2.00"))]


def test_customer_months_meet_in_many_partitions(spark, frame, collected, small_partitions):
    days = [datetime.date(2024, 1, 2), datetime.date(2024, 1, 9), datetime.date(2024, 3, 1)]
    sales = stage(frame([(c, d) for c in (1, 2, None) for d in days[c == 2:]], "customer_id long, invoice_date date"))
    wanted = f"{partitions_for(spark, sales.inputFiles())}), REPARTITION_BY_NUM"
    found = shuffles(cohort_assign(sales))
    assert len(found) == 2 and all(wanted in keys for keys in found) and first_step_is_a_shuffle(cohort_assign(sales))
    assert collected(cohort_assign(sales).select("customer_id", "cohort_index")) == [(1, 0), (1, 2), (2, 0), (2, 2)]


def test_scored_customers_are_computed_once(spark, frame, collected, tmp_path):
    frame([(i, i, 10 - i, Decimal(i % 3)) for i in range(10)], "customer_id long, recency int, frequency long, monetary decimal(18,2)") \
        .write.parquet(str(tmp_path / "people"))
    scores = quintiles(spark.read.parquet(str(tmp_path / "people")))
    assert not [f for f in scores.inputFiles() if str(tmp_path) in f]
    assert collected(scores)[0] == (0, 5, 5, 1) and collected(scores)[9] == (9, 1, 1, 2)
