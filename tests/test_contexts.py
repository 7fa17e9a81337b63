"""Measures in changed contexts, subtotals, and stored tables that follow their files."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions import pct
from tidemark.operators.aggregate import Calculated, Measures, rows
from tidemark.operators.contexts import Base, Model, row_count, subtotals
from tidemark.runtime import files_print, kept, release, stage

MODEL = Model(
    bases={"n": row_count("sales"), "value": Base("sales", lambda: F.col("v")), "top": Base("sales", lambda: F.col("v"), "max"),
           "budget": Base("plan", lambda: F.col("b"))},
    filters={"big": lambda: F.col("v") >= 10, "web": lambda: F.col("channel") == "web"},
    measures={
        "n": lambda m: m.total("n"), "value": lambda m: m.total("value"), "top": lambda m: m.total("top"),
        "big": lambda m: m.where("big")["value"], "big_web": lambda m: m.where("big").where("web")["value"],
        "everyone": lambda m: m.all()["value"], "share": lambda m: pct(m["value"], m["everyone"]),
        "before": lambda m: m.shift(1)["value"], "two_before": lambda m: m.shift(1).shift(1)["value"],
        "last_year": lambda m: m.last_year()["value"], "quarter": lambda m: m.trailing(3)["value"],
        "quarter_before": lambda m: m.shift(3).trailing(3)["value"], "top_quarter": lambda m: m.trailing(3)["top"],
        "everyone_before": lambda m: m.all().shift(1)["value"], "mean": lambda m: m.trailing_mean("value", 3),
        "of_budget": lambda m: pct(m["value"], m.total("budget")), "all_time": lambda m: m.all("month_no", "shop")["value"],
    })

# (month, shop, channel, value); month 3 has no row at all, shop b none in month 2, one shop is NULL
SALES = [(1, "a", "web", 5), (1, "a", "web", 20), (1, "b", "shop", 10), (2, "a", "shop", 7), (4, "a", "web", 11), (4, "b", "web", 1),
         (5, "b", None, 2), (13, "a", "web", 50), (4, None, "web", 3), (5, None, "web", 4)]
PERIODS = {"before": (-1, -1), "two_before": (-2, -2), "last_year": (-12, -12), "quarter": (-2, 0), "quarter_before": (-5, -3)}


def total(test):
    found = [v for m, s, c, v in SALES if test(m, s, c, v)]
    return sum(found) if found else None


@pytest.fixture
def facts(spark):
    return {"sales": spark.createDataFrame(SALES, "month_no int, shop string, channel string, v long"),
            "plan": spark.createDataFrame([(m, 100 * m) for m in range(1, 15)], "month_no int, b long")}


def test_contexts_with_missing_months(facts):
    got = {(r.month_no, r.shop): r for r in MODEL.evaluate(facts, by=["month_no", "shop"]).collect()}
    assert set(got) == {(m, s) for m, s, _, _ in SALES}
    for (month, shop), r in got.items():
        own = lambda m, s: s == shop and m == month  # noqa: E731, B023
        assert r.value == total(lambda m, s, c, v: own(m, s))
        assert r.big == total(lambda m, s, c, v: own(m, s) and v >= 10)
        assert r.big_web == total(lambda m, s, c, v: own(m, s) and v >= 10 and c == "web")
        assert r.everyone == total(lambda m, s, c, v: m == month)
        assert r.everyone_before == total(lambda m, s, c, v: m == month - 1)
        assert r.all_time == total(lambda *_: True)
        assert r.of_budget == round(r.value / month, 2)
        for name, (low, high) in PERIODS.items():
            assert r[name] == total(lambda m, s, c, v: s == shop and month + low <= m <= month + high), name  # noqa: B023
    assert got[4, "b"].top_quarter == 1 and got[4, "a"].top_quarter == 11 and got[5, "b"].mean == 1.5


def test_spine_gives_rows_to_missing_months(facts, spark):
    spine = spark.range(1, 6).select(F.col("id").cast("int").alias("month_no"))
    got = {r.month_no: r for r in MODEL.evaluate(facts, ["value", "before", "quarter"], ["month_no"], spine).collect()}
    assert got[3].value is None and got[3].before == 7 and got[3].quarter == 42 and sorted(got) == [1, 2, 3, 4, 5]


def test_without_slices_and_without_rows(facts):
    names = ["n", "value", "big", "share", "of_budget"]
    row = MODEL.evaluate(facts, names).first()
    assert (row.n, row.value, row.big, row.share) == (10, 113, 91, 100.0)
    empty = facts | {"sales": facts["sales"].limit(0)}
    assert MODEL.evaluate(empty, ["value"]).first().value is None
    assert MODEL.evaluate(empty, ["value", "before"], ["month_no", "shop"]).count() == 0


def test_periods_need_the_period(facts):
    for names, by in ((["before"], ["shop"]), (["budget_shop"], ["shop"])):
        with pytest.raises((ValueError, KeyError)):
            MODEL.evaluate(facts, names, by)
    with pytest.raises(ValueError):
        MODEL.evaluate({"plan": facts["plan"], "sales": facts["sales"].drop("shop")}, ["value"], ["month_no", "shop"])


def test_each_fact_is_read_once(spark, facts, tmp_path):
    facts["sales"].coalesce(1).write.parquet(str(tmp_path / "sales"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        seen.add(1)
        yield from batches

    stored = spark.read.parquet(str(tmp_path / "sales"))
    counted = stored.mapInArrow(count, stored.schema)
    MODEL.evaluate(facts | {"sales": counted}, ["value", "big", "share", "before", "quarter", "all_time"], ["month_no", "shop"]).collect()
    assert seen.value == 1
    measures = Measures(n=rows, value=lambda: F.sum("v"), distinct=lambda: F.countDistinct("channel"))
    out = measures.evaluate(counted, by=["month_no", "shop"], calculated={
        "big": Calculated("value", where=F.col("v") >= 10), "shops": Calculated("distinct", all_of=("shop",)),
        "all_n": Calculated("n", all_of=("shop", "month_no"))})
    got = {(r.month_no, r.shop): r for r in out.collect()}
    assert seen.value == 2
    assert got[1, "a"].big == 20 and got[5, "b"].big is None and got[1, "b"].shops == 2 and got[5, None].all_n == 10


def test_measures_of_no_rows(facts):
    measures = Measures(n=rows, value=lambda: F.sum("v"))
    empty = facts["sales"].limit(0)
    assert measures.evaluate(empty, by=["shop"], calculated={"all_n": Calculated("n", all_of=("shop",))}).count() == 0
    assert measures.evaluate(empty, calculated={"big": Calculated("value", where=F.col("v") > 9)}).count() == 1


def test_subtotals_tell_null_from_all(facts):
    out = subtotals(facts["sales"], ["month_no", "shop"], [F.sum("v").alias("value")]).collect()
    got = {(r.month_no, r.shop, r.level): r.value for r in out}
    assert len(got) == len(out)
    assert got["(all)", "(all)", 0] == 113 and got["(all)", "(none)", 1] == 7 and got["4", "(all)", 1] == 15 and got["4", "(none)", 2] == 3
    some = subtotals(facts["sales"], ["month_no", "shop"], [F.sum("v").alias("value")], [["shop"], []]).collect()
    assert {r.level for r in some} == {0, 1} and len(some) == 4


def test_stored_tables_follow_their_files(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.range(3).write.parquet(source)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("twice"))

    assert kept(spark, "followed", build, [source]).count() == 3
    assert kept(spark, "followed", build, [source]).count() == 3 and len(built) == 1
    before = files_print(spark, source)
    spark.range(2).write.mode("append").parquet(source)
    assert files_print(spark, source) != before
    assert kept(spark, "followed", build, [source]).count() == 5 and len(built) == 2
    assert files_print(spark, str(tmp_path / "nowhere")) == files_print(spark)


def test_released_tables_are_gone(spark):
    table = stage(spark.range(5))
    path = table.staged_path.removeprefix("file:")
    assert table.count() == 5 and os.path.exists(path)
    release(table)
    assert not os.path.exists(path)
