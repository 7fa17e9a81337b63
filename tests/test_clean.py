import datetime as dt
from decimal import Decimal as D

import pytest

from tidemark.operators import clean as cl
from tidemark.operators import quality as q
from tidemark.plans.profit import blended_margin, order_profit_view, profitability
from tidemark.plans.rfm import clean_transactions


def test_dedup_rows_is_idempotent_and_null_safe(frame, collected):
    df = frame([(1, None), (1, None), (2, "a")], "k int, v string")
    once = cl.dedup_rows(df)
    assert collected(once) == [(1, None), (2, "a")]
    assert collected(cl.dedup_rows(once)) == collected(once)


def test_dedup_key_demands_an_order(frame, collected):
    df = frame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "k int, o int, v string")
    assert collected(cl.dedup_key(df, "k", ["o"])) == [(1, 1, "a"), (2, 5, "c")]
    with pytest.raises(ValueError):
        cl.dedup_key(df, "k", [])


def test_dedup_key_limits_before_the_shuffle(spark):
    plan = cl.dedup_key(spark.range(100).selectExpr("id % 3 k", "id"), "k", ["id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in text and "WindowGroupLimit" in text


def test_first_per_key(frame, collected):
    df = frame([(1, 2, "b"), (1, 1, None), (2, 5, "c")], "k int, o int, v string")
    assert collected(cl.first_per_key(df, "k", ["v"], ["o"])) == [(1, None), (2, "c")]


def test_canonicalize_with_a_table(frame, collected):
    df = frame([(" DE ",), ("x",), (None,)], "c string")
    names = frame([("de", "Germany")], "spelling string, canonical string")
    assert collected(cl.canonicalize(df, "c", names, strip=True)) == [("Germany",), ("x",), (None,)]


@pytest.mark.parametrize("stat,fill", [("mean", D("5.000000")), ("median", D("2.000000"))])
def test_impute_group(frame, collected, stat, fill):
    df = frame([("a", D("1")), ("a", D("2")), ("a", D("12")), ("a", None), ("b", None), (None, None)],
               "g string, x decimal(18,2)")
    got = collected(cl.impute_group(df, "x", "g", stat))
    assert ("a", fill) in got and ("b", None) in got and (None, None) in got
    assert len(got) == 6


def test_cap_then_median_in_one_histogram(frame):
    """Few rows: the median of the capped prices is not the raw median."""
    rows = [(i, 1, 1, dt.date(2024, 1, 1), 1, "toys", "web", "x", 1, p)
            for i, p in enumerate([D("10.00"), D("110.00"), None])]
    raw = frame(rows, "invoice_no int, line_no int, product_id int, invoice_date date, customer_id int, "
                      "category string, channel string, country string, quantity int, unit_price decimal(18,2)")
    got = {r.invoice_no: r.unit_price for r in clean_transactions(raw, {"x": "X"}).collect()}
    cap = D("109.500000")  # 10 + 0.995 * 100
    assert got == {0: D("10.000000"), 1: cap, 2: (D(10) + cap) / 2}


ORDERS = ("order_id int, order_date date, product_id int, category string, channel string, quantity int, "
          "gross_revenue decimal(18,2), discount_amount decimal(18,2), shipping_cost decimal(18,2), "
          "platform_fee decimal(18,2), is_returned string, return_processing_cost decimal(18,2)")


def order(i, product=1, category="a", gross=100, discount=0, shipping=10, returned="No", quantity=1):
    money = lambda x: None if x is None else D(x)
    return (i, dt.date(2024, 1, 5), product, category, "web", quantity, money(gross), money(discount), money(shipping),
            D(5), returned, D(4) if returned == "Yes" else D(0))


@pytest.fixture
def profit_lines(frame):
    orders = frame([
        order(1), order(1),                          # exact duplicate
        order(2, shipping=None),                     # filled with the category mean of 10 and 30
        order(3, shipping=30, discount=-5),          # negative discount
        order(4, product=99, shipping=30),           # orphan: counts for the mean, not for profit
        order(5, category="b", returned="Yes", quantity=2),
    ], ORDERS)
    products = frame([(1, "other", D("20.00"))], "product_id int, category string, unit_cost decimal(18,2)")
    return order_profit_view(orders, products)


def test_order_profit_view(profit_lines):
    got = {r.order_id: r for r in profit_lines.collect()}
    assert sorted(got) == [1, 2, 3, 5]
    assert got[2].shipping_cost == D("23.333333")
    assert got[3].discount_amount == 0 and got[3].net_revenue == 100
    assert got[5].net_revenue == 0 and got[5].total_cost == 40 + 10 + 5 + 4
    assert got[5].category == "b" and got[5].order_month == "2024-01"


def test_profit_margin_of_returned_only_category_is_null(profit_lines):
    got = {r.category: r for r in profitability(profit_lines, ["category"]).collect()}
    assert got["b"].profit_margin_pct is None and got["b"].total_profit == -59.0
    assert got["a"].order_lines == 3 and got["a"].total_revenue == 300.0
    total = blended_margin(profit_lines).collect()[0].margin
    assert total == pytest.approx((300 - (60 + 10 + 23.333333 + 30 + 15) - 59) / 300)


def test_orphans_count_null_keys(frame, collected):
    child = frame([(1, D(5)), (None, D(7)), (9, D(1))], "k int, v decimal(18,2)")
    parent = frame([(1,), (2,)], "k int")
    assert collected(q.orphans(child, parent, "k").select("k")) == [(9,), (None,)]
    report = q.orphan_report(child, parent, "k", "v").collect()[0]
    assert (report.orphan_lines, report.orphan_value, report.pct_of_all_lines) == (2, 8.0, 66.67)


def test_quality_profiles(frame, collected):
    df = frame([(1, "a", None), (1, "a", None), (2, None, 3), (None, "b", 4)], "k int, c string, n int")
    assert collected(q.row_and_key_counts(df, "k")) == [(4, 2, 2)]
    assert collected(q.null_profile(df)) == [("c", 1), ("k", 1), ("n", 2)]
    assert collected(q.domain_values(df, ["c"])) == [("c", "a"), ("c", "b")]
    assert collected(q.exact_duplicate_count(df)) == [(1,)]
    assert collected(q.likely_duplicates(df, ["k", "c"])) == [(3,)]
    assert collected(q.range_profile(df, ["n"])) == [(3, 4)]


def test_spine(frame, collected):
    df = frame([("m1", "p1"), ("m1", "p2"), ("m2", "p1"), ("m2", "p1")], "month string, platform string")
    assert collected(q.spine_completeness(df, ["month", "platform"])) == [(4, 3, 4)]
    assert collected(q.spine_gaps(df, "month", "platform")) == [("m2", "p2")]
    # a NULL equals nothing: every pair with it is a gap, as with NOT EXISTS
    df = frame([("m1", "p1"), ("m2", None)], "month string, platform string")
    assert collected(q.spine_gaps(df, "month", "platform")) == [("m1", None), ("m2", "p1"), ("m2", None)]


def test_spellings_lose_white_space_of_any_kind(frame, collected):
    df = frame([("\tuk",), (" UK\u00a0",), ("uk\n",), ("u k",), (None,)], "c string")
    table = frame([("uk", "United Kingdom")], "spelling string, canonical string")
    want = [("United Kingdom",)] * 3 + [("u k",), (None,)]
    for mapping in ({"uk": "United Kingdom"}, table):
        assert sorted(collected(cl.canonicalize(df, "c", mapping, strip=True)), key=repr) == sorted(want, key=repr)


def test_component_reconcile_ignores_null_comparisons(frame, collected):
    df = frame([(3, 1, 2), (9, 1, 2), (None, 1, 1), (4, None, 1)], "t int, a int, b int")
    assert collected(q.component_reconcile(df, {"t": ("t", ["a", "b"])})) == [(4, 1, 1)]
