import datetime as dt

from pyspark.sql import functions as F

from tidemark import functions as fn


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_round_goes_half_away_from_zero(frame):
    df = frame([(0.285,), (-0.285,), (2.5,), (None,)], "x double")
    assert one(df, fn.round_to("x", 2)) == [0.29, -0.29, 2.5, None]


def test_safe_division_gives_null_on_zero(frame):
    df = frame([(1, 0), (7, 2), (None, 2)], "a int, b int")
    assert one(df, fn.safe_div("a", "b")) == [None, 3.5, None]
    assert one(df, fn.pct("a", "b")) == [None, 350.0, None]


def test_flag_and_clamp_on_null(frame):
    df = frame([("Yes", -3.0), ("No", 4.0), (None, None)], "f string, x double")
    assert one(df, fn.flag("f")) == [1, 0, 0]
    assert one(df, fn.clamp("x", lo=0.0)) == [0.0, 4.0, None]
    assert one(df, fn.clamp("x", hi=2.0)) == [-3.0, 2.0, None]


def test_band_sends_null_to_the_last_label(frame):
    df = frame([(0,), (19,), (20,), (100,), (None,)], "u int")
    labels = ["low", "mid", "top"]
    assert one(df, fn.band("u", [20, 40], labels)) == ["low", "low", "mid", "top", "top"]
    assert one(df, fn.band("u", [20, 40], labels, inclusive=True)) == ["low", "low", "low", "top", "top"]
    assert one(df, fn.band("u", [20, 40], labels, null_label="?"))[-1] == "?"


def test_ordinal(frame):
    df = frame([("500+",), ("1-10",), ("other",), (None,)], "s string")
    assert one(df, fn.ordinal("s", ["1-10", "11-50", "500+"])) == [3, 1, None, None]


def test_dates_that_cannot_be_read_are_null(frame):
    df = frame([("2024-02-29", "02/29/2024", "09:15"), ("soon", "13/45/2024", "xx")], "a string, b string, c string")
    assert one(frame([("2:39",), ("23:59",), ("0",), (":5",), (None,)], "c string"), fn.hour_of_time("c")) == [
        2, 23, 0, None, None]
    assert one(df, fn.iso_date("a")) == [dt.date(2024, 2, 29), None]
    assert one(df, fn.us_date("b")) == [dt.date(2024, 2, 29), None]
    assert one(df, fn.hour_of_time("c")) == [9, None]


def test_month_arithmetic(frame):
    df = frame([("2024-01",)], "m string")
    assert one(df, fn.add_months_to_key("m", -2)) == ["2023-11"]
    assert one(df, fn.year_of_key("m")) == ["2024"]
    span = frame([(dt.date(2024, 1, 31), dt.date(2025, 3, 1))], "a date, b date")
    assert one(span, fn.months_between_index("b", "a")) == [14]


def test_months_open_is_censored_at_the_snapshot(frame):
    df = frame([(dt.date(2025, 1, 1), None), (dt.date(2025, 1, 1), dt.date(2025, 2, 1))], "s date, e date")
    assert one(df, fn.months_open("s", "e", "2025-12-31")) == [12.0, 1.0]


def test_canonical_text_keeps_unknown_spelling_untouched(frame):
    df = frame([(" UK ",), ("uk",), (" Narnia ",), (None,)], "c string")
    mapping = {"uk": "United Kingdom"}
    assert one(df, fn.canonical_text("c", mapping, strip=True)) == ["United Kingdom", "United Kingdom", " Narnia ", None]
    assert one(df, fn.canonical_text("c", mapping)) == [" UK ", "United Kingdom", " Narnia ", None]


def test_trim_clean(frame):
    df = frame([("  a\tb\n ",)], "c string")
    assert one(df, fn.trim_clean("c")) == ["ab"]


def test_sentinel_needs_all_columns(frame):
    df = frame([(0.0, 0.0), (0.0, 5.0), (None, 0.0)], "lat double, lon double")
    island = {"lat": 0.0, "lon": 0.0}
    assert one(df, fn.null_if_sentinel("lon", island)) == [None, 5.0, 0.0]


def test_percent_keeps_digits(frame):
    df = frame([(1, 3)], "a int, b int")
    assert one(df, fn.pct("a", "b", 9)) == [33.333333333]
    assert one(df, fn.per_mille("a", "b")) == [333.33]
    assert one(df, F.lit(1)) == [1]
