"""As-of and interval joins, ranks of big groups and comparison of loads against plain loops."""

import datetime as dt
import random
from collections import Counter

import pytest

from tidemark.operators.compare import compare_loads, multiset_difference
from tidemark.operators.intervals import asof_join, interval_join
from tidemark.operators.positions import tiles, value_places


@pytest.fixture(scope="module")
def sides(spark):
    """Half of the rows have one key, many of them one time; NULLs in keys and times; repeats."""
    rng = random.Random(3)
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    at = lambda: rng.choice([50, rng.randrange(200), None])
    left = [(i, key(), at()) for i in range(600)]
    right = [(key(), at(), rng.choice([None, *range(9)])) for _ in range(150)]
    right += right[:20] + [("far", 5, 1)]
    return (left, right, spark.createDataFrame(left, "id int, k string, at int"),
            spark.createDataFrame(right, "k string, since int, v int"))


@pytest.mark.parametrize("buckets", [1, 5, 64])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_takes_the_nearest_row_of_the_key(sides, direction, buckets):
    left, right, l, r = sides
    got = asof_join(l, r, "at", "since", ["k"], ["v"], direction=direction, matched_at="found", buckets=buckets)
    want = []
    for i, k, at in left:
        ahead = direction == "forward"
        ok = [(s, v) for g, s, v in right if None not in (k, at, g, s) and g == k and (s >= at if ahead else s <= at)]
        near = (min if ahead else max)((s for s, _ in ok), default=None)
        values = [v for s, v in ok if s == near]
        want.append((i, max(values, key=lambda v: -1 if v is None else v, default=None), near))
    assert sorted(tuple(x) for x in got.select("id", "v", "found").collect()) == sorted(want)


def test_asof_ties_go_by_the_named_column(frame):
    left = frame([("x", 5)], "k string, at int")
    right = frame([("x", 5, 1, "late"), ("x", 5, 0, "zz"), ("x", 5, 1, "ear")], "k string, at2 int, t int, v string")
    assert asof_join(left, right, "at", "at2", ["k"], ["v"], ties=["t"]).first().v == "late"


def test_asof_with_an_empty_side(sides):
    _, _, l, r = sides
    assert asof_join(l, r.where("false"), "at", "since", ["k"], ["v"]).where("v is null").count() == 600
    assert asof_join(l.where("false"), r, "at", "since", ["k"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(l, r, "at", "since", ["k"], ["v"], direction="sideways")


@pytest.mark.parametrize("by,salts", [(["k"], 1), (["k"], 4), ([], 3)])
def test_intervals_find_all_points_within(spark, sides, by, salts):
    """Lengths from -3 to 4000, bounds below zero, in one table."""
    rng = random.Random(4)
    left, _, l, _ = sides
    spans = []
    for i in range(200):
        start = rng.choice([rng.randrange(-200, 200), None if i % 20 == 0 else 50])
        length = rng.choice([-3, 0, 1, 2, 3, 4, 5, 8, 17, 64, 4000])
        spans.append((i, rng.choice(["hot", "hot", "a", None]), start, None if start is None else start + length))
    names = "span int, k string, since int, until int"
    iv = spark.createDataFrame(spans, names)
    got = interval_join(l, iv if by else iv.drop("k"), "at", "since", "until", by, salts)
    want = [(i, s) for i, k, at in left for s, g, a, b in spans
            if None not in (at, a, b) and a <= at < b and (not by or (k is not None and k == g))]
    assert Counter((x.id, x.span) for x in got.collect()) == Counter(want)


def test_intervals_of_dates_and_times(spark):
    for kind, day in (("date", dt.date), ("timestamp", dt.datetime), ("timestamp_ntz", dt.datetime)):
        points = spark.createDataFrame([(i, day(2024, 3, i)) for i in range(1, 31)], f"id int, at {kind}")
        spans = spark.createDataFrame([("x", day(2024, 3, 5), day(2024, 3, 9)), ("y", day(1960, 1, 1), day(2024, 3, 2))],
                                      f"name string, a {kind}, b {kind}")
        got = {(r.id, r.name) for r in interval_join(points, spans, "at", "a", "b").collect()}
        assert got == {(1, "y"), *((i, "x") for i in range(5, 9))}


def test_intervals_with_an_empty_side(spark, sides):
    _, _, l, _ = sides
    spans = spark.createDataFrame([(1, 2)], "a int, b int")
    assert interval_join(l, spans.where("false"), "at", "a", "b").count() == 0
    assert interval_join(l.where("false"), spans, "at", "a", "b").count() == 0


@pytest.mark.parametrize("buckets", [1, 16])
@pytest.mark.parametrize("count", [5, 7, 2000])
def test_tiles_match_a_sort(spark, count, buckets):
    """Two thirds of the rows share one value: the key deals them out."""
    rng = random.Random(5)
    rows = [(i, rng.choice([7, 7, rng.randrange(100)])) for i in range(500)] + [(500, None), (None, 7)]
    got = {r.id: r.t for r in tiles(spark.createDataFrame(rows, "id int, v int"), "v", "id", count, "t", buckets=buckets)
           .where("id is not null").collect()}
    ranked = sorted((v, i) for i, v in rows if None not in (v, i))
    size, larger = divmod(len(ranked), count)
    ends = [size + (k < larger) for k in range(count)]
    want = dict(zip((i for _, i in ranked), (k + 1 for k, n in enumerate(ends) for _ in range(n)), strict=True))
    assert got == {**want, 500: None}


def test_tiles_have_no_window_over_everything(spark):
    plan = tiles(spark.range(1000).selectExpr("id", "id % 7 v"), "v", "id", 4, "t")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("buckets", [1, 16])
def test_value_places_match_a_sort(spark, buckets):
    rng = random.Random(6)
    rows = [(i, rng.choice("aab"), rng.choice([3.0, float(rng.randrange(40))])) for i in range(300)]
    rows += [(300, "a", None), (301, "a", float("nan")), (302, None, 1.0), (303, "one", 1.0)]
    got = {r.id: tuple(r)[-4:] for r in value_places(spark.createDataFrame(rows, "id int, g string, v double"), "v", ["g"], buckets)
           .select("id", "rank", "dense_rank", "percent_rank", "cume_dist").collect()}
    for i, g, v in rows:
        if i in (300, 301, 302):
            assert got[i] == (None,) * 4
            continue
        group = [x for _, h, x in rows if h == g and x is not None and x == x]
        below = sum(x < v for x in group)
        assert got[i][:2] == (below + 1, len({x for x in group if x < v}) + 1)
        assert got[i][2:] == pytest.approx((below / max(1, len(group) - 1), sum(x <= v for x in group) / len(group)))


LOAD = "k string, a int, b string"


def test_multisets_differ_by_their_counts(frame):
    old = frame([("x", 1, None)] * 3 + [("y", 2, "p"), (None, None, None)], LOAD)
    new = frame([("x", 1, None)] * 2 + [("y", 2, "p"), (None, None, None), ("z", 1, "")], LOAD)
    got = {tuple(r) for r in multiset_difference(old, new.select("b", "a", "k")).collect()}
    assert got == {("x", 1, None, 3, 2), ("z", 1, "", 0, 1)}
    assert multiset_difference(old, old).count() == 0
    with pytest.raises(ValueError):
        multiset_difference(old, new.drop("b"))


def test_loads_are_compared_by_key(frame):
    old = frame([("same", 1, "p"), ("drop", 1, "p"), ("edit", 1, "p"), ("two", 1, "p"), ("null", 1, "p"), ("rep", 1, "p"),
                 ("swap", 1, "p"), ("swap", 2, "q"), ("part", 1, "p"), ("part", 2, "q"), (None, 1, "p")], LOAD)
    new = frame([("same", 1, "p"), ("edit", 9, "p"), ("two", 2, "q"), ("null", 1, None), ("rep", 1, "p"), ("rep", 1, "p"),
                 ("swap", 1, "q"), ("swap", 2, "p"), ("part", 1, "p"), ("part", 2, "r"), (None, 2, "p"), ("add", 1, "p")], LOAD)
    got = {r.k: tuple(r)[1:] for r in compare_loads(old, new, ["k"]).collect()}
    assert got == {
        "drop": ("dropped", 1, 0, None), "add": ("added", 0, 1, None), "edit": ("changed", 1, 1, "a"),
        "two": ("changed", 1, 1, "a,b"), "null": ("changed", 1, 1, "b"), "rep": ("repeated", 1, 2, None),
        "swap": ("changed", 2, 2, ""), "part": ("changed", 2, 2, "b"), None: ("changed", 1, 1, "a")}
    assert compare_loads(old, old, ["k"]).count() == 0


def test_loads_with_keys_only_or_empty(frame):
    old, new = frame([("x",), ("y",), ("y",)], "k string"), frame([("y",), ("z",)], "k string")
    got = {tuple(r) for r in compare_loads(old, new, ["k"]).collect()}
    assert got == {("x", "dropped", 1, 0, None), ("y", "repeated", 2, 1, None), ("z", "added", 0, 1, None)}
    assert {r.status for r in compare_loads(old.where("false"), new, ["k"]).collect()} == {"added"}
