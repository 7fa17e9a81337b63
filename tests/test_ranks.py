import random

import numpy as np
import pytest

from tidemark.operators import ranks


def brute_before(values):
    ordered = sorted(values)
    return {v: (ordered.count(v), ordered.index(v)) for v in set(values)}


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value of one group."""
    rng = random.Random(7)
    rows = [("hot", 50)] * 400
    rows += [("hot", rng.randrange(1000)) for _ in range(500)]
    rows += [(rng.choice("abc"), rng.randrange(300)) for _ in range(300)]
    rows += [("a", None), (None, 3)]
    return rows, spark.createDataFrame(rows, "g string, v int")


@pytest.mark.parametrize("buckets", [1, 7, 64, 512, None])
def test_value_ranks_match_a_sort(skewed, buckets):
    rows, df = skewed
    got = {(r.g, r.v): (r.n, r.before, r.total) for r in ranks.value_ranks(df, "v", ["g"], buckets=buckets).collect()}
    want = {}
    for g in {"hot", "a", "b", "c"}:
        values = [v for k, v in rows if k == g and v is not None]
        for v, (n, before) in brute_before(values).items():
            want[(g, v)] = (n, before, len(values))
    assert got == want


def test_value_ranks_without_groups(skewed):
    rows, df = skewed
    values = [v for _, v in rows if v is not None]
    got = {r.v: (r.n, r.before) for r in ranks.value_ranks(df, "v", buckets=16).collect()}
    assert got == brute_before(values)


@pytest.mark.parametrize("buckets", [3, 512, None])
def test_quantiles_interpolate_like_numpy(skewed, buckets):
    rows, df = skewed
    qs = {"q1": 0.25, "q2": 0.5, "q995": 0.995, "top": 1.0, "low": 0.0}
    for r in ranks.exact_quantiles(df, "v", ["g"], qs, buckets).collect():
        values = [v for k, v in rows if k == r.g and v is not None]
        assert r.n == len(values)
        for name, q in qs.items():
            assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_percentile_offset_is_the_floor_position(frame):
    df = frame([(v,) for v in [10, 20, 30, 40, 50]], "v int")
    # floor(0.6 * 5) = 3: the fourth value, where a discrete percentile takes the third
    assert ranks.percentile_offset(df, "v", 0.6).collect()[0][0] == 40
    assert ranks.percentile_offset(df, "v", 0.6, buckets=2).collect()[0][0] == 40
    assert ranks.percentile_offset(df, "v", 1.0).collect()[0][0] is None
    assert ranks.percentile_offset(df.limit(0), "v", 0.6).collect()[0][0] is None


def test_nan_is_missing(frame):
    df = frame([(1.0,), (float("nan"),), (3.0,), (None,)], "v double")
    assert ranks.exact_quantiles(df, "v", [], {"m": 0.5}).collect()[0].m == 2.0


def test_buckets_are_even(spark):
    """No bucket holds much more than its share of the distinct values."""
    hist = ranks.value_histogram(spark.range(20_000).selectExpr("cast(id * id as double) as v"), "v")
    placed = ranks.bucketed(hist, "v", [], 100)
    sizes = [r["count"] for r in placed.groupBy("_bucket").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 20_000 / 100 * 12


@pytest.mark.parametrize("kind", ["date", "string", "decimal(12,3)", "double", "bigint"])
@pytest.mark.parametrize("buckets", [1, 40])
def test_values_rank_in_their_own_type(spark, kind, buckets):
    text = {"date": "cast(date_add('2000-01-01', cast(id * 37 % 400 as int)) as string)"}.get(
        kind, "cast(id * 37 % 400 - 100 as string)")
    df = spark.range(900).selectExpr(f"cast({text} as {kind}) as v")
    values = sorted(r.v for r in df.collect())
    got = {r.v: (r.n, r.before) for r in ranks.value_ranks(df, "v", buckets=buckets).collect()}
    assert got == brute_before(values)
    assert ranks.percentile_offset(df, "v", 0.6, buckets=buckets).first()[0] == values[540]


def test_no_rows(spark):
    df = spark.createDataFrame([], "v string")
    assert ranks.value_ranks(df, "v").count() == 0
