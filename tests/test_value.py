import datetime as dt
import itertools
import math
import random
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.plans import rfm as rf
from tidemark.plans import stats as st
from tidemark.runtime import scratch_path
from tidemark.sources import dims
from tidemark.sources.tables import append_load, export, read_table, rejected_values
from tidemark.streaming.loads import append_available, monthly_counts, read_stream


def brute_u(a, b):
    return sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def run_test(frame, a, b):
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("other", 0.0)]
    random.Random(3).shuffle(rows)
    return st.rank_sum_test(frame(rows, "g string, v double"), "v", "g", "a", "b").collect()[0]


def test_rank_sum_exact_for_small_samples(frame):
    males, females = [19, 22, 16, 29, 24], [20, 11, 17, 12]
    r = run_test(frame, males, females)
    assert r.u_statistic == 17
    assert r.p_value == pytest.approx(1 / 9)


def test_rank_sum_exact_matches_enumeration():
    pooled = [1, 2, 3, 4, 5, 6, 7]
    us = [brute_u(c, [x for x in pooled if x not in c]) for c in itertools.combinations(pooled, 3)]
    for u in sorted(set(us)):
        assert st.exact_tail(u, 3, 4) == pytest.approx(sum(x >= u for x in us) / len(us))


def test_exact_tail_far_out_and_for_any_size():
    # the ten most extreme arrangements and below: partitions of 0 to 10 into at most 8 parts
    assert st.exact_tail(7990, 8, 1000) == pytest.approx(136 / math.comb(1008, 8), rel=1e-12)
    assert st.exact_tail(0, 8, 1_300_000) == 1.0
    middle = st.exact_tail(8 * 1_300_000 // 2, 8, 1_300_000)
    assert 0.5 < middle < 0.5001
    # for one value against many U is uniform
    assert st.exact_tail(999_999_990, 1, 10**9) == pytest.approx(11 / (10**9 + 1), rel=1e-12)
    # the exact distribution also with a large second sample
    assert st.two_sided_p(2.0, 8 * 1_300_000 * 0.7, 8, 1_300_000, 0.0) == pytest.approx(
        2 * st.exact_tail(8 * 1_300_000 * 0.7, 8, 1_300_000))


def test_rank_sum_normal_with_ties(frame):
    rng = random.Random(11)
    a = [rng.randrange(30) for _ in range(60)]
    b = [rng.randrange(5, 40) for _ in range(75)]
    r = run_test(frame, a, b)
    u = brute_u(a, b)
    n1, n2, n = len(a), len(b), len(a) + len(b)
    ties = sum(t**3 - t for t in np.unique(a + b, return_counts=True)[1].tolist())
    sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))))
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
    assert r.u_statistic == u and r.tie_term == ties
    assert r.z == pytest.approx(z)
    assert r.p_value == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_rank_sum_is_symmetric_and_handles_empty(frame):
    a, b = [1, 5, 9, 12, 13, 14, 15, 16, 18], [2, 3, 4, 6, 7, 8, 10, 11, 17, 19]
    one, two = run_test(frame, a, b), run_test(frame, b, a)
    assert one.u_statistic + two.u_statistic == len(a) * len(b)
    assert one.p_value == pytest.approx(two.p_value)
    assert run_test(frame, a, []).p_value is None


def test_rank_sum_all_equal(frame):
    assert run_test(frame, [1] * 10, [1] * 12).p_value is None


@pytest.fixture(scope="module")
def blobs(spark):
    rng = random.Random(5)
    centres = [(5, 40, 9000), (30, 12, 2000), (200, 4, 400), (600, 1, 50)]
    rows = []
    for c, (r, f, m) in enumerate(centres):
        rows += [(len(rows) + i, r + rng.randrange(3), f + rng.randrange(2), D(m + rng.randrange(20)), "web", c)
                 for i in range(40)]
    return spark.createDataFrame(
        rows, "customer_id int, recency int, frequency int, monetary decimal(18,2), channel string, truth int")


def test_scaling_uses_the_population_deviation(blobs):
    z = np.array([r.z_recency for r in rf.log_scale(blobs).collect()])
    x = np.log1p([r.recency for r in blobs.collect()])
    assert np.allclose(np.sort(z), np.sort((x - x.mean()) / x.std()))


def test_segments_recover_separate_groups(blobs):
    clustered = rf.segment(blobs, k=4, n_init=3)
    pairs = {(r.truth, r.cluster) for r in clustered.collect()}
    assert len(pairs) == 4
    profile = rf.segment_profile(clustered)
    named = {r.segment: r for r in rf.label_segments(profile).collect()}
    assert named["Champions"].avg_monetary > named["Hibernating / Lost"].avg_monetary
    assert set(named) == set(rf.SEGMENT_NAMES)
    share = rf.segment_share(rf.label_segments(profile)).collect()
    assert sum(r.pct_of_customers for r in share) == 100.0


def test_more_clusters_lower_the_inertia(blobs):
    scaled = rf.log_scale(blobs)
    inertia = rf.inertia_by_k(scaled, ks=[2, 3, 4], n_init=3)
    assert inertia[2] > inertia[3] > inertia[4]


def test_generic_names_for_other_cluster_counts(blobs):
    profile = rf.segment_profile(blobs.withColumn("cluster", F.col("truth") % 2))
    names = {r.segment for r in rf.label_segments(profile).collect()}
    assert names == {"Segment 1 (rank 1 of 2)", "Segment 2 (rank 2 of 2)"}


def test_rfm(frame):
    rows = [
        (1, dt.date(2024, 1, 1), 10, 1, 7, "web", D(5)), (1, dt.date(2024, 1, 1), 10, 2, 7, "web", D(6)),
        (1, dt.date(2024, 1, 9), 11, 1, 7, "app", D(1)), (2, dt.date(2024, 1, 10), 12, 1, 7, "app", D(2)),
        (None, dt.date(2024, 5, 1), 13, 1, 7, "web", D(99)),
    ]
    sales = frame(rows, "customer_id int, invoice_date date, invoice_no int, line_no int, product_id int, "
                        "channel string, line_total decimal(18,2)")
    got = {r.customer_id: (r.recency, r.frequency, r.monetary, r.channel) for r in rf.rfm(sales).collect()}
    assert got == {1: (2, 2, D(12), "web"), 2: (1, 1, D(2), "app")}


def test_csv_round_trip_and_header_check(spark, frame):
    df = frame([("00501", D("1.50")), (None, None)], "zip string, x decimal(18,2)")
    path = export(df, ["zip", "x"], scratch_path(spark, "t"))
    back = read_table(spark, path, "zip string, x decimal(18,2)")
    assert sorted(map(tuple, back.collect()), key=repr) == [("00501", D("1.50")), (None, None)]
    with pytest.raises(Exception):
        read_table(spark, path, "other string, x decimal(18,2)").collect()


def test_append_load_counts(spark, frame):
    path = scratch_path(spark, "t")
    df = frame([(1,), (2,)], "k int")
    assert (append_load(df, path), append_load(df, path)) == (2, 2)
    assert spark.read.parquet(path).count() == 4


def test_rejected_values(frame):
    df = frame([("1", "x"), (None, "2")], "a string, b string")
    got = {r.column_name: r.rejected for r in rejected_values(df, {"a": "int", "b": "int"}).collect()}
    assert got == {"a": 0, "b": 1}


def test_calendar(spark):
    days = dims.calendar(spark, "2024-02-28", "2024-03-01").collect()
    assert [(str(r.date), r.month_key, r.year, r.month_name) for r in days] == [
        ("2024-02-28", "2024-02", 2024, "Feb"), ("2024-02-29", "2024-02", 2024, "Feb"),
        ("2024-03-01", "2024-03", 2024, "Mar")]


def test_incremental_load_takes_each_file_once(spark, frame):
    folder = export(frame([(1, "a"), (2, "b")], "k int, v string"), ["k", "v"], scratch_path(spark, "in"))
    target, memory = scratch_path(spark, "out"), scratch_path(spark, "mem")
    added = [append_available(read_stream(spark, folder, "k int, v string"), target, memory) for _ in range(2)]
    assert added == [2, 0]
    assert spark.read.parquet(target).count() == 2


def test_stream_counts_each_key_once(spark, frame):
    rows = [(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 2)), (2, dt.datetime(2024, 2, 1))]
    path = scratch_path(spark, "in")
    frame(rows, "id int, at timestamp").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("id int, at timestamp").parquet(path)
    query = (monthly_counts(stream, "at", "id").writeStream.format("memory").queryName("counts")
             .outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    got = {r.month: r.crashes for r in spark.table("counts").collect()}
    assert got == {"2024-01": 1, "2024-02": 1}


def test_runs_together_equal_runs_alone(blobs):
    from tidemark.plans.lloyd import fit_all

    scaled, cols = rf.log_scale(blobs), [f"z_{c}" for c in rf.FEATURES]
    together = fit_all(scaled, [2, 3, 4], cols, n_init=2)
    points = np.array([[r[c] for c in cols] for r in scaled.select(*cols).collect()])
    for fit in together:
        far = ((points[:, None] - fit.centres[None]) ** 2).sum(axis=2)
        assert abs(far.min(axis=1).sum() - fit.inertia) <= 1e-6 * max(fit.inertia, 1)
        label = far.argmin(axis=1)  # a further step hardly moves the centres
        moved = np.array([points[label == j].mean(axis=0) if (label == j).any() else c for j, c in enumerate(fit.centres)])
        assert ((moved - fit.centres) ** 2).sum() <= 1e-4
    alone = fit_all(scaled.repartition(7), [2], cols, n_init=2)
    for a, b in zip(alone, together[:2], strict=True):
        assert np.allclose(a.centres, b.centres) and abs(a.inertia - b.inertia) <= 1e-6 * b.inertia


def test_fits_of_few_and_no_points(spark):
    from tidemark.plans.lloyd import fit_all

    few = spark.createDataFrame([(0.0, 1.0), (0.0, 1.0), (2.0, 5.0)], "x double, y double")
    (fit,) = fit_all(few, [3], ["x", "y"], n_init=1)
    assert sorted(map(tuple, fit.centres)) == [(0.0, 1.0), (2.0, 5.0)] and fit.inertia == 0
    (fit,) = fit_all(few.limit(0), [2], ["x", "y"], n_init=1)
    assert len(fit.centres) == 0 and fit.inertia == 0
