"""Domain reports on small frames, with values worked out by hand."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregate as ag
from tidemark.operators import window as wn
from tidemark.plans import churn as ch
from tidemark.plans import cohort as co
from tidemark.plans import incidents as ic
from tidemark.plans import marketing as mk
from tidemark.plans import segments as sg


@pytest.fixture
def monthly(frame):
    rows = [
        ("2022-01", 0, 5, 0, 0.0, D(0), D("164.92")),
        ("2022-02", 5, 10, 1, 20.0, D("7333.07"), D("189.21")),
        ("2022-03", 14, 12, 0, 0.0, D("12301.16"), D("150.00")),
    ]
    return frame(rows, "month string, total_active_customers int, new_customers int, churned_customers int, "
                       "monthly_churn_rate_pct double, total_mrr decimal(18,2), customer_acquisition_cost decimal(18,2)")


@pytest.fixture
def subs(frame):
    def sub(i, plan, revenue, signup, gone=None, reason=None, usage=50, nps=8):
        return (i, plan, D(revenue), signup, "Yes" if gone else "No", gone, reason, usage, nps, 1)

    rows = [
        sub(1, "Starter", "7333.07", dt.date(2022, 1, 3)),
        sub(2, "Starter", "5001.44", dt.date(2022, 2, 3), dt.date(2022, 3, 1), "price", 10, 3),
        sub(3, "Business", "11923.75", dt.date(2022, 3, 9), usage=20, nps=6),
        sub(4, "Business", "100.00", dt.date(2022, 3, 9), dt.date(2022, 3, 20), "fit", 30, None),
        sub(5, "Business", "100.00", dt.date(2022, 3, 9), dt.date(2022, 3, 25), "price", None, 5),
    ]
    raw = frame(rows, "customer_id int, plan string, monthly_revenue decimal(18,2), signup_date date, churned string, "
                      "churn_date date, churn_reason string, feature_usage_pct int, nps_score int, "
                      "support_tickets_12mo int")
    return ch.subscription_view(raw, "2025-12-31")


def test_trailing_mean_averages_short_frames(monthly):
    got = [r.trailing_avg_churn_pct for r in ch.monthly_churn_series(monthly).orderBy("month").collect()]
    assert got == [0.0, 10.0, 6.67]


def test_swings_skip_the_first_month(monthly):
    got = [(r.month, r.pct_point_change) for r in ch.largest_swings(monthly, 5).collect()]
    assert got == [("2022-02", 20.0), ("2022-03", -20.0)]


def test_nrr_of_zero_base_is_null(monthly, subs):
    only_new = subs.where("customer_id <= 3")
    got = {r.month: r for r in ch.nrr(monthly, only_new).collect()}
    assert "2022-01" not in got
    assert got["2022-02"].nrr_pct is None
    assert got["2022-03"].nrr_pct == pytest.approx(5.15)
    opening = {r.month: r.nrr_pct for r in ch.nrr(monthly, only_new, opening_balance=True).collect()}
    assert opening["2022-03"] == pytest.approx(round(100 * (12301.16 - 5001.44) / 7333.07, 2))


def test_blended_cac_is_weighted(monthly):
    want = round((5 * 164.92 + 10 * 189.21 + 12 * 150) / 27, 2)
    assert ch.blended_cac(monthly).collect()[0][0] == want


def test_net_new_mrr_fills_missing_months_with_zero(monthly, subs):
    got = {r.month: (float(r.new_mrr), float(r.churned_mrr), r.net_new_mrr)
           for r in ch.net_new_mrr(monthly, subs).collect()}
    assert got["2022-01"] == (7333.07, 0.0, 7333.07)
    assert got["2022-03"] == (12123.75, 5201.44, 6922.31)


def test_clv_is_a_product_of_means(subs):
    got = {r.plan: r for r in ch.clv_by(subs, churned_only=True).collect()}
    assert got["Business"].avg_clv == round(100 * ((0.4 + 0.5) / 2), 2)
    assert got["Starter"].avg_lifespan_months == 0.9


def test_bands_and_risk_on_nulls(subs):
    bands = {r.usage_band: r.customers for r in sg.rate_by_band(subs, ch.usage_band(), "usage_band").collect()}
    assert bands["80-100%"] == 1  # the NULL usage
    risk = ch.at_risk_summary(subs).collect()[0]
    assert (risk.active_customers, risk.at_risk_customers, risk.at_risk_mrr) == (2, 1, 11923.75)
    assert [r.customer_id for r in ch.at_risk_list(subs).collect()] == [3]


def test_top_reason_keeps_ties(subs):
    gone = subs.where("is_churned = 1")
    got = sorted((r.plan, r.churn_reason) for r in sg.top_reason_per(gone, "plan", "churn_reason").collect())
    assert got == [("Business", "fit"), ("Business", "price"), ("Starter", "price")]


def test_reason_share_sums_to_hundred(subs):
    got = sg.reason_share(subs.where("is_churned = 1"), "churn_reason").collect()
    assert sum(r.pct_of_all for r in got) == pytest.approx(100, abs=0.02)


def test_all_cuts_agree_with_single_cuts(subs):
    cuts = sg.segment_rate_cuts(subs, [["plan"], ["churned"]]).where("cut = 'plan'")
    one = sg.segment_rate(subs, ["plan"])
    pick = ["plan", "customers", "churned", "churn_rate_pct"]
    assert sorted(map(tuple, one.select(pick).collect())) == sorted(
        (r["plan"], r.customers, r[-2], r.churn_rate_pct) for r in cuts.collect())


def test_measures_respect_slices(subs):
    total = ch.SUBSCRIPTION_MEASURES.evaluate(subs, ["active_customers", "churned_customers"]).collect()[0]
    assert tuple(total) == (2, 3)
    by = ch.SUBSCRIPTION_MEASURES.evaluate(subs, ["active_customers"], by=["plan"]).collect()
    assert sum(r.active_customers for r in by) == 2


def test_anomaly_uses_displayed_percentages(frame):
    rows = [(f"2024-{m:02d}", D(v)) for m, v in enumerate([100, 101, 102, 103, 104, 200], start=1)]
    got = ch.mom_anomaly(frame(rows, "month string, total_mrr decimal(18,2)")).orderBy("month").collect()
    assert [r.flag for r in got] == ["", "", "", "", "FLAGGED"]
    assert got[0].mom_pct_change == 1.0


def test_lag_and_calendar_shift_differ_on_a_gap(frame):
    series = frame([(2018, 10), (2020, 20), (2021, 30)], "y int, n int")
    lagged = {r.y: r.previous for r in wn.with_change(series, "y", "n").collect()}
    shifted = {r.y: r.before for r in wn.period_shift(series, "y", "n", "before").collect()}
    assert lagged == {2018: None, 2020: 10, 2021: 20}
    assert shifted == {2018: None, 2020: None, 2021: 20}


def test_calendar_mean_weighs_months_by_days(frame):
    series = frame([("2024-01", 10.0), ("2024-02", 40.0)], "month string, r double")
    got = {r.month: r.m for r in wn.trailing_month_mean(series, "month", "r", 3, "m").collect()}
    assert got == {"2024-01": 10.0, "2024-02": round((10 * 31 + 40 * 29) / 60, 2)}


def test_resample_fills_empty_months(frame):
    df = frame([(dt.date(2024, 1, 31), 2), (dt.date(2024, 3, 1), 5)], "d date, v int")
    got = [r.value for r in ag.resample_month(df, "d", "v").orderBy("month").collect()]
    assert got == [2, 0, 5]


def test_histogram_last_bin_is_closed(frame):
    df = frame([(float(v),) for v in [0, 1, 2, 3, 4]], "x double")
    got = {r.bin: r.n for r in ag.histogram(df, "x", 2).collect()}
    assert got == {0: 2, 1: 3}
    assert [r.n for r in ag.histogram(frame([(5.0,), (5.0,)], "x double"), "x", 4).collect()] == [2]


def test_box_summary(frame):
    df = frame([("g", float(v)) for v in [1, 2, 3, 4, 100]], "g string, v double")
    r = ag.box_summary(df, "v", "g").collect()[0]
    assert (r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high, r.outliers) == (2, 3, 4, 1, 4, 1)


SPEND = [("2025-08", "A", D(10), 100, 5, D(50)), ("2025-09", "A", D(10), 100, 5, D(20)),
         ("2025-12", "A", D(20), 100, 0, D(20)), ("2025-01", "B", D(40), 10, 4, D(400))]


@pytest.fixture
def spend(frame):
    return frame(SPEND, "month string, platform string, spend decimal(18,2), clicks bigint, conversions bigint, "
                        "attributed_revenue decimal(18,2)")


def test_recent_leaves_out_platforms_without_recent_rows(spend):
    got = mk.recent_vs_full(spend, 3).collect()
    assert [(r.platform, r.full_period_roas, r.last_3mo_roas, r.roas_change) for r in got] == [("A", 2.25, 1.0, -1.25)]


def test_scenarios(spend, frame):
    margin = frame([(0.25,)], "margin double")
    weak = mk.cut_scenario(spend, margin, "half", (F.col("platform") == "A") & mk.weak(3.0), 0.5).collect()[0]
    assert (weak.months_flagged, weak.earliest_flagged_month, weak.latest_flagged_month) == (2, "2025-09", "2025-12")
    assert (weak.spend_saved, weak.net_profit_impact_of_cutting) == (15.0, 15 - 20 * 0.25)
    both = mk.combined_scenarios(spend, margin, [(F.col("platform") == "B", 1.0),
                                                 ((F.col("platform") == "A") & mk.weak(3.0), 0.5)]).collect()[0]
    assert tuple(both) == (55.0, 16.0, 55 - 420 * 0.25)
    roi = {r.platform: r.verdict for r in mk.profit_adjusted_roi(spend, margin).collect()}
    assert roi == {"A": "Losing money after ad spend", "B": "Profitable"}


CRASH = ("`CRASH DATE` string, `CRASH TIME` string, `BOROUGH` string, `LATITUDE` double, `LONGITUDE` double, "
         "`ON STREET NAME` string, `CROSS STREET NAME` string, `NUMBER OF PERSONS INJURED` int, "
         "`NUMBER OF PERSONS KILLED` int, `NUMBER OF PEDESTRIANS INJURED` int, `NUMBER OF PEDESTRIANS KILLED` int, "
         "`NUMBER OF CYCLIST INJURED` int, `NUMBER OF CYCLIST KILLED` int, `NUMBER OF MOTORIST INJURED` int, "
         "`NUMBER OF MOTORIST KILLED` int, `CONTRIBUTING FACTOR VEHICLE 1` string, `VEHICLE TYPE CODE 1` string, "
         "`VEHICLE TYPE CODE 2` string, `COLLISION_ID` bigint, seen int")


@pytest.fixture
def crashes(frame):
    def crash(i, borough, factor, vehicle, seen=1, lat=40.0, ped=(0, 0), cyc=(0, 0), mot=(1, 0), street="A", cross="B",
              date="03/05/2020"):
        return (date, "07:30", borough, lat, lat and -74.0, street, cross, ped[0] + cyc[0] + mot[0],
                ped[1] + cyc[1] + mot[1], *ped, *cyc, *mot, factor, vehicle, None, i, seen)

    raw = frame([
        crash(1, "Q", "Unsafe Speed", "4 dr SEDAN"), crash(1, "Q", "Unspecified", "SUV", seen=2),
        crash(2, "Q", "Unspecified", "bike", lat=0.0, ped=(0, 1), mot=(0, 0)),
        crash(3, None, "Unsafe Speed", "Tractor", ped=(3, 0)), crash(4, "B", "Alcohol", None, street="B", cross="A"),
        crash(5, "B", "Alcohol", "SUV", street="A", cross="A", date="01/02/2021"),
        crash(6, "B", "Unsafe Speed", "suv", street=None, date="01/02/2021"),
    ], CRASH)
    return ic.incident_view(raw, ["seen"])


def test_incident_view(crashes):
    got = {r.collision_id: r for r in crashes.collect()}
    assert len(got) == 6 and got[1].contributing_factor_1 == "Unsafe Speed"
    assert got[1].vehicle_type_1_clean == "Sedan" and got[3].vehicle_type_1_clean == "Tractor"
    assert got[2].vehicle_type_1_clean == "Bike" and got[4].vehicle_type_1_clean is None
    assert got[2].latitude is None and got[2].longitude is None and got[1].latitude == 40.0
    assert got[1].crash_date == dt.date(2020, 3, 5) and got[1].crash_hour == 7


def test_unassigned_places_stay_a_group(crashes):
    got = {r.borough: r.crashes for r in ic.geo_breakdown(crashes).collect()}
    assert got == {"Q": 2, "B": 3, "UNKNOWN/UNASSIGNED": 1}


def test_intersections_are_ordered_pairs(crashes):
    ordered = {(r.on_street, r.cross_street): r.crashes for r in ic.top_intersections(crashes).collect()}
    assert ordered == {("A", "B"): 3, ("B", "A"): 1}
    assert ic.top_intersections(crashes, unordered=True).collect()[0].crashes == 4


def test_factor_matrix_share_is_within_the_leading_factors(crashes):
    got = {(r.borough, r.contributing_factor_1): r.pct_within_borough_top_factors
           for r in ic.factor_matrix(crashes, 1).collect()}
    assert set(got.values()) == {100.0} and ("B", "Alcohol") not in got


def test_road_users(crashes):
    share = {r.road_user: r for r in ic.road_user_share(crashes).collect()}
    assert share["Pedestrian"].pct_of_all_killed == 100.0
    assert sum(r.pct_of_all_injured for r in share.values()) == pytest.approx(100, abs=0.2)
    risk = {r.road_user: r.pct_fatal_when_involved for r in ic.fatality_when_involved(crashes).collect()}
    assert risk == {"Pedestrian": 25.0, "Cyclist": None, "Motorist": 0.0}


def test_known_factor_share_uses_known_rows_only(crashes):
    top = ic.factor_share(crashes, known_only=True, k=1).collect()[0]
    assert (top.contributing_factor_1, top.crashes, top.pct_of_known_cause_crashes) == ("Unsafe Speed", 3, 60.0)


@pytest.fixture
def sales(frame):
    rows = [
        (1, dt.date(2024, 1, 10), 100, "web"), (1, dt.date(2024, 3, 2), 101, "web"),
        (2, dt.date(2024, 1, 20), 102, "app"), (3, dt.date(2024, 2, 1), 103, "web"),
        (3, dt.date(2024, 2, 9), 104, "app"), (None, dt.date(2024, 1, 1), 105, "web"),
    ]
    return frame(rows, "customer_id int, invoice_date date, invoice_no int, channel string")


def test_cohorts(sales):
    cells = {(r.cohort, r.cohort_index): (r.buyers, r.retention_pct) for r in co.cohort_retention(sales).collect()}
    assert cells == {("2024-01", 0): (2, 100.0), ("2024-01", 2): (1, 50.0), ("2024-02", 0): (1, 100.0)}
    curve = {r.cohort_index: r.avg_retention_pct for r in co.avg_retention_curve(co.cohort_retention(sales)).collect()}
    assert curve == {0: 100.0, 2: 50.0}  # cohorts without the cell are not zeros
    wide = {r.cohort: r.asDict() for r in co.retention_matrix(co.cohort_retention(sales), 3).collect()}
    assert wide["2024-01"]["m2"] == 50.0 and wide["2024-01"]["m1"] is None


def test_channel_retention_divides_by_all_customers(sales):
    got = {(r.channel, r.cohort_index): r.retention_pct for r in co.channel_retention(sales).collect()}
    assert got == {("web", 0): 100.0, ("web", 2): 50.0, ("app", 0): 100.0}
