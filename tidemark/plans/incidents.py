"""Incident (traffic-safety) analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hour_of_time, label_null, null_if_sentinel, pct, per_mille, round_to, safe_div, us_date
from tidemark.operators.aggregate import (
    Measures,
    conditional_measures,
    count_where,
    rows,
    share_of_total,
    share_within,
    sum_where,
)
from tidemark.operators.clean import canonicalize, dedup_key
from tidemark.operators.reshape import stack_rows
from tidemark.operators.window import period_shift, top_k, top_per_group, with_change
from tidemark.sources.schemas import CRASH_COLUMNS
from tidemark.sources.tables import rename_map

# Labels and known spellings of vehicle types.
UNKNOWN = "UNKNOWN/UNASSIGNED"
UNSPECIFIED = "Unspecified"
SPEEDING = "Unsafe Speed"
AGGRESSIVE = "Aggressive Driving/Road Rage"
VEHICLE_SPELLINGS = {
    "sedan": "Sedan",
    "4 dr sedan": "Sedan",
    "suv": "Station Wagon/Sport Utility Vehicle",
    "station wagon/suv": "Station Wagon/Sport Utility Vehicle",
    "sport utility / station wagon": "Station Wagon/Sport Utility Vehicle",
    "station wagon/sport utility vehicle": "Station Wagon/Sport Utility Vehicle",
    "pickup": "Pick-up Truck",
    "pick up truck": "Pick-up Truck",
    "box truck": "Box Truck",
    "bicycle": "Bike",
    "bike": "Bike",
}
ROLES = {"Pedestrian": "pedestrians", "Cyclist": "cyclists", "Motorist": "motorists"}


def incident_view(raw: DataFrame, order_by: Sequence[str | Column],
                  spellings: Mapping[str, str] = VEHICLE_SPELLINGS) -> DataFrame:
    """One clean row per collision id.

    Names, dates, null-island coordinates and vehicle types are put right;
    missing places stay NULL. `order_by` must decide which duplicate survives.
    """
    named = rename_map(dedup_key(raw, "COLLISION_ID", order_by), CRASH_COLUMNS)
    island = {"latitude": 0.0, "longitude": 0.0}
    fixed = named.withColumns({
        "crash_date": us_date("crash_date_text"),
        "crash_hour": hour_of_time("crash_time"),
        "latitude": null_if_sentinel("latitude", island),
        "longitude": null_if_sentinel("longitude", island),
    }).withColumns({"crash_year": F.year("crash_date"), "crash_month": F.month("crash_date")})
    for n in ("1", "2"):
        fixed = canonicalize(fixed, f"vehicle_type_{n}", spellings, into=f"vehicle_type_{n}_clean")
    return fixed.drop("crash_date_text", "vehicle_type_1", "vehicle_type_2")


def known_cause() -> Column:
    return F.col("contributing_factor_1") != UNSPECIFIED


def yearly_trend(df: DataFrame) -> DataFrame:
    """Counts per year with the change against the previous row."""
    yearly = df.groupBy("crash_year").agg(rows().alias("crashes"))
    return with_change(yearly, "crash_year", "crashes", prev="prev_year_crashes", diff=None,
                       pct="pct_change_vs_prev_year", digits=1)


def yoy_change(df: DataFrame) -> DataFrame:
    """Counts per year with the change against the previous calendar year."""
    yearly = df.groupBy("crash_year").agg(rows().alias("crashes"))
    shifted = period_shift(yearly, "crash_year", "crashes", "prior_year_crashes")
    gap = F.col("crashes") - F.col("prior_year_crashes")
    return shifted.withColumn("yoy_change_pct", pct(gap, "prior_year_crashes", 6))


def monthly_trend(df: DataFrame) -> DataFrame:
    return df.groupBy("crash_year", "crash_month").agg(rows().alias("crashes"))


def _place(grouped: DataFrame) -> DataFrame:
    """Label the NULL group after grouping on the raw column."""
    return grouped.withColumn("borough", label_null("borough", UNKNOWN))


def geo_breakdown(df: DataFrame) -> DataFrame:
    grouped = df.groupBy("borough").agg(rows().alias("crashes"), F.sum("persons_injured").alias("total_injured"),
                                        F.sum("persons_killed").alias("total_killed"))
    return _place(share_of_total(grouped, "crashes", "pct_of_all_crashes", 1))


def geo_year_trend(df: DataFrame) -> DataFrame:
    return _place(df.groupBy("crash_year", "borough").agg(rows().alias("crashes")))


def top_streets(df: DataFrame, k: int = 10) -> DataFrame:
    grouped = df.dropna(subset=["on_street"]).groupBy("on_street").agg(
        rows().alias("crashes"), F.sum("persons_injured").alias("total_injured"),
        F.sum("persons_killed").alias("total_killed"))
    return top_k(grouped, "crashes", k, "on_street")


def top_intersections(df: DataFrame, k: int = 10, unordered: bool = False) -> DataFrame:
    """Street pairs with most incidents; (A, B) and (B, A) differ by default."""
    pairs = df.where(F.col("on_street") != F.col("cross_street"))
    if unordered:
        pairs = pairs.withColumns({"on_street": F.least("on_street", "cross_street"),
                                   "cross_street": F.greatest("on_street", "cross_street")})
    grouped = pairs.groupBy("on_street", "cross_street").agg(
        rows().alias("crashes"), F.sum("persons_injured").alias("total_injured"),
        F.sum("persons_killed").alias("total_killed"))
    return top_k(grouped, "crashes", k, "on_street", "cross_street")


def factor_share(df: DataFrame, known_only: bool = False, k: int | None = None) -> DataFrame:
    """Factor counts and percent of all (or of known-cause) incidents."""
    name = "pct_of_known_cause_crashes" if known_only else "pct_of_all_crashes"
    base = df.where(known_cause()) if known_only else df
    shared = share_of_total(base.groupBy("contributing_factor_1").agg(rows().alias("crashes")), "crashes", name, 1)
    return top_k(shared, "crashes", k, "contributing_factor_1") if k else shared


def top_factor_per(df: DataFrame) -> DataFrame:
    grouped = df.where(known_cause()).groupBy("borough", "contributing_factor_1").agg(rows().alias("crashes"))
    return top_per_group(_place(grouped), ["borough"], "crashes")


def driving_tests() -> dict[str, Column]:
    """The two behaviours asked about, as named predicates."""
    factor = F.col("contributing_factor_1")
    return {"speeding": factor == SPEEDING, "aggressive_driving": factor == AGGRESSIVE}


def flag_rates_by(df: DataFrame, tests: Mapping[str, Column], by: str = "borough") -> DataFrame:
    """Rows, and n and percent for each named predicate, per group."""
    grouped = df.groupBy(by).agg(rows().alias("total_crashes"), *conditional_measures(tests))
    return _place(grouped) if by == "borough" else grouped


def factor_matrix(df: DataFrame, k: int = 5) -> DataFrame:
    """Leading factors per borough; percent within the LEADING factors' rows.

    Factor x borough counts are small, so the top-k set is found and applied on
    them and the incidents are read once.
    """
    cells = df.where(known_cause()).groupBy("borough", "contributing_factor_1").agg(rows().alias("crashes"))
    overall = cells.groupBy("contributing_factor_1").agg(F.sum("crashes").alias("n"))
    leaders = top_k(overall, "n", k, "contributing_factor_1").select("contributing_factor_1")
    kept = cells.join(F.broadcast(leaders), "contributing_factor_1", "left_semi")
    return share_within(_place(kept), "crashes", ["borough"], "pct_within_borough_top_factors")


def severity_by(df: DataFrame) -> DataFrame:
    return _place(df.groupBy("borough").agg(
        rows().alias("crashes"), F.sum("persons_injured").alias("total_injured"),
        F.sum("persons_killed").alias("total_killed"),
        per_mille(F.sum("persons_killed"), rows()).alias("fatalities_per_1000_crashes")))


def role_totals(df: DataFrame) -> DataFrame:
    """One row: injured and killed sums of every road-user role."""
    aggs = []
    for col in ROLES.values():
        aggs += [F.sum(f"{col}_injured").alias(f"{col}_injured"), F.sum(f"{col}_killed").alias(f"{col}_killed")]
    return df.agg(*aggs)


def by_role(df: DataFrame) -> DataFrame:
    """Injured and killed per road user: three rows from one totals row."""
    labels = {label: {"injured": f"{c}_injured", "killed": f"{c}_killed"} for label, c in ROLES.items()}
    return stack_rows(role_totals(df), labels, "road_user")


def road_user_share(df: DataFrame) -> DataFrame:
    """Share of injured beside share of killed; totals are the role sums."""
    roles = share_of_total(by_role(df), "injured", "pct_of_all_injured", 1)
    return share_of_total(roles, "killed", "pct_of_all_killed", 1)


def fatality_when_involved(df: DataFrame) -> DataFrame:
    return by_role(df).select(
        "road_user", pct("killed", F.col("killed") + F.col("injured")).alias("pct_fatal_when_involved"))


def severity_trend(df: DataFrame) -> DataFrame:
    cols = ["persons_injured", "persons_killed", "pedestrians_killed", "cyclists_killed", "motorists_killed"]
    names = {"persons_injured": "total_injured", "persons_killed": "total_killed"}
    return df.groupBy("crash_year").agg(*[F.sum(c).alias(names.get(c, c)) for c in cols])


def _typed(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["vehicle_type_1_clean"]).withColumnRenamed("vehicle_type_1_clean", "vehicle_type")


def type_share(df: DataFrame, k: int = 15) -> DataFrame:
    grouped = _typed(df).groupBy("vehicle_type").agg(rows().alias("crashes"))
    return top_k(share_of_total(grouped, "crashes", "pct_of_crashes", 1), "crashes", k, "vehicle_type")


def type_severity(df: DataFrame, min_n: int = 500) -> DataFrame:
    """Percent with injury and fatal INCIDENTS per 1,000 (not persons)."""
    return _typed(df).groupBy("vehicle_type").agg(
        rows().alias("crashes"),
        pct(count_where(F.col("persons_injured") > 0), rows(), 1).alias("pct_crashes_with_injury"),
        per_mille(count_where(F.col("persons_killed") > 0), rows()).alias("fatal_crashes_per_1000"),
    ).where(F.col("crashes") >= min_n)


def vulnerable_fatal_by_type(df: DataFrame, k: int = 10) -> DataFrame:
    hit = (F.col("pedestrians_killed") > 0) | (F.col("cyclists_killed") > 0)
    grouped = _typed(df.where(hit)).groupBy("vehicle_type").agg(rows().alias("crashes_with_ped_or_cyclist_killed"))
    return top_k(grouped, "crashes_with_ped_or_cyclist_killed", k, "vehicle_type")


def _known() -> Column:
    return count_where(known_cause())


def _speeding() -> Column:
    return count_where(F.col("contributing_factor_1") == SPEEDING)


def _outcome(name: str) -> Column:
    return sum_where("value", F.col("outcome") == name)


# Measures over the long table of persons by road user and outcome.
ROAD_USER_MEASURES = Measures(
    injured=lambda: _outcome("Injured"),
    killed=lambda: _outcome("Killed"),
    fatality_rate_when_involved=lambda: pct(_outcome("Killed"), _outcome("Killed") + _outcome("Injured"), 4),
)

INCIDENT_MEASURES = Measures(
    total_crashes=rows,
    total_injured=lambda: F.sum("persons_injured"),
    total_killed=lambda: F.sum("persons_killed"),
    fatalities_per_1000_crashes=lambda: round_to(
        safe_div(F.lit(1000.0) * F.sum("persons_killed"), rows()), 6),
    speeding_crashes=_speeding,
    pct_speeding=lambda: pct(_speeding(), rows(), 6),
    crashes_with_known_cause=_known,
    pct_unspecified_cause=lambda: pct(rows() - _known(), rows(), 6),
    fatal_crashes_per_1000=lambda: round_to(
        safe_div(F.lit(1000.0) * count_where(F.col("persons_killed") > 0), rows()), 6),
    pct_crashes_with_unassigned_borough=lambda: pct(count_where(F.col("borough").isNull()), rows(), 6),
)
