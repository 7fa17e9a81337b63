"""Incident analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import pct
from tidemark.operators.aggregate import Calculated, share_within
from tidemark.operators.reshape import unpivot_counts
from tidemark.plans import incidents as ic
from tidemark.queries.base import query
from tidemark.queries.oracle import CW, I, N, P, R
from tidemark.sources.dims import ROAD_USER_COLUMNS, dim_road_user

PLACE = "COALESCE(borough, 'UNKNOWN/UNASSIGNED')"
KNOWN = "contributing_factor_1 <> 'Unspecified'"
INJ, KIL = I("SUM(persons_injured)"), I("SUM(persons_killed)")
ROLE_TOTALS = """r AS (
  SELECT 'Pedestrian' AS road_user, SUM(pedestrians_injured) AS i, SUM(pedestrians_killed) AS k FROM inc UNION ALL
  SELECT 'Cyclist', SUM(cyclists_injured), SUM(cyclists_killed) FROM inc UNION ALL
  SELECT 'Motorist', SUM(motorists_injured), SUM(motorists_killed) FROM inc)"""

VIEW = ["collision_id", "crash_date", "crash_year", "crash_month", "crash_hour", "crash_time", "borough", "zip_code",
        "latitude", "longitude", "on_street", "cross_street", "persons_injured", "persons_killed",
        "contributing_factor_1", "contributing_factor_2", "vehicle_type_1_clean", "vehicle_type_2_clean"]


@query("inc_1_incident_view", "inc", sql=f"SELECT {', '.join(VIEW)} FROM inc")
def _(t):
    return t.incidents.select(*VIEW)


@query("inc_2_yearly_trend", "inc", sql=f"""
WITH y AS (SELECT crash_year, {N} AS crashes FROM inc GROUP BY crash_year),
l AS (SELECT *, LAG(crashes) OVER (ORDER BY crash_year) AS p FROM y)
SELECT crash_year, crashes, p AS prev_year_crashes, {P('crashes - p', 'p', 1)} AS pct_change_vs_prev_year FROM l""")
def _(t):
    return ic.yearly_trend(t.incidents).orderBy("crash_year")


@query("inc_2_yoy_change", "inc", sql=f"""
WITH y AS (SELECT crash_year, {N} AS crashes FROM inc GROUP BY crash_year)
SELECT a.crash_year, a.crashes, b.crashes AS prior_year_crashes,
       {P('a.crashes - b.crashes', 'b.crashes', 6)} AS yoy_change_pct
FROM y a LEFT JOIN y b ON b.crash_year = a.crash_year - 1""")
def _(t):
    return ic.yoy_change(t.incidents)


@query("inc_3_monthly_trend", "inc",
       sql=f"SELECT crash_year, crash_month, {N} AS crashes FROM inc GROUP BY crash_year, crash_month")
def _(t):
    return ic.monthly_trend(t.incidents).orderBy("crash_year", "crash_month")


@query("inc_4_geo_breakdown", "inc", sql=f"""
SELECT {PLACE} AS borough, {N} AS crashes, {P('COUNT(*)', '(SELECT COUNT(*) FROM inc)', 1)} AS pct_of_all_crashes,
       {INJ} AS total_injured, {KIL} AS total_killed
FROM inc GROUP BY inc.borough""")
def _(t):
    return ic.geo_breakdown(t.incidents)


@query("inc_5_geo_year_trend", "inc",
       sql=f"SELECT crash_year, {PLACE} AS borough, {N} AS crashes FROM inc GROUP BY crash_year, inc.borough")
def _(t):
    return ic.geo_year_trend(t.incidents).orderBy("borough", "crash_year")


@query("inc_6_top_streets", "inc", sql=f"""
SELECT on_street, {N} AS crashes, {INJ} AS total_injured, {KIL} AS total_killed
FROM inc WHERE on_street IS NOT NULL GROUP BY on_street ORDER BY COUNT(*) DESC, on_street LIMIT 10""")
def _(t):
    return ic.top_streets(t.incidents, 10)


@query("inc_7_top_intersections", "inc", sql=f"""
SELECT on_street, cross_street, {N} AS crashes, {INJ} AS total_injured, {KIL} AS total_killed
FROM inc WHERE on_street IS NOT NULL AND cross_street IS NOT NULL AND on_street <> cross_street
GROUP BY on_street, cross_street ORDER BY COUNT(*) DESC, on_street, cross_street LIMIT 10""")
def _(t):
    return ic.top_intersections(t.incidents, 10)


@query("inc_7_top_intersections_unordered", "inc", sql=f"""
SELECT LEAST(on_street, cross_street) AS on_street, GREATEST(on_street, cross_street) AS cross_street,
       {N} AS crashes, {INJ} AS total_injured, {KIL} AS total_killed
FROM inc WHERE on_street IS NOT NULL AND cross_street IS NOT NULL AND on_street <> cross_street
GROUP BY 1, 2 ORDER BY COUNT(*) DESC, 1, 2 LIMIT 10""")
def _(t):
    return ic.top_intersections(t.incidents, 10, unordered=True)


@query("inc_8_factor_share", "inc", sql=f"""
SELECT contributing_factor_1, {N} AS crashes, {P('COUNT(*)', '(SELECT COUNT(*) FROM inc)', 1)} AS pct_of_all_crashes
FROM inc GROUP BY contributing_factor_1""")
def _(t):
    return ic.factor_share(t.incidents)


@query("inc_8_factor_share_known_top", "inc", sql=f"""
SELECT contributing_factor_1, {N} AS crashes,
       {P('COUNT(*)', f'(SELECT COUNT(*) FROM inc WHERE {KNOWN})', 1)} AS pct_of_known_cause_crashes
FROM inc WHERE {KNOWN} GROUP BY contributing_factor_1 ORDER BY COUNT(*) DESC, contributing_factor_1 LIMIT 5""")
def _(t):
    return ic.factor_share(t.incidents, known_only=True, k=5)


@query("inc_9_top_factor_per", "inc", sql=f"""
SELECT borough, contributing_factor_1, crashes FROM (
  SELECT {PLACE} AS borough, contributing_factor_1, {N} AS crashes,
         RANK() OVER (PARTITION BY {PLACE} ORDER BY COUNT(*) DESC) AS rnk
  FROM inc WHERE {KNOWN} GROUP BY inc.borough, contributing_factor_1) WHERE rnk = 1""")
def _(t):
    return ic.top_factor_per(t.incidents)


@query("inc_10_flag_rates_by", "inc", sql=f"""
SELECT {PLACE} AS borough, {N} AS total_crashes,
       {CW("contributing_factor_1 = 'Brand#7'")} AS first_n, {P(CW("contributing_factor_1 = 'Brand#7'"), N)} AS first_pct,
       {CW("contributing_factor_1 = 'Brand#12'")} AS second_n,
       {P(CW("contributing_factor_1 = 'Brand#12'"), N)} AS second_pct
FROM inc GROUP BY inc.borough""")
def _(t):
    factor = F.col("contributing_factor_1")
    return ic.flag_rates_by(t.incidents, {"first": factor == "Brand#7", "second": factor == "Brand#12"})


@query("inc_11_factor_matrix", "inc", sql=f"""
WITH top5 AS (SELECT contributing_factor_1 AS f FROM inc WHERE {KNOWN}
              GROUP BY contributing_factor_1 ORDER BY COUNT(*) DESC, contributing_factor_1 LIMIT 5)
SELECT {PLACE} AS borough, contributing_factor_1, {N} AS crashes,
       {P('COUNT(*)', f'SUM(COUNT(*)) OVER (PARTITION BY {PLACE})')} AS pct_within_borough_top_factors
FROM inc JOIN top5 ON f = contributing_factor_1 GROUP BY inc.borough, contributing_factor_1""")
def _(t):
    return ic.factor_matrix(t.incidents, 5)


@query("inc_12_severity_by", "inc", sql=f"""
SELECT {PLACE} AS borough, {N} AS crashes, {INJ} AS total_injured, {KIL} AS total_killed,
       {R('CAST(1000 AS DOUBLE) * CAST(SUM(persons_killed) AS DOUBLE) / COUNT(*)')} AS fatalities_per_1000_crashes
FROM inc GROUP BY inc.borough""")
def _(t):
    return ic.severity_by(t.incidents)


@query("inc_13_road_user_share", "inc", sql=f"""
WITH {ROLE_TOTALS}
SELECT road_user, {I('i')} AS injured, {I('k')} AS killed, {P('i', '(SELECT SUM(i) FROM r)', 1)} AS pct_of_all_injured,
       {P('k', '(SELECT SUM(k) FROM r)', 1)} AS pct_of_all_killed
FROM r""")
def _(t):
    return ic.road_user_share(t.incidents)


@query("inc_14_fatality_when_involved", "inc", sql=f"""
WITH {ROLE_TOTALS} SELECT road_user, {P('k', 'k + i')} AS pct_fatal_when_involved FROM r""")
def _(t):
    return ic.fatality_when_involved(t.incidents)


@query("inc_15_severity_trend", "inc", sql=f"""
SELECT crash_year, {INJ} AS total_injured, {KIL} AS total_killed, {I('SUM(pedestrians_killed)')} AS pedestrians_killed,
       {I('SUM(cyclists_killed)')} AS cyclists_killed, {I('SUM(motorists_killed)')} AS motorists_killed
FROM inc GROUP BY crash_year""")
def _(t):
    return ic.severity_trend(t.incidents).orderBy("crash_year")


@query("inc_16_type_share", "inc", sql=f"""
SELECT vehicle_type_1_clean AS vehicle_type, {N} AS crashes,
       {P('COUNT(*)', '(SELECT COUNT(*) FROM inc WHERE vehicle_type_1_clean IS NOT NULL)', 1)} AS pct_of_crashes
FROM inc WHERE vehicle_type_1_clean IS NOT NULL GROUP BY vehicle_type_1_clean
ORDER BY COUNT(*) DESC, vehicle_type_1_clean LIMIT 15""")
def _(t):
    return ic.type_share(t.incidents, 15)


@query("inc_17_type_severity", "inc", sql=f"""
SELECT vehicle_type_1_clean AS vehicle_type, {N} AS crashes,
       {P(CW('persons_injured > 0'), N, 1)} AS pct_crashes_with_injury,
       {R(f"CAST(1000 AS DOUBLE) * CAST({CW('persons_killed > 0')} AS DOUBLE) / COUNT(*)")} AS fatal_crashes_per_1000
FROM inc WHERE vehicle_type_1_clean IS NOT NULL GROUP BY vehicle_type_1_clean HAVING COUNT(*) >= 500""")
def _(t):
    return ic.type_severity(t.incidents, 500)


@query("inc_18_vulnerable_fatal_by_type", "inc", sql=f"""
SELECT vehicle_type_1_clean AS vehicle_type, {N} AS crashes_with_ped_or_cyclist_killed
FROM inc WHERE vehicle_type_1_clean IS NOT NULL AND (pedestrians_killed > 0 OR cyclists_killed > 0)
GROUP BY vehicle_type_1_clean ORDER BY COUNT(*) DESC, vehicle_type_1_clean LIMIT 10""")
def _(t):
    return ic.vulnerable_fatal_by_type(t.incidents, 10)


def _kpi(by: str) -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return f"""
SELECT {head}{N} AS total_crashes, {INJ} AS total_injured, {KIL} AS total_killed,
       {R('CAST(1000 AS DOUBLE) * CAST(SUM(persons_killed) AS DOUBLE) / COUNT(*)', 6)} AS fatalities_per_1000_crashes,
       {CW("contributing_factor_1 = 'Unsafe Speed'")} AS speeding_crashes,
       {P(CW("contributing_factor_1 = 'Unsafe Speed'"), N, 6)} AS pct_speeding,
       {CW(KNOWN)} AS crashes_with_known_cause, {P(f'COUNT(*) - {CW(KNOWN)}', N, 6)} AS pct_unspecified_cause,
       {R(f"CAST(1000 AS DOUBLE) * CAST({CW('persons_killed > 0')} AS DOUBLE) / COUNT(*)", 6)} AS fatal_crashes_per_1000,
       {P(CW('borough IS NULL'), N, 6)} AS pct_crashes_with_unassigned_borough
FROM inc{tail}"""


@query("inc_19_kpi_measures", "inc", sql=_kpi(""))
def _(t):
    return ic.INCIDENT_MEASURES.evaluate(t.incidents)


@query("inc_19_kpi_measures_by_year", "inc", sql=_kpi("crash_year"))
def _(t):
    return ic.INCIDENT_MEASURES.evaluate(t.incidents, by=["crash_year"])


def _unpivot(ids: str, group: str = "") -> str:
    parts = [
        f"SELECT {ids}'{user}' AS road_user, '{outcome}' AS outcome, {I(f'SUM({col})')} AS value FROM inc {group}"
        for col, (user, outcome) in ROAD_USER_COLUMNS.items()
    ]
    return "\nUNION ALL\n".join(parts)


@query("src_10_road_user_dimension", "inc", sql=_unpivot(""))
def _(t):
    return dim_road_user(ic.role_totals(t.incidents))


@query("resh_1_unpivot_counts", "inc", sql=_unpivot("crash_year, ", "GROUP BY crash_year"))
def _(t):
    yearly = t.incidents.groupBy("crash_year").agg(*[F.sum(c).alias(c) for c in ROAD_USER_COLUMNS])
    return unpivot_counts(yearly, ["crash_year"], ROAD_USER_COLUMNS)


@query("set_1_union_all_roles", "inc", sql=f"""
WITH {ROLE_TOTALS} SELECT road_user, {I('i')} AS injured, {I('k')} AS killed FROM r""")
def _(t):
    return ic.by_role(t.incidents)


@query("agg_21_measure_filter_context", "inc", sql=f"""
SELECT borough, crash_year, {N} AS total_crashes, {KIL} AS total_killed,
       {I('SUM(COUNT(*)) OVER (PARTITION BY crash_year)')} AS all_borough_crashes,
       {I('SUM(COUNT(*)) OVER ()')} AS all_crashes,
       {I('NULLIF(SUM(CASE WHEN persons_injured > 0 THEN 1 ELSE 0 END), 0)')} AS injury_crashes
FROM inc GROUP BY borough, crash_year""")
def _(t):
    return ic.INCIDENT_MEASURES.evaluate(t.incidents, ["total_crashes", "total_killed"], ["borough", "crash_year"], {
        "all_borough_crashes": Calculated("total_crashes", all_of=("borough",)),
        "all_crashes": Calculated("total_crashes", all_of=("borough", "crash_year")),
        "injury_crashes": Calculated("total_crashes", where=F.col("persons_injured") > 0)})


@query("agg_21_road_user_measures", "inc", sql=f"""
WITH u AS ({_unpivot('crash_year, ', 'GROUP BY crash_year')}),
m AS (SELECT crash_year, road_user, {I("SUM(CASE WHEN outcome = 'Injured' THEN value ELSE 0 END)")} AS injured,
             {I("SUM(CASE WHEN outcome = 'Killed' THEN value ELSE 0 END)")} AS killed FROM u GROUP BY crash_year, road_user)
SELECT *, {P('killed', 'killed + injured', 4)} AS fatality_rate_when_involved,
       {P('injured', 'SUM(injured) OVER (PARTITION BY crash_year)', 4)} AS pct_of_all_injured,
       {P('killed', 'SUM(killed) OVER (PARTITION BY crash_year)', 4)} AS pct_of_all_killed
FROM m""")
def _(t):
    yearly = t.incidents.groupBy("crash_year").agg(*[F.sum(c).alias(c) for c in ROAD_USER_COLUMNS])
    long = unpivot_counts(yearly, ["crash_year"], ROAD_USER_COLUMNS)
    every = {f"all_{m}": Calculated(m, all_of=("road_user",)) for m in ("injured", "killed")}
    out = ic.ROAD_USER_MEASURES.evaluate(long, by=["crash_year", "road_user"], calculated=every)
    shares = {f"pct_of_all_{m}": pct(m, f"all_{m}", 4) for m in ("injured", "killed")}
    return out.withColumns(shares).drop(*every)


@query("agg_21_measure_all_filter", "inc", sql=f"""
WITH u AS ({_unpivot('crash_year, ', 'GROUP BY crash_year')})
SELECT crash_year, road_user, outcome, value,
       {P('value', 'SUM(value) OVER (PARTITION BY crash_year, outcome)', 4)} AS pct_of_outcome
FROM u""")
def _(t):
    yearly = t.incidents.groupBy("crash_year").agg(*[F.sum(c).alias(c) for c in ROAD_USER_COLUMNS])
    long = unpivot_counts(yearly, ["crash_year"], ROAD_USER_COLUMNS)
    return share_within(long, "value", ["crash_year", "outcome"], "pct_of_outcome", 4)


