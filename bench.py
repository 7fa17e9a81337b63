"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the local cores. Every query computes its whole result: small
results are collected, row-level ones go to the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.queries import CATALOGUE  # noqa: E402
from tidemark.queries.base import Inputs  # noqa: E402
from tidemark.runtime import build_session, drop_kept  # noqa: E402

HEADLINES = [
    "prf_1_order_profit_view", "prf_2_profitability", "prf_3_cost_structure", "prf_7_margin_matrix",
    "prf_11_top_return_reason_per", "mkt_1_platform_efficiency", "mkt_4_recent_vs_full", "mkt_8_combined_scenarios",
    "chn_1_subscription_view", "chn_6_segment_rate_all_cuts", "chn_14_clv_to_cac", "chn_15_net_new_mrr",
    "chn_17_nrr", "chn_20_threshold_from_churned", "inc_1_incident_view", "inc_4_geo_breakdown",
    "inc_11_factor_matrix", "inc_13_road_user_share", "inc_17_type_severity", "rfm_1_sales_clean", "rfm_3_rfm",
    "coh_2_cohort_retention", "coh_4_channel_retention", "sta_2_kmeans_segment", "sta_3_inertia_by_k", "sta_4_rank_sums",
    "agg_9_exact_quantiles", "dq_5_domain_values_order_lines", "dq_8_orphan_report", "dq_15_exact_duplicate_count",
    "cln_2_dedup_key", "agg_21_measure_filter_context", "agg_21_mrr_periods_by_plan", "agg_21_yoy_by_borough_year",
    "prf_2_profitability_cube",
]
ROW_LEVEL = {"prf_1_order_profit_view", "chn_1_subscription_view", "inc_1_incident_view", "rfm_1_sales_clean",
             "rfm_3_rfm", "cln_2_dedup_key", "sta_2_kmeans_segment"}


def timed(spark, path: str, key: str) -> float:
    start = time.perf_counter()
    df = CATALOGUE[key].run(spark, path)
    if key in ROW_LEVEL:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.collect()
    return time.perf_counter() - start


def scale(path: str) -> float | str:
    name = Path(path).name.removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8)
    timed(spark, path, "inc_4_geo_breakdown")  # warm the JVM
    took = {}
    for name in ("lines", "tx"):  # tables that reports share are built here, in rows of their own
        start = time.perf_counter()
        getattr(Inputs(spark, path), name)
        took[f"build_{name}"] = round(time.perf_counter() - start, 3)
    took |= {key: round(timed(spark, path, key), 3) for key in HEADLINES}
    drop_kept(spark)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": scale(path)}))


if __name__ == "__main__":
    main()
