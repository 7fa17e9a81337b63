"""Catalogue queries against their SQL, and the shape of their plans.

The headline queries always run; TIDEMARK_ALL=1 runs the whole catalogue.
"""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import HEADLINES  # noqa: E402
from tidemark.queries import CATALOGUE  # noqa: E402
from tools.check_oracle import check, connect  # noqa: E402

DATA = os.environ.get("TIDEMARK_DATA", "/root/testdata/sf0.001")
WITH_SQL = [k for k, q in CATALOGUE.items() if q.sql is not None]


def one_per_id() -> list[str]:
    """The headline queries and the first key of every other inventory id."""
    name = lambda key: "_".join(key.split("_")[:2])
    first = {name(k): k for k in reversed(WITH_SQL)}
    chosen = {k for k in HEADLINES if k in WITH_SQL}
    return sorted(chosen | {k for i, k in first.items() if i not in map(name, chosen)})


CHECKED = WITH_SQL if os.environ.get("TIDEMARK_ALL") else one_per_id()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return connect(DATA)


@pytest.mark.parametrize("key", CHECKED)
def test_query_equals_its_sql(spark, duck, key):
    state, diff, rows, _ = check(spark, duck, DATA, key, CATALOGUE[key])
    assert state == "ok", diff
    assert rows > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def final_plan(spark, key):
    df = CATALOGUE[key].run(spark, DATA)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("key", ["prf_2_profitability", "inc_4_geo_breakdown", "inc_11_factor_matrix",
                                 "chn_6_segment_rate_all_cuts", "coh_2_cohort_retention", "sta_4_rank_sums"])
def test_row_path_stays_in_the_jvm(spark, key):
    assert not re.search(r"MapInPandas|EvalPython|Python", final_plan(spark, key))


@pytest.mark.parametrize("key", ["inc_4_geo_breakdown", "inc_8_factor_share", "inc_11_factor_matrix",
                                 "inc_13_road_user_share", "prf_10_return_reason_share", "dq_15_exact_duplicate_count",
                                 "jon_5_semi_join_top_k"])
def test_facts_are_scanned_once(spark, key):
    plan = final_plan(spark, key)
    assert plan.count("lineitem.parquet]") <= 1


@pytest.mark.parametrize("key,most", [("chn_20_threshold_from_churned", 0), ("jon_13_role_playing_date", 2),
                                      ("jon_15_aligned_divide", 1)])
def test_orders_are_scanned_once_a_role(spark, key, most):
    # the months of jon_13's calendar are a scan of their own; chn_20 reads its histogram
    assert final_plan(spark, key).count("orders.parquet]") <= most


def test_only_needed_columns_are_read(spark):
    plan = final_plan(spark, "flt_2_in_list")
    assert "ReadSchema: struct<l_returnflag:string,l_linestatus:string>" in plan
    assert "PushedFilters: [In(l_returnflag, [A,R])]" in plan


def test_entry_works_without_the_corpus_operators():
    """As after the removal of their folder."""
    code = ("import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; "
            "assert e.queries() and e.oracle_sql() and not any(k.startswith('op') or k == 'pipeline' for k in e.queries())")
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True)
