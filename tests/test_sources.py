import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.plans.incidents import INCIDENT_MEASURES, driving_tests, flag_rates_by, incident_view
from tidemark.runtime import attach, drop_kept, kept, materialize, scratch_path, stage
from tidemark.sources import dims
from tidemark.sources.schemas import CRASH_COLUMNS, SCHEMAS
from tidemark.sources.tables import (
    cast_columns,
    conform,
    export,
    read_table,
    register_view,
    rejected_rows,
    schema_of,
)
from tidemark.streaming.loads import append_available, read_stream


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_every_declared_schema_parses(spark, name):
    assert len(schema_of(name).fields) == len({f.name for f in schema_of(name).fields}) > 0


def test_crash_names_cover_the_declared_columns(spark):
    assert [f.name for f in schema_of("crashes").fields] == list(CRASH_COLUMNS)


def test_crash_export_from_file_to_report(spark, tmp_path):
    """A CSV with the export's spaced header, through the view to the measures."""
    header = ",".join(CRASH_COLUMNS)
    lines = [
        "01/15/2019,23:59,QUEENS,11101,40.7,-73.9,BROADWAY,MAIN ST,1,0,1,0,0,0,0,0,Unsafe Speed,,SEDAN,,11",
        "01/15/2019,23:59,QUEENS,11101,40.7,-73.9,BROADWAY,MAIN ST,1,0,1,0,0,0,0,0,Unsafe Speed,,SEDAN,,11",
        "02/30/2019,07:00,,00501,0,0,,,0,1,0,0,0,1,0,0,Unspecified,,box TRUCK,PickUp,12",
    ]
    path = tmp_path / "crashes.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    raw = read_table(spark, str(path), "crashes")
    view = {r.collision_id: r for r in incident_view(raw, ["CRASH DATE", "CRASH TIME"]).collect()}
    assert len(view) == 2
    assert view[11].crash_date == dt.date(2019, 1, 15) and view[11].crash_hour == 23
    assert view[12].crash_date is None and view[12].borough is None and view[12].zip_code == "00501"
    assert view[12].latitude is None and view[12].vehicle_type_1_clean == "Box Truck"
    assert view[12].vehicle_type_2_clean == "Pick-up Truck"
    clean = incident_view(raw, ["CRASH DATE", "CRASH TIME"])
    total = INCIDENT_MEASURES.evaluate(clean).collect()[0]
    assert (total.total_crashes, total.total_killed, total.pct_speeding) == (2, 1, 50.0)
    rates = {r.borough: r.speeding_pct for r in flag_rates_by(clean, driving_tests()).collect()}
    assert rates == {"QUEENS": 100.0, "UNKNOWN/UNASSIGNED": 0.0}


def test_attach_beyond_the_limit_joins_without_broadcast(spark, collected):
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    small, large = attach(rows, stats, "k"), attach(rows, stats, "k", max_rows=0)
    assert collected(small) == collected(large)
    hinted = [d._jdf.queryExecution().optimizedPlan().toString().count("broadcast") for d in (small, large)]
    assert hinted[0] == 1 and hinted[1] == 0


def test_stage_and_materialize_keep_rows_and_schema(spark, frame, collected):
    df = frame([(1, None), (2, "x")], "k int, `a b` string")
    for fixed in (stage(df), materialize(df)):
        assert fixed.columns == df.columns
        assert collected(fixed) == collected(df)


def test_scratch_paths_differ(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")


def test_conform_and_cast(frame):
    df = frame([("P1", "a", "n", "1.239", "x")], "product_id string, category string, product_name string, "
                                                "unit_cost string, other string")
    assert conform(df, "products").schema["unit_cost"].dataType.simpleString() == "decimal(18,2)"
    assert "other" not in conform(df, "products").columns
    assert cast_columns(df, {"unit_cost": "double", "other": "int"}).collect()[0][3:] == (1.239, None)


def test_registered_view_is_readable(spark, frame):
    register_view(frame([(1,)], "k int"), "v_k")
    assert spark.sql("SELECT k FROM v_k").collect()[0].k == 1


def test_ordered_dimensions(spark):
    plans = {r.plan: r.sort_order for r in dims.ordered_dim(spark, "plan", dims.PLAN_ORDER).collect()}
    assert plans == {"Starter": 1, "Professional": 2, "Business": 3, "Enterprise": 4}
    places = dims.ordered_dim(spark, "borough", dims.BOROUGH_ORDER).collect()
    assert places[0].borough == "Brooklyn" and places[-1].sort_order == 6


def test_months_of_calendar(spark):
    months = dims.months_of(dims.calendar(spark, "2024-01-15", "2024-03-02")).orderBy("month_key").collect()
    assert [(r.month_key, r.days) for r in months] == [("2024-01", 17), ("2024-02", 29), ("2024-03", 2)]


ODD = [(1, 'say "hi", ok'), (2, " lead"), (3, "trail "), (4, "two\nlines"), (5, None), (6, "\tx\\"), (7, '"'), (8, "a,b")]


def test_export_and_read_keep_text(spark, frame, tmp_path, collected):
    path = export(frame(ODD, "k int, v string"), ["k", "v"], str(tmp_path / "out"))
    assert collected(read_table(spark, path, "k int, v string", multi_line=True)) == sorted(ODD, key=repr)
    pandas = pytest.importorskip("pandas")
    parts = [pandas.read_csv(f) for f in (tmp_path / "out").glob("*.csv")]
    read = {r.k: None if r.v != r.v else r.v for r in pandas.concat(parts).itertuples()}
    assert read == dict(ODD)


def test_bad_rows_fail_or_are_counted(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('k,v\n1,"say ""hi"", ok"\nx,2\n3\n4,d\n')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_table(spark, str(path), "k int, v string").collect()
    assert tuple(rejected_rows(spark, str(path), "k int, v string").first()) == (2, 2)
    path.write_text("v,k\na,1\n")
    with pytest.raises(Exception, match="CSV header"):
        read_table(spark, str(path), "k int, v string").collect()


def test_incremental_load_checks_names_and_counts_every_batch(spark, tmp_path):
    folder, target, memory = (str(tmp_path / n) for n in ("in", "out", "memory"))
    (tmp_path / "in").mkdir()
    for n in range(6):
        (tmp_path / "in" / f"{n}.csv").write_text(f"k,v\n{n},a\n{n},b\n")
    before = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        stream = spark.readStream.schema("k int, v string").option("header", True).option("maxFilesPerTrigger", 1).csv(folder)
        assert append_available(stream, target, memory) == 12
        assert append_available(read_stream(spark, folder, "k int, v string"), target, memory) == 0
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", before)
    assert spark.read.parquet(target).count() == 12
    (tmp_path / "in" / "bad.csv").write_text("v,k\na,1\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        append_available(read_stream(spark, folder, "k int, v string"), target, memory)


def test_kept_tables_are_written_once_and_removed(spark, frame):
    built = []

    def build():
        built.append(1)
        return frame([(1, "a"), (2, None)], "k int, v string")

    first, second = kept(spark, "test/kept", build), kept(spark, "test/kept", build)
    assert first.collect() == second.collect() and built == [1]
    drop_kept(spark)
    assert kept(spark, "test/kept", build).count() == 2 and built == [1, 1]
