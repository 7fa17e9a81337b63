"""Sessions against a plain loop, in batch and as a stream with restarts, late and repeated rows."""

import datetime as dt
import random

import pytest

from tidemark.operators.sessions import sessions
from tidemark.streaming.sessions import session_stream, write_available

START, GAP = dt.datetime(2024, 1, 1), dt.timedelta(minutes=30)
SCHEMA = "k string, at timestamp, v long"


def plain(rows):
    out = []
    for key in {k for k, at, _ in rows if k is not None and at is not None}:
        run = []
        for at, v in sorted((at, v) for k, at, v in rows if k == key and at is not None):
            if run and at > run[-1][0] + GAP:
                out.append((key, run[0][0], run[-1][0] + GAP, len(run), sum(x for _, x in run)))
                run = []
            run.append((at, v))
        out.append((key, run[0][0], run[-1][0] + GAP, len(run), sum(x for _, x in run)))
    return sorted(out)


def made(seed, n=600, days=4):
    """Half on one key, pauses of exactly the gap among them, ties, repeated rows, NULLs."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), START + dt.timedelta(minutes=rng.randrange(days * 288) * 5),
             rng.randrange(10)) for _ in range(n)]
    return rows + rows[:30] + [("a", None, 1)]


@pytest.mark.parametrize("buckets", [1, 8, 200, None])
def test_sessions_match_a_loop(spark, buckets):
    rows = made(1)
    got = sessions(spark.createDataFrame(rows, SCHEMA), "at", ["k"], "30 minutes", ["v"], buckets)
    assert got.columns == ["k", "session_start", "session_end", "events", "v"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_sessions_of_nothing(spark):
    df = spark.createDataFrame(made(1), SCHEMA)
    assert sessions(df.where("false"), "at", ["k"], "30 minutes").count() == 0
    assert sessions(df.where("k is null"), "at", ["k"], "30 minutes").count() == 0


def test_stream_gives_closed_sessions_once(spark, tmp_path):
    """Files come in three runs on one checkpoint, in order of time; then a row far behind the watermark."""
    rows = [r for r in made(2) if r[1] is not None]
    arriving, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    _land(spark, [], arriving)
    stream = session_stream(spark.readStream.schema(SCHEMA).parquet(arriving), "at", ["k"], "30 minutes", "1 hour", ["v"])
    ordered = sorted(rows, key=lambda r: r[1])
    for start in (0, 200, 400):
        _land(spark, ordered[start:start + 200 if start < 400 else len(ordered)], arriving)
        write_available(stream, target, progress)
        write_available(stream, target, progress)  # a run without new files adds nothing
    _land(spark, [("late", START - dt.timedelta(days=3), 1)], arriving)
    write_available(stream, target, progress)
    got = sorted(tuple(r) for r in spark.read.parquet(target).collect())
    mark = max(at for _, at, _ in rows) - dt.timedelta(hours=1)
    assert got == [s for s in plain(rows) if s[2] <= mark]


def _land(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
