"""JSON columns, hierarchies and keyed upserts."""

import pytest

from conftest import rows_of
from tidemark.operators.hierarchy import ancestors, roll_up
from tidemark.operators.semistructured import drift, field_kinds, sum_maps, typed_fields
from tidemark.streaming.upserts import current, upsert_available

TEXTS = ['{"a": 1, "b": "x"}', '{"a": "2", "c": [1]}', '{"a": null, "d": {"e": 1.5}, "f": true}', "no json", "[1]", "", None, "{}"]


def test_typed_fields(frame):
    df = frame([(t,) for t in TEXTS], "j string")
    got = [tuple(r) for r in typed_fields(df, "j", {"a": "long", "b": "string"}).drop("j").collect()]
    assert got == [(1, "x", True), (2, None, True), (None, None, True), (None, None, False), (None, None, True),
                   (None, None, False), (None, None, None), (None, None, True)]


def test_drift(frame):
    df = frame([(t,) for t in TEXTS], "j string")
    assert rows_of(field_kinds(df, "j")) == rows_of(frame(
        [("a", "number", 1), ("a", "text", 1), ("a", "null", 1), ("b", "text", 1), ("c", "list", 1), ("d", "object", 1),
         ("f", "boolean", 1)], "f string, k string, n long"))
    got = {(r.field, r.kind): (r.rows, r.state) for r in drift(df, "j", {"a": "number", "b": "number", "z": "text"}).collect()}
    assert got[("a", "number")] == (1, "expected") and got[("a", "text")] == (1, "other kind")
    assert got[("a", "null")] == (1, "expected") and got[("b", "text")] == (1, "other kind")
    assert got[("c", "list")] == (1, "new") and got[("z", None)] == (0, "missing")
    assert drift(df.limit(0), "j", {"z": "text"}).collect()[0].state == "missing"


def test_sum_maps(frame):
    df = frame([(1, {"a": 1, "b": 2}), (1, {"a": 5, "c": None}), (2, {}), (2, None), (3, {"a": 7})], "g int, m map<string,long>")
    assert rows_of(sum_maps(df, "m", ["g"])) == [(1, "a", 6, 2), (1, "b", 2, 1), (1, "c", None, 1), (3, "a", 7, 1)]


def test_roll_up(frame):
    nodes = frame([(1, None), (2, 1), (3, 1), (4, 3), (4, 3), (5, 99), (None, 1)], "n int, p int")
    amounts = frame([(1, 10), (4, 1), (4, 2), (3, 5), (77, 100), (None, 3)], "n int, v long")
    assert rows_of(roll_up(nodes, "n", "p", amounts, "v")) == [(1, 10, 18, 3), (2, 0, 0, 0), (3, 5, 8, 1), (4, 3, 3, 0), (5, 0, 0, 0)]
    assert roll_up(nodes.limit(0), "n", "p", amounts, "v").count() == 0
    chain = frame([(n, n - 1) for n in range(20)], "n int, p int")
    assert ancestors(chain, "n", "p").count() == 210
    with pytest.raises(ValueError, match="cycle"):
        ancestors(frame([(1, 2), (2, 1)], "n int, p int"), "n", "p", most_levels=5)


def test_upserts_survive_restarts_and_repeated_batches(spark, tmp_path):
    schema = "k int, v int, t string"
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def load(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        upsert_available(spark.readStream.schema(schema).json(source), target, progress, ["k"], ["v"])
        return rows_of(current(spark, target, ["k"], ["v"]).select("k", "v", "t"))

    assert load([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]) == [(1, 2, "b"), (2, 1, "c")]
    assert load([(1, 1, "late"), (2, 3, "d"), (3, 1, "e")]) == [(1, 2, "b"), (2, 3, "d"), (3, 1, "e")]
    # A run that lost its progress loads all files again, into the same folders.
    again = str(tmp_path / "progress-2")
    upsert_available(spark.readStream.schema(schema).json(source), target, again, ["k"], ["v"])
    assert rows_of(current(spark, target, ["k"], ["v"]).select("k", "v", "t")) == [(1, 2, "b"), (2, 3, "d"), (3, 1, "e")]
