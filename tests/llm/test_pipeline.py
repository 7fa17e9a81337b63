"""The pipeline's stages against plain versions, on a small table with planted rows."""

import re

import corpus_pipeline
import pytest
from test_dedup import groups
from tidemark.llm import mixing
from tidemark.llm.queries import QUERIES, SQL
from tidemark.llm.secret_scan import scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows after each stage."""
    sf = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").select(COLUMNS)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    item = items.where("length(text) > 150").first().text
    first = docs.where("doc_id = 1").first().text
    odd = [(5000, None, "en", "s", 0), (5001, "12 34", None, None, 5), (5002, first, "en", "s", 9), (5002, first, "en", "s", 9),
           (5003, f"Intro words. {item.upper()} end.", "en", "s", 9), (None, "password = hunter2hunter2 and the thing", None, "s", 9),
           (5004, "Nous avons le secret: abcdefgh1234 pour vous.", "fr", None, 9)]
    docs.union(spark.createDataFrame(odd, docs.schema)).coalesce(3).write.parquet(str(sf / "documents.parquet"))
    items.write.parquet(str(sf / "benchmark.parquet"))
    rows = spark.read.parquet(str(sf / "documents.parquet"))
    out = [rows]
    for name, step in corpus_pipeline.STAGES:
        rows = step(spark, rows, str(sf))
        path = str(sf / name.replace(" ", "-"))
        rows.write.parquet(path)
        rows = spark.read.parquet(path)
        out.append(rows)
    return out, [r.text for r in items.collect()]


def test_order_and_columns(stages):
    out, _ = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "secrets", "mixing"]
    for rows in out[:-1]:
        assert rows.columns == COLUMNS


def test_language_rejects_texts_without_letters_only(stages):
    out, _ = stages
    before, after = (sorted(((r.doc_id or -1), r.text or "") for r in out[k].collect()) for k in (0, 1))
    assert after == [r for r in before if any(map(str.isalpha, r[1]))]


def test_one_row_of_a_group_stays(stages):
    out, _ = stages
    rows = [(r.doc_id, r.text) for r in out[1].collect()]
    sizes, root = groups(rows, 5)
    least = {}
    for (i, text), (n, _), g in zip(rows, sizes, root, strict=True):
        if n:
            row = (i is None, i or 0, text)
            least[g] = min(least.get(g, row), row)
    kept = sorted((r.doc_id or 0, r.text) for r in out[2].collect())
    assert kept == sorted((i, text) for _, i, text in least.values())


def test_contaminated_rows_go(stages):
    out, items = stages
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def shingles(text):
        w = word.findall(text.casefold())
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)}

    sets = [s for s in map(shingles, items) if s]
    rows = out[2].collect()
    clean = [r for r in rows if not any(5 * len(s & shingles(r.text)) >= 4 * len(s) for s in sets)]
    assert sorted(r.text for r in out[3].collect()) == sorted(r.text for r in clean)
    assert 5003 in {r.doc_id for r in rows} - {r.doc_id for r in clean}


def test_secrets_are_replaced(stages):
    out, _ = stages
    before = {(r.doc_id, r.lang): r for r in out[3].collect()}
    after = out[4].collect()
    assert len(after) == out[3].count()
    for r in after:
        assert r.n_chars == len(r.text) and not scan(r.text).base
        if not scan(before[r.doc_id, r.lang].text).every:
            assert r.text == before[r.doc_id, r.lang].text
    assert any(r.text.startswith("[assign]") for r in after if r.doc_id is None)


def test_mixing_keeps_the_drawn_rows(stages):
    out, _ = stages
    drawn = mixing.mix_sources(out[4]).where("sampled").collect()
    assert sorted((r.doc_id or -1, r.probability, r.n_tokens) for r in out[5].collect()) == sorted(
        (r.doc_id or -1, r.probability, r.n_tokens) for r in drawn)


def test_registered():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(SQL) <= set(QUERIES)
