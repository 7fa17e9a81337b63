"""Words and hashes against regular expressions; components against union-find."""

import random
import re

import pyarrow as pa
import pytest

from tidemark.llm import words as W
from tidemark.llm.graph import components

PATTERNS = [(W.SPACED, rb"[^\x20\x09-\x0D]+"), (W.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")]


@pytest.mark.parametrize("segment", [16, 1 << 15])
def test_words_match_patterns(monkeypatch, segment):
    monkeypatch.setattr(W, "SEGMENT", segment)
    rng = random.Random(3)
    for n in range(120):
        texts = [None if rng.random() < 0.1 else
                 "".join(rng.choice("aBé \n\t.9_-") for _ in range(rng.choice([0, 1, 3, 40, 90])))
                 for _ in range(rng.randint(0, 6))] + ["x" * 100] * (n % 2)
        column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
        for table, pattern in PATTERNS:
            words = W.words_of(column, table)
            seen = {}
            for i, t in enumerate(texts):
                part = words.of(i)
                found = [bytes(words.buffer[a:b]).lower() for a, b in zip(words.start[part], words.end[part], strict=True)]
                assert found == re.findall(pattern, (t or "").encode().lower())
                for word, h in zip(found, words.hash[part], strict=True):
                    assert seen.setdefault(word, h) == h
            assert len(set(seen.values())) == len(seen)


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"t": pa.array([b"x" * n for n in (3, 0, 9, 50, 1, 1)] + [None], pa.binary())})
    parts = list(W.in_slices(iter([batch, batch.slice(0, 0)]), "t", 12))
    assert [p.num_rows for p in parts] == [3, 1, 3]
    assert [v for p in parts for v in p.column("t").to_pylist()] == batch.column("t").to_pylist()
    assert [len(W.words_of(p.column("t"))) for p in parts] == [3, 1, 3]


def test_case_kept_or_not():
    column = pa.array([b"Word word WORD"], pa.binary())
    assert len(set(W.words_of(column, W.SPACED).hash)) == 1
    assert len(set(W.words_of(column, W.EXACT).hash)) == 3


def test_sliced_column_and_windows():
    column = pa.array([b"drop this", b"one Two three", b"two THREE one"], pa.binary()).slice(1)
    words = W.words_of(column)
    a, b = W.windows(words.hash[words.of(0)], 2), W.windows(words.hash[words.of(1)], 2)
    assert a[1] == b[0] and a[0] != b[1]
    assert len(W.windows(words.hash[words.of(0)], 4)) == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(n, n + 1) for n in range(300, 340)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: root(n) for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
