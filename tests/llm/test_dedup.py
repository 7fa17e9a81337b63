"""Near-duplicate groups against all pairs."""

import random

import numpy as np

import corpus_pipeline
from tidemark.llm import near_dedup as N


def groups(rows, width=2):
    """(n, component) by row, by comparing the sets of `width` words of every pair."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[root(i)] = min(id_, least.get(root(i), id_))
    return [(len(s), least.get(root(i))) for i, s in enumerate(sets)], [root(i) for i in range(len(rows))]


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(400)]
    rows, n = [], 100
    for size in (1, 2, 3, 8, 40, 40):
        for _ in range(4):
            base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 90))]
            for _ in range(size):
                copy = [w if rng.random() > rng.choice([0, 0.02, 0.05, 0.1]) else rng.choice(vocabulary) for w in base]
                rows.append((n, " ".join(copy)))
                n -= 1
    return rows + [(None, "a b c d e"), (500, "A  b\tc d\ne"), (None, "lone pair here"), (501, None), (502, " \n"),
                   (503, ""), (504, "one"), (505, "ONE"), (505, "ONE"), (506, "two two two"), (None, None), (507, "x y")]


def test_matches_all_pairs(spark):
    rows = corpus()
    expected, _ = groups(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, id long")
    got = N.near_duplicates(docs).collect()
    key = repr
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(
        ((i, n, i if n == 0 else c) for (i, _), (n, c) in zip(rows, expected, strict=True)), key=key)
    for r in got:
        assert r.kept == (None if r.component_id is None else r.doc_id == r.component_id)


def test_one_of_each_keeps_one_row_of_a_group(spark):
    rows = corpus()
    expected, root = groups(rows)
    docs = spark.createDataFrame([(*r, "x", k) for k, r in enumerate(rows)],
                                 "doc_id long, text string, `a.b` string, text_hash long")
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    groups_left = [root[r.text_hash] for r in kept if expected[r.text_hash][0]]
    assert sorted(groups_left) == sorted({g for g, (n, _) in zip(root, expected, strict=True) if n})
    assert sum(not expected[r.text_hash][0] for r in kept) == sum(not n for n, _ in expected)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(docs).count() == 0
    assert N.one_of_each(docs).count() == 0


def test_posterior_bound():
    needed = N.least_matches(0.8, 1e-5)
    assert len(needed) == 10 and all(np.diff(needed) > 0)
    # A pair at the threshold passes, one far below it goes.
    rng = np.random.default_rng(1)
    left = rng.integers(0, 256, (2000, N.HASHES), dtype=np.uint8)
    for share, least, most in ((0.8, 1999, 2000), (0.55, 0, 20)):
        right = np.where(rng.random(left.shape) < share, left, rng.integers(0, 256, left.shape, dtype=np.uint8))
        every = np.arange(2000)
        assert least <= len(N.survivors(left, right, every, every)) <= most


def test_blocks_join_what_centres_miss(spark, monkeypatch):
    """With blocks of a few members the result is the same."""
    monkeypatch.setattr(N, "BLOCK", 3)
    test_matches_all_pairs(spark)


def test_width_of_shingles(spark):
    words = [f"w{k}" for k in range(1000)]
    spread = [f"x{k}" if k % 25 == 0 else w for k, w in enumerate(words)]  # 4% of the words
    near = ["y" if k == 500 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(spread)), (3, " ".join(near)), (4, "a b c"), (5, "A  b c"),
                                  (6, "a b d")], "doc_id long, text string")
    assert {r.doc_id for r in N.one_of_each(docs).collect()} == {1, 4, 6}
    assert {r.doc_id for r in N.one_of_each(docs, width=5).collect()} == {1, 2, 4, 6}
    assert {r.doc_id for r in corpus_pipeline.remove_near_duplicates(spark, docs, "").collect()} == {1, 2, 4, 6}
