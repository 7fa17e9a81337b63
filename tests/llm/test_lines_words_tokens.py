"""Line dedup, spelling variants and token alignment against plain versions."""

import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import pytest
from tidemark.llm import line_dedup as L
from tidemark.llm import spelling as S
from tidemark.llm import token_alignment as T
from tidemark.llm.queries import TOKENIZERS

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, line string, h long, word string, n long"


def table(spark, rows):
    """Rows of id and text with columns of names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)


def plain_lines(rows, least_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    keeper = {k: max(x for x in ids if x is not None) for k, ids in holders.items() if len(ids) >= least_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(3)
    pool = [f"Shared line number {k} of the pool, ÄÖ {k}" for k in range(12)] + ["short", "", "  ", "\t  exactly twenty chars\r"]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own line {i} {k} with enough characters" for k in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.3 and "Ä" not in x else x for x in lines)))
    shared = pool[0]
    return rows + [(None, None), (None, shared), (None, shared + "\nrest"), (70, ""), (71, None), (72, shared + "\n" + shared), (72, shared + "\n" + shared),
                   (72, "other text\n" + pool[1]), (73, "\n\n"), (5, shared), (74, "z" * 2_000_000 + "\n" + pool[1]), (75, "\n".join([pool[2]] * 20_000))]


def test_lines_match_the_plain_version(spark):
    rows = line_rows()
    got = L.dedup_lines(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_lines(rows)


def test_lines_by_shuffle_joins(spark, monkeypatch):
    monkeypatch.setattr(L, "small", lambda df: df)
    rows = line_rows()[:-2]
    got = L.dedup_lines(table(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_lines(rows)


def test_lines_stay_native_and_empty_table(spark):
    plan = L.dedup_lines(table(spark, line_rows()[:5]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert L.dedup_lines(table(spark, [])).count() == 0


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def plain_variants(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    form, near = {}, {}
    for w in n:
        others = [x for x in n if one_apart(w, x)]
        near[w] = len(others)
        best = min(((-n[x], x) for x in others), default=None)
        form[w] = best[1] if best and n[best[1]] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], near[w], n[form[w]] if form[w] else None) for w in n), key=repr)


def word_rows():
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeèéÀÿ÷nort") for _ in range(rng.randint(4, 11))) for _ in range(60)]
    base += ["a" * 40, "a" * 41, "a" * 39 + "b", "b" + "a" * 39, "ab" * 20, "x" * 31, "x" * 32, "x" * 30 + "y", "L" + "ong" * 50_000, "L" + "ong" * 49_999 + "onk"]
    rows = []
    for i in range(300):
        words = []
        for w in rng.choices(base, weights=[1 / (k + 1) for k in range(len(base) - 2)] + [0.003] * 2, k=20):
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1:], w[:at] + rng.choice("aeé") + w[at:], w[:at] + rng.choice("otn") + w[at + 1:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, " ".join(words)))
    rows += [(600 + k, w) for k, w in enumerate(["plainword"] * 40 + ["plainwords"] * 12 + ["plainwordsy"] * 5)]
    return rows + [(None, "Three three THREE trees trees trees"), (None, None), (500, ""), (500, "12 34"), (7, rows[7][1]), (7, rows[7][1])]


def variants(spark, rows):
    got = S.spelling_variants(table(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_variants_match_all_pairs(spark):
    rows = word_rows()
    expected = plain_variants(rows)
    assert sum(r[1] is not None for r in expected) > 50 and any(r[1] != r[2] for r in expected if r[1])
    assert variants(spark, rows) == expected


def test_variants_in_small_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 2), ("QUERIES", 3), ("LEAF", 1), ("CHUNK", 5)):
        monkeypatch.setattr(S, name, value)
    rows = word_rows()
    assert variants(spark, rows) == plain_variants(rows)


def test_no_words(spark):
    assert S.spelling_variants(table(spark, [])).count() == 0
    assert S.spelling_variants(table(spark, [(1, "a b"), (2, None)])).count() == 0


@pytest.fixture(scope="module")
def files():
    return T.Files.read(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")


def plain_alignment(tools, text):
    """Ids of the whole text at once, ends from decoded bytes: (n_a, n_b, links, groups)."""
    nothing = (0, 0, [], "")
    if not text:
        return nothing
    a, b = tools.a.encode(" " + text, add_special_tokens=False).ids, tools.b.encode(text)
    ends = []
    for ids, spelled in ((a, tools.bytes_a), (b, tools.bytes_b)):
        if b"".join(spelled[i] for i in ids) != (" " + text).encode():
            return nothing
        at, out = 0, {}
        for k, i in enumerate(ids):
            at += len(spelled[i])
            out[at] = k
        ends.append(out)
    groups, links, i, j = [], [], 0, 0
    for e in sorted(ends[0].keys() & ends[1].keys()):
        k, m = ends[0][e], ends[1][e]
        links.append((a[k], b[m]))
        groups.append(",".join(map(str, a[i:k + 1])) + "|" + ",".join(map(str, b[j:m + 1])))
        i, j = k + 1, m + 1
    return len(a), len(b), links, ";".join(groups)


def token_rows():
    rng = random.Random(5)
    marks = [*"abcdeth ing  \n\t  .,'s\x1c\x85   éüß漢字🎉𝄞1234", "<|endoftext|>", "<s>", "'s", " 're", "▁", "<0x0A>", "\r\n", "\x00", "ﬁ", "\u0301",
             "\ufeff", "\u200b", "<unk>", "\u3000", "\xa0"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    return rows + [(900, None), (901, ""), (902, " "), (903, "  "), (904, "x "), (905, "same text, same text"), (905, "same text, same text"), (None, "no id here"),
                   (906, "long 漢字 text\n" * 30_000), (907, "x" * 100_000), (908, "mark ▁ inside"), (909, "<|endoftext|>")]


def check_alignment(spark, files):
    rows = token_rows()
    tools = T.Aligner(files)
    plain = [(i, *plain_alignment(tools, t)) for i, t in rows]
    count = Counter(x for r in plain for x in r[3])
    most = {}
    for (_, b), k in count.items():
        most[b] = max(most.get(b, 0), k)
    expected = [(i, a, b, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links),
                 sha256(groups.encode()).hexdigest() if groups else "") for i, a, b, links, groups in plain]
    got = T.align_corpus(table(spark, rows), files)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(expected, key=repr)


def test_alignment_matches_whole_texts(spark, files):
    check_alignment(spark, files)


def test_alignment_in_small_steps(spark, files, monkeypatch):
    for name, value in (("STEP", 7), ("CHUNK", 20), ("KEPT", 30)):
        monkeypatch.setattr(T, name, value)
    tools = T.Parts(T.Aligner(files))
    for _, text in token_rows()[:300]:
        rows = T.Aligned(tools)
        rows.add(text)
        n_a, n_b, links, groups = plain_alignment(tools.aligner, text)
        assert (rows.n_a, rows.n_b, rows.digest) == ([n_a], [n_b], [sha256(groups.encode()).hexdigest() if groups else ""])
        assert [(x >> T.SHIFT, x & ((1 << T.SHIFT) - 1)) for x in rows.links[0].tolist()] == links


def test_alignment_counts_by_a_shuffle_join(spark, files, monkeypatch):
    monkeypatch.setattr(T, "small", lambda df, most: df)
    check_alignment(spark, files)


def test_alignment_of_no_texts(spark, files):
    assert T.align_corpus(table(spark, []), files).count() == 0
    row = T.align_corpus(table(spark, [(1, None)]), files).first()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "")
