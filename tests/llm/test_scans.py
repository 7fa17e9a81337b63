"""License scan and token counts against plain versions and the public tokenizer."""

import random
import re

import pytest

from tidemark.llm import license_scan as L
from tidemark.llm import token_count as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_base_places_match_brute_force():
    rng = random.Random(2)
    pieces = ["GNU", "general", "Public", "license", "apache", "cc", "by", "mit", "MIT", " ", " ", ", ", "\n", "-", "é", "BY-NC 4.0"]
    phrases = [(p.split(), label) for p, label in L.BASE.items()]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        words = WORD.findall(lowered(text))
        places = [(k, label) for k in range(len(words)) for p, label in phrases if words[k:k + len(p)] == p]
        found = L.scan(text.encode())
        assert found.n_words == len(words) and sorted(found.base) == sorted(places)


@pytest.mark.parametrize("expression,labels,duty", [
    ("MIT", {"mit"}, L.PERMISSIVE),
    ("MIT OR GPL-3.0-only", {"mit", "gpl"}, L.PERMISSIVE),
    ("MIT AND GPL-3.0-only", {"mit", "gpl"}, L.STRONG),
    ("MIT OR Apache-2.0 AND GPL-2.0", {"mit", "apache", "gpl"}, L.PERMISSIVE),
    ("(MIT OR Apache-2.0) AND GPL-2.0", {"mit", "apache", "gpl"}, L.STRONG),
    ("GPL-2.0-or-later WITH Classpath-exception-2.0", {"gpl"}, L.WEAK),
    ("mit and gpl-2.0 with x or lgpl-2.1", {"mit", "gpl", "lgpl"}, L.WEAK),
    ("Apache-2.0 */", {"apache"}, L.PERMISSIVE),
    ("MIT some words", {"mit"}, L.PERMISSIVE),
    ("LicenseRef-x", {"licenseref-x"}, L.UNKNOWN),
])
def test_expressions(expression, labels, duty):
    assert L.evaluate(expression) == L.Licence(frozenset(labels), duty)


@pytest.mark.parametrize("expression", ["", "AND MIT", "MIT OR", "(MIT", "()", "MIT AND (", ") MIT"])
def test_unsound_expressions(expression):
    assert L.evaluate(expression) is None


def test_license_rows(spark):
    rows = [(1, "Released under the MIT License. (cc-by) mit license"), (2, None), (None, ""),
            (3, "// SPDX-License-Identifier: MIT OR GPL-2.0\ncode"), (4, "spdx-license-identifier: AND"), (4, "nothing é")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, labels string")
    got = sorted(map(tuple, L.scan_licenses(docs).collect()), key=repr)
    assert got == sorted([
        (1, 9, 3, 3, 7, "cc-by,mit", "cc-by,mit", 0.9, None), (2, 0, 0, None, None, "", "", 0.0, None),
        (None, 0, 0, None, None, "", "", 0.0, None), (3, 9, 0, None, None, "", "gpl,mit", 1.0, "permissive"),
        (4, 4, 0, None, None, "", "", 0.3, None), (4, 2, 0, None, None, "", "", 0.0, None)], key=repr)
    assert L.scan_licenses(docs.limit(0)).count() == 0


def reference(vocabulary, byte_fallback):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    t = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = Metaspace(replacement=T.MARK, prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def texts(rng, letters, n):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("whole", [False, True])
def test_small_vocabularies_match_the_tokenizer(byte_fallback, whole):
    rng = random.Random(9)
    for _ in range(25):
        pieces = {"<unk>", T.MARK, "aa", "ab", T.MARK + "a", "aba"} | {
            "".join(rng.choice("abcé" + T.MARK) for _ in range(rng.randint(1, 4))) for _ in range(12)}
        # Few different scores, so that ties are common.
        vocabulary = [(p, float(-rng.randint(1, 4)) if whole else -rng.choice([0.5, 1.25, 2.75]))
                      for p in sorted(pieces, key=lambda p: (p != "<unk>", p))]
        if byte_fallback:
            vocabulary += [(f"<0x{b:02X}>", -5.0) for b in range(256)]
        model, count = T.Unigram(vocabulary, byte_fallback), reference(vocabulary, byte_fallback)
        for text in texts(rng, "aabbcé zß\n" + T.MARK, 60):
            assert model.tokens(text) == count(text), (text, vocabulary)


def test_public_vocabulary(spark):
    vocabulary, byte_fallback = T.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    count = reference(vocabulary, byte_fallback)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(150).select("doc_id", "text")
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "  two  blanks \n\n日本 \x00"), (-2, "x" * 3000)], docs.schema)
    docs = docs.union(odd).withColumnRenamed("doc_id", "n_tokens").selectExpr("n_tokens as doc_id", "text", "1 as n_tokens")
    text = {r.doc_id: r.text for r in docs.where("doc_id <> -2 or doc_id is null").collect()}
    got = T.count_tokens(docs, vocabulary, byte_fallback).collect()
    assert len(got) == 154
    for r in got:
        if r.doc_id != -2:
            assert (r.n_tokens, r.n_chars) == (count(text[r.doc_id] or ""), len(text[r.doc_id] or ""))
    assert sorted(r.n_tokens for r in got if r.doc_id == -2) == sorted(
        count(t) for t in ("  two  blanks \n\n日本 \x00", "x" * 3000))


def whole_reference(vocabulary, byte_fallback):
    from tokenizers import Tokenizer
    from tokenizers.models import Unigram
    from tokenizers.pre_tokenizers import Metaspace

    t = Tokenizer(Unigram(vocabulary, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = Metaspace(replacement=T.MARK, prepend_scheme="always", split=False)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("runs", [False, True])
def test_whole_texts_match_the_tokenizer(byte_fallback, whole, runs):
    rng = random.Random(10)
    for _ in range(25):
        pieces = {"<unk>", "aa", "ab", T.MARK + "a", "aba", T.MARK * 2, T.MARK * 3, T.MARK * 4}
        pieces |= {T.MARK} if rng.random() < 0.7 else set()
        for _ in range(12):
            piece = "".join(rng.choice("abcé" + T.MARK) for _ in range(rng.randint(1, 4)))
            pieces.add(T.MARK * rng.randint(0, 2) + piece.replace(T.MARK, "") if runs else piece)
        vocabulary = [(p, float(-rng.randint(1, 4)) if whole else -rng.choice([0.5, 1.25, 2.75]))
                      for p in sorted(pieces - {""}, key=lambda p: (p != "<unk>", p))]
        if byte_fallback:
            vocabulary += [(f"<0x{b:02X}>", -5.0) for b in range(256)]
        model, count = T.Unigram(vocabulary, byte_fallback, split=False), whole_reference(vocabulary, byte_fallback)
        for text in texts(rng, "aabbcé    zß\n" + T.MARK, 60):
            assert model.tokens(text) == count(text), (text, vocabulary)


def test_blank_runs_with_the_public_vocabulary(spark):
    vocabulary, byte_fallback = T.read_vocabulary("/opt/tokenizers/piece_bpe_32k.model")
    count = whole_reference(vocabulary, byte_fallback)
    odd = ["def f():\n        return x", "a" + " " * 40 + "b", "  two  blanks \n\n日本 \x00", "   ", "| a   |    b |\n" * 30]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in T.count_tokens(docs, vocabulary, byte_fallback, split=False).collect()}
    assert got == {i: count(t) for i, t in enumerate(odd)}
    assert got[0] < T.Unigram(vocabulary, byte_fallback).tokens(odd[0])
