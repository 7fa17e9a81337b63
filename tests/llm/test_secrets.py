"""Secrets: base patterns against plain regular expressions, layers against planted ones."""

import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from hashlib import sha256
from urllib.parse import quote

import pytest

from tidemark.llm import secret_scan as S

PLAIN = 'password = "hunter2hunter2" end'
KEY = "AKIA" + "ABCDEFGH12345678"


def brute(text):
    """Base spans by the patterns as stated."""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text,
                         re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_matches_brute_force():
    rng = random.Random(4)
    pieces = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", " ", "=", ":", '"', "'", "  = ", "é", "abcd1234",
              "x" * 9, "AKIA", "ABCD1234", "0123456789abcdef", "f" * 31, "\n", "ſ", "K", "-", "%%%", "&&&"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        found = S.scan(text)
        expected = [(a, b, S.KINDS[k]) for a, k, b in brute(text)]
        assert found.base == sorted(expected, key=lambda s: (s[0], S.KINDS.index(s[2])))
        assert set(found.base) <= set(found.every)


def b64(raw):
    return base64.b64encode(raw).decode()


@pytest.mark.parametrize("wrap", [
    lambda s: b64(s.encode()), lambda s: b64(gzip.compress(s.encode())), lambda s: b64(zlib.compress(s.encode())),
    lambda s: b64(bz2.compress(s.encode())), lambda s: b64(lzma.compress(s.encode())),
    lambda s: b64(b64(s.encode()).encode()), lambda s: b64(gzip.compress(b64(s.encode()).encode())),
    lambda s: quote(s, safe=""), lambda s: quote(quote(s, safe=""), safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: b64(quote(s, safe="").encode()), lambda s: quote(b64(gzip.compress(s.encode())), safe=""),
    lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
])
def test_layers_are_opened_and_mapped(wrap):
    inner = f"{PLAIN} {KEY}"
    coded = wrap(inner)
    text = f"Größe vor. {coded} danach."
    found = S.scan(text)
    start = text.index(coded)
    kinds = {k for _, _, k in found.every}
    assert {"assign", "access"} <= kinds and "assign" not in {k for _, _, k in found.base}
    assert all(start <= a < b <= start + len(coded) for a, b, _ in found.every)


def test_partly_escaped_text_maps_by_character():
    text = "see p%61ssword%3Dhunter2hunter2 there"
    assert S.scan(text).every == [(text.index("p%61"), text.index(" there"), "assign")]
    assert S.redacted(text) == "see [assign] there"


def test_broken_lines_and_large_layers():
    coded = b64((PLAIN * 5).encode())
    text = "\n".join(coded[i:i + 40] for i in range(0, len(coded), 40))
    assert any(k == "assign" for _, _, k in S.scan(text).every)
    packed = b64(zlib.compress(b"a" * 100_000 + PLAIN.encode()))
    assert S.scan(packed, limit=1000).unopened == 1 and S.scan(packed).every


def wrapped(coded, width):
    return "\n".join(coded[i:i + width] for i in range(0, len(coded), width))


@pytest.mark.parametrize("before,after", [("", ""), ("Key\n", "\nof the end"), ("see ", " end"), ("-----BEGIN DATA-----\n", "")])
@pytest.mark.parametrize("width", [10, 64, 76])
def test_every_tail_of_wrapped_base64(width, before, after):
    for n in range(150, 150 + 3 * width):
        inner = "." * (n - 14) + "token=Ab3dE6gH"
        coded = wrapped(b64(inner.encode()), width)
        place = [i for i, c in enumerate(coded) if c not in "\n="]
        span = (len(before) + place[(n - 14) // 3 * 4], len(before) + place[-1] + 1, "assign")
        assert S.scan(before + coded + after).every == [span], (n, before + coded + after)


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_short_last_line_of_a_packed_layer(pack):
    rng = random.Random(3)
    for n in range(60):
        coded = wrapped(b64(pack((f"{rng.random()} " * n + PLAIN).encode())), 76)
        assert S.scan(f"a {coded}").every == [(2, 2 + len(coded), "assign")]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zlib.compress])
def test_all_members_are_opened(pack):
    for more in (b"", b"\0\0\0\0"):
        coded = b64(pack(b"nothing here ") + more + pack(f" {KEY} ".encode()) + pack(PLAIN.encode()))
        assert {k for _, _, k in S.scan(coded).every} >= {"access", "assign"}
        assert S.scan(f"a {coded} b").every[0][:2] == (2, 2 + len(coded))


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress])
def test_layers_beyond_the_bound_are_read(pack, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 4000)
    for at in range(0, 12_000, 397):
        for secret in (PLAIN, b64(gzip.compress(PLAIN.encode())), quote(PLAIN, safe="")):
            inner = ("word " * 6000)[:at] + f" {secret} " + "word " * 3000
            coded = b64(pack(pack(inner.encode())))
            found = S.scan(f"a {coded} b", limit=5000)
            assert found.every == [(2, 2 + len(coded), "assign")] and found.unopened >= 1
    monkeypatch.undo()
    assert S.redacted(b64(gzip.compress(b"a " * (18 << 20) + PLAIN.encode()))) == "[assign]"


def test_short_runs():
    assert S.scan("dG9rZW49QWIzZEU2Z0g=").every == [(0, 19, "assign")]
    assert S.scan("x dG9rZW49QWIzZEU2Z0g y").every == [(2, 21, "assign")]
    assert S.scan(b64(zlib.compress(b"0" * 32))).every


def test_ends_on_junk():
    for text in ("%%%41%41%2541", "A" * 5000, "\\u0041" * 1000, "&#0;&#x110000;\\ud800", "%ff%fe", "x" * 200_000):
        assert S.scan(text).layers >= 1


def test_rows(spark):
    rows = [(1, PLAIN, 5), (1, PLAIN, 5), (2, None, 5), (3, "", 5), (None, f"é {KEY}", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    got = {(r.doc_id, r.spans, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in S.scan_secrets(docs).collect()}
    none = sha256(b"").hexdigest()
    assert got == {(1, "assign:0:26", 1, 0, 0, sha256(b"assign:0:26").hexdigest()), (2, "", 0, 0, 0, none),
                   (3, "", 0, 0, 0, none), (None, "access:2:22", 0, 1, 0, sha256(b"access:2:22").hexdigest())}
    out = S.redact_secrets(docs)
    assert out.columns == docs.columns and [r.text for r in out.where("doc_id = 1").collect()] == ['[assign]" end'] * 2
    assert S.scan_secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["utf-8", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "latin-1"])
@pytest.mark.parametrize("before,after", [("", ""), ("né à ", " fin é"), ("x", " tail")])
@pytest.mark.parametrize("packed", [False, True])
def test_layers_in_other_encodings_are_read(name, before, after, packed):
    """A secret is found in any of them, at the letters that hold its bytes."""
    secret = "password=Ab3dE6gH9kL2"
    raw = (before + secret + after).encode(name)
    coded = b64(gzip.compress(raw) if packed else raw)
    text = f"see {coded} end"
    found = [(a, b) for a, b, kind in S.scan(text).every if kind == "assign"]
    assert len(found) == 1
    a, b = found[0]
    if packed:
        assert (a, b) == (4, 4 + len(coded))
        return
    low = len(before.encode(name))  # the mark included, where the encoding writes one
    high = len((before + secret).encode(name))
    assert (a, b) == (4 + low // 3 * 4, 4 + min((high - 1) // 3 * 4 + 4, len(coded.rstrip("="))))


def test_bytes_at_random_are_no_text():
    rng = random.Random(8)
    for n in (60, 300, 5000):
        assert S._readable(bytes(rng.randrange(256) for _ in range(n))) is None
    assert S._readable(b"") is None and S._readable("é".encode("latin-1"))[0] == "é"


def test_large_layers_are_read_by_the_same_rule(monkeypatch):
    """Latin-1 and UTF-16 beyond the bound, as below it."""
    line = "été password=Ab3dE6gH9kL2 là\n"
    for name in ("latin-1", "utf-16-le"):
        coded = b64(gzip.compress((line * 3000).encode(name)))
        small = S.scan(coded)
        large = S.scan(coded, limit=10_000)
        assert {s[2] for s in small.every} == {s[2] for s in large.every} == {"assign"}
