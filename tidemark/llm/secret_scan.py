"""Secret scan with a worklist of decoded layers.

The text is the first layer. Each layer is searched for secrets; then URL escapes
and character escapes are undone over the layer as a whole, and base64 runs are
decoded and, where the bytes are compressed, unpacked. Every result is a new
layer, until no layer gives one that the text has not had (layers are known by a
digest, so a layer that decodes to itself or to an earlier one ends there). Each
character of a layer knows the range of the original text it came from; what is
found in a layer is reported at that range.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import in_slices

KINDS = ("assign", "access", "hex")
# A layer that unpacks to more bytes than this is counted and read in overlapping pieces.
LAYER_BYTES = 32 << 20
PIECE = 4 << 20  # characters
XZ_BYTES = 256 << 20  # memory of an xz dictionary
_CHUNK = 1 << 20
_BREAKS = " \t,()<>|!?*[]@$^~`"  # no encoded run holds these

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HINTS = ("passw", "secret", "token", "api")

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}"
                     r"|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
# 15 letters are the fewest that hold a secret: zlib of 32 equal hex digits; 19 hold a plain one.
_FEWEST = 15
_BASE64 = re.compile(rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-](?:(?:\r?\n)?[A-Za-z0-9+/_-]){{{_FEWEST - 1}}})"
                     r"[A-Za-z0-9+/_-]+(?:\r?\n[A-Za-z0-9+/_-]+)*(?:(?:\r?\n)?=){0,2}")
_LONG = 20  # a word of prose is rarely as long
_LINE = re.compile(r"[^\r\n]+")


@dataclass
class Layer:
    """A text and, for each character, the range of the original it came from (None: itself)."""

    text: str
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.low is None:
            return start, end
        return int(self.low[start:end].min()), int(self.high[start:end].max())

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        if self.low is None:
            place = np.arange(len(self.text))
            return place, place + 1
        return self.low, self.high


def find(text: str) -> list[tuple[int, int, str]]:
    """Secrets of one layer as (start, end, kind): leftmost, not overlapping within a kind."""
    found = []
    lowered = text.lower()
    if any(hint in lowered for hint in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def _url(run: str) -> list[tuple[str, int, int]]:
    raw = bytes.fromhex(run.replace("%", ""))
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(text)]
    out, at = [], 0
    for c in text:
        size = 3 * len(c.encode())
        out.append((c, at, at + size))
        at += size
    return out


def _escape(run: str) -> list[tuple[str, int, int]]:
    if run[0] == "&":
        return [(c, 0, len(run)) for c in html.unescape(run)]
    if run[1] == "u" and run[2] != "{":
        out: list[tuple[str, int, int]] = []
        units = [int(run[i + 2:i + 6], 16) for i in range(0, len(run), 6)]
        i = 0
        while i < len(units):
            pair = 0xD800 <= units[i] < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000
            raw = b"".join(u.to_bytes(2, "little") for u in units[i:i + 1 + pair])
            out.append((raw.decode("utf-16-le", "replace"), 6 * i, 6 * (i + 1 + pair)))
            i += 1 + pair
        return out
    code = int(re.sub(r"[^0-9A-Fa-f]", "", run[2:]), 16)
    text = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"
    return [(text, 0, len(run))]


def _undo(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of the pattern decoded in place."""
    parts, low, high, at = [], [], [], 0
    own_low, own_high = layer.ranges()
    for m in pattern.finditer(layer.text):
        parts.append(layer.text[at:m.start()])
        low.append(own_low[at:m.start()])
        high.append(own_high[at:m.start()])
        for text, a, b in decode(m[0]):
            parts.append(text)
            low.append(np.full(len(text), own_low[m.start() + a]))
            high.append(np.full(len(text), own_high[m.start() + b - 1]))
        at = m.end()
    if not low:
        return None
    parts.append(layer.text[at:])
    return Layer("".join(parts), np.concatenate([*low, own_low[at:]]), np.concatenate([*high, own_high[at:]]))


class TooLarge(Exception):
    """A compressed layer would exceed the bound."""


def _opener(raw: bytes):
    """A decompressor for the gzip, zlib, bz2 or xz stream that starts here, or None."""
    if raw[:2] == b"\x1f\x8b" or (len(raw) > 2 and raw[0] == 0x78 and int.from_bytes(raw[:2], "big") % 31 == 0):
        return zlib.decompressobj(47)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if raw[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_BYTES)
    return None


def _members(source: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of all streams that follow each other; ValueError if the first is unsound."""
    data, first = b"", True
    while True:
        while len(data) < 6 and (more := next(source, None)) is not None:
            data = (data + more) if first else (data + more).lstrip(b"\0")
        opener = _opener(data)
        if opener is None:
            return
        try:
            while not opener.eof:
                if not data and getattr(opener, "needs_input", True):
                    data = next(source, None)
                    if data is None:  # cut off
                        if rest := getattr(opener, "flush", bytes)():
                            yield rest
                        return
                out = opener.decompress(data, _CHUNK)
                data = getattr(opener, "unconsumed_tail", b"")
                if out:
                    yield out
        except (zlib.error, OSError, EOFError, lzma.LZMAError) as e:
            if first:
                raise ValueError from e
            return
        data, first = opener.unused_data.lstrip(b"\0"), False


def _unpack(raw: bytes, limit: int) -> bytes | None:
    """The bytes inside gzip, zlib, bz2 or xz streams; None if there is no such stream."""
    if _opener(raw) is None:
        return None
    parts, size = [], 0
    try:
        for part in _members(iter([raw])):
            parts.append(part)
            size += len(part)
            if size > limit:
                raise TooLarge
    except ValueError:
        return None
    return b"".join(parts)


@dataclass
class Large:
    """A compressed layer beyond the bound, and the range it came from."""

    packed: bytes
    low: int
    high: int

    def chunks(self) -> Iterator[bytes]:
        out, last = _members(iter([self.packed])), None
        while (head := next(out, None)) is not None:
            if _opener(head) is None or head == last:
                return chain([head], out)
            inner, last = _members(chain([head], out)), head
            try:
                out = chain([next(inner)], inner)
            except (ValueError, StopIteration):
                return chain([head], out)
        return iter(())

    def pieces(self, limit: int) -> Iterator[Layer]:
        """Layers that overlap by a quarter and start outside of encoded runs, if these are not beyond the limit."""
        decoder, text = None, ""

        def layer() -> Iterator[Layer]:
            if text and len(_IS_ODD.findall(text)) * 20 <= len(text):
                yield Layer(text, np.broadcast_to(self.low, len(text)), np.broadcast_to(self.high, len(text)))

        try:
            for chunk in self.chunks():
                if decoder is None:
                    name, errors = _lenient(_encoding(chunk))
                    decoder = codecs.getincrementaldecoder(name)(errors)
                text += decoder.decode(chunk).translate(_LATIN)
                while len(text) >= PIECE:
                    least, most = len(text) // 2, len(text) - PIECE // 4
                    at = max(text.rfind(c, least, most) for c in _BREAKS)
                    if at < 0 and len(text) < max(limit, 2 * PIECE):
                        break
                    yield from layer()
                    text = text[at if at > 0 else most:]
        except ValueError:
            pass
        yield from layer()


# Control characters: text holds few of them.
_ODD = [chr(c) for c in range(32) if c not in (9, 10, 12, 13)] + [chr(c) for c in range(0x7F, 0xA0)] + ["\ufffd"]
_IS_ODD = re.compile("[" + re.escape("".join(_ODD)) + "]")
# Bytes outside of UTF-8 are read as Latin-1.
_LATIN = {0xDC00 + b: chr(b) for b in range(0x80, 0x100)}


def _encoding(head: bytes) -> str:
    """UTF-32 or UTF-16 by their mark, or UTF-16 if every other byte is mostly zero; else UTF-8."""
    for mark, name in ((codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"),
                       (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if head.startswith(mark):
            return name
    even, odd = head[0:4096:2], head[1:4096:2]
    if len(odd) >= 4:
        if odd.count(0) * 10 >= len(odd) * 8 and even.count(0) * 10 < len(even):
            return "utf-16-le"
        if even.count(0) * 10 >= len(even) * 8 and odd.count(0) * 10 < len(odd):
            return "utf-16-be"
    return "utf-8"


def _lenient(name: str) -> tuple[str, str]:
    return name, "surrogateescape" if name == "utf-8" else "replace"


def _readable(raw: bytes) -> tuple[str, np.ndarray, bool] | None:
    """The text of some bytes, the bytes of each character and whether all bytes fit its encoding.

    None if it is empty or more than 5% odd.
    """
    name, errors = _lenient(_encoding(raw))
    text = raw.decode(name, errors)
    if not text:
        return None
    if name == "utf-8":
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        escaped = (points >= 0xDC80) & (points <= 0xDCFF)
        sizes = np.where(escaped, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        text, sound = text.translate(_LATIN), not escaped.any()
    else:
        sound = True
        sizes = np.array([len(c.encode(name)) for c in text])
    return None if len(_IS_ODD.findall(text)) * 20 > len(text) else (text, sizes, sound)


def _decoded(run: str) -> bytes | None:
    run = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + "=" * (-len(run) % 4))
    except (binascii.Error, ValueError):
        return None


def _opened(layer: Layer, start: int, end: int, limit: int) -> tuple[Layer | Large, bool] | None:
    """What a base64 run holds, text or text inside compressed layers, and whether it is sound."""
    run = layer.text[start:end]
    places = np.frombuffer(run.encode(), np.uint8)
    letters = np.flatnonzero((places != 10) & (places != 13) & (places != 61))
    raw = _decoded(places[letters].tobytes().decode())
    if not raw:
        return None
    own_low, own_high = layer.ranges()
    low, high = own_low[start:end].min(), own_high[start:end].max()
    packed, inner = raw, None
    try:
        while (inner := _unpack(packed, limit)) is not None and inner != packed:
            packed = inner
    except TooLarge:
        return Large(packed, low, high), True
    if packed is not raw:
        read = _readable(packed)
        if read is None:
            return None
        text = read[0]
        return Layer(text, np.full(len(text), low), np.full(len(text), high)), read[2]
    read = _readable(raw)
    if read is None:
        return None
    text, sizes, sound = read
    stop = np.cumsum(sizes)
    first = (stop - sizes) // 3 * 4
    last = np.minimum((stop - 1) // 3 * 4 + 3, len(letters) - 1)
    return Layer(text, own_low[start + letters[first]], own_high[start + letters[last]]), sound


def _groups(widths: list[int], begun: bool) -> list[tuple[int, int]]:
    """Lines that wrapping at one width gives: equal ones and a shorter last, the first shorter if its line had begun."""
    out, at = [], 0
    while at < len(widths):
        end = at + 1
        width = max(widths[:2]) if at == 0 and begun else widths[at]
        while end < len(widths) and widths[end] == width:
            end += 1
        if end < len(widths) and widths[end] < width:
            end += 1
        out.append((at, end))
        at = end
    return out


def _runs(layer: Layer, m: re.Match, limit: int) -> Iterator[Layer | Large]:
    """What the lines of a match hold, joined as far as they belong together.

    Words alone on a line look like base64 as well, so lines are joined by their
    widths, and a first or last line that does not fit is left out. A reading with
    bytes outside of its encoding counts where no sound one holds any of its lines.
    """
    lines = [(m.start() + k.start(), m.start() + k.end()) for k in _LINE.finditer(m[0])]
    if len(lines) > 1 and not layer.text[lines[-1][0]:lines[-1][1]].strip("="):
        lines.pop()
    widths = [b - a for a, b in lines]
    held, loose = np.zeros(len(lines), bool), []

    def opened(first: int, end: int) -> list[Layer | Large]:
        if first >= end or sum(widths[first:end]) < _FEWEST:
            return []
        out = _opened(layer, lines[first][0], m.end() if end == len(lines) else lines[end - 1][1], limit)
        if out is None:
            return []
        if not out[1]:
            loose.append((first, end, out[0]))
            return []
        held[first:end] = True
        return [out[0]]

    groups = _groups(widths, m.start() > 0 and layer.text[m.start() - 1] not in "\r\n")
    whole = len(groups) == 1 or min(widths) >= _LONG or all(b - a < 3 and widths[a] != widths[b - 1] or b - a == 1
                                                            for a, b in groups)
    out = opened(0, len(lines)) if whole else []
    if not out:
        for a, b in groups:
            inner = (opened(a, b) if len(groups) > 1 else []) or b - a > 1 and (
                opened(a, b - 1) or opened(a + 1, b) or opened(a + 1, b - 1)
                or [x for k in range(a, b) for x in opened(k, k + 1)])
            out += inner or []
    yield from out or (opened(0, len(lines)) if not whole else [])
    for first, end, layer_ in loose:
        if not held[first:end].any():
            held[first:end] = True
            yield layer_


def _inner(layer: Layer, limit: int) -> Iterator[Layer | Large]:
    """Layers one decoding further."""
    text = layer.text
    if "%" in text and (out := _undo(layer, _URL, _url)):
        yield out
    if ("\\" in text or "&#" in text) and (out := _undo(layer, _ESCAPE, _escape)):
        yield out
    for m in _BASE64.finditer(text):
        yield from _runs(layer, m, limit)


@dataclass
class Findings:
    base: list[tuple[int, int, str]]
    every: list[tuple[int, int, str]]
    layers: int
    unopened: int


def _ordered(spans) -> list[tuple[int, int, str]]:
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(text: str | None, limit: int = LAYER_BYTES) -> Findings:
    """Secrets of a text and of all layers inside it, at ranges of the text."""
    work = [Layer(text or "")]
    seen = {blake2b(work[0].text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    base = _ordered(find(work[0].text))
    every, layers, large = set(base), 0, 0

    def walk(work: list[Layer]) -> None:
        nonlocal layers, large
        while work:
            layer = work.pop()
            layers += 1
            if layer.low is not None:
                every.update((*layer.span(a, b), kind) for a, b, kind in find(layer.text))
            for inner in _inner(layer, limit):
                if isinstance(inner, Large):
                    key = blake2b(inner.packed, digest_size=16).digest() + int(inner.low).to_bytes(8, "little")
                    if key not in seen:
                        seen.add(key)
                        large += 1
                        for piece in inner.pieces(limit):
                            walk([piece])
                    continue
                key = blake2b(inner.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                # The same content at another place is another layer; at one place it is a cycle.
                key += int(inner.low[0]).to_bytes(8, "little") if len(inner.text) else b""
                if key not in seen:
                    seen.add(key)
                    work.append(inner)

    walk(work)
    return Findings(base, _ordered(every), layers, large)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers",
                                                "n_unopened")}
        for value in batch.column("text"):
            found = scan(value.as_py())
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in found.base))
            out["base_sha256"].append(sha256(joined(found.base).encode()).hexdigest())
            out["spans"].append(joined(found.every))
            out["n_layers"].append(found.layers)
            out["n_unopened"].append(found.unopened)
        arrays = [pa.array(v, pa.string() if k in ("base_sha256", "spans") else pa.int64()) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *out])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of every whole text, in it and in the layers encoded inside it.

    Returns one row per input row: `doc_id`; `n_assign`, `n_access`, `n_hex`, found
    in the text itself; `base_sha256`, the SHA-256 of these as kind:start:end;
    `spans`, all of them and those of inner layers, in the same form, each range
    once; `n_layers` looked at; `n_unopened`, compressed layers beyond the bound, which are not
    opened as a whole but read in pieces. A
    null or empty text has no spans. Null ids and repeated rows are kept. Places are code points, ends
    exclusive. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan_rows, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                    "n_layers long, n_unopened long")


def redacted(text: str) -> str:
    """The text with every found range replaced by the name of its first kind."""
    out, at = [], 0
    for start, end, kind in scan(text).every:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _redact_rows(text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, text_col):
            place = batch.schema.get_field_index(text_col)
            texts = [None if v is None else redacted(v) for v in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.schema.field(place).type))

    return run


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with the secrets in `text_col` replaced; null stays null."""
    return docs.mapInArrow(_redact_rows(text_col), docs.schema)
