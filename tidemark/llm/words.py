"""Words of whole texts and their 64-bit hashes, batch by batch, in numpy.

Texts come as a binary Arrow column of UTF-8. A byte table gives every byte of a
word a random value and every separator zero; in folding tables upper-case ASCII
letters share the value of their lower-case form, so hashes compare lower-cased words. A word's
hash is a polynomial over its bytes. Differences of one running sum give all
words of a segment at once, and segments end at word ends, so memory follows the
segment size and the longest single word, not the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 15
SLICE = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _lower(code: int) -> int:
    return code + 32 if 65 <= code <= 90 else code


def byte_table(is_word: Callable[[int], bool], fold: bool = True) -> np.ndarray:
    """Values of the 256 bytes; `is_word` decides on the (lower-cased) byte."""
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    own = [_lower(c) if fold else c for c in range(256)]
    return np.array([values[c] if is_word(c) else 0 for c in own], np.uint64)


# [^\x20\x09-\x0D]+ : everything but ASCII white space.
SPACED = byte_table(lambda c: not (c == 32 or 9 <= c <= 13))
# The same words, their case kept.
EXACT = byte_table(lambda c: not (c == 32 or 9 <= c <= 13), fold=False)
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters, all beyond ASCII.
ALNUM = byte_table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of a 64-bit value over the word (a fixed finaliser)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(name: str, base: int, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        steps = np.full(max(n, SEGMENT + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name]


@dataclass
class Words:
    """Words of a batch of texts, in order.

    `first[i]` to `first[i + 1]` are the words of text i; `start` and `end` are
    byte places in `buffer`, `offset` the byte places of the texts.
    """

    buffer: np.ndarray
    offset: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def of(self, i: int) -> slice:
        return slice(self.first[i], self.first[i + 1])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and text offsets of a binary column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer[offsets[0]:offsets[-1]], offsets - offsets[0]


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows of at most `most` bytes in a column, or one row."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(batch.schema.get_field_index(column))).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, before + most, "right")))
            yield batch.slice(start, end - start)
            start = end


def _cut(buffer, offset, table, at: int) -> int:
    """A place after `at` where no word is broken, near one segment on."""
    end = at + SEGMENT
    if end >= len(buffer):
        return len(buffer)
    border = offset[np.searchsorted(offset, end, "right") - 1]
    gaps = np.flatnonzero(table[buffer[max(at, end - 4096):end]] == 0)
    gap = max(at, end - 4096) + gaps[-1] + 1 if len(gaps) else at
    if max(border, gap) > at:
        return int(max(border, gap))
    while end < len(buffer):  # one word longer than the segment: up to its end
        stop = min(end + SEGMENT, len(buffer))
        gaps = np.flatnonzero(table[buffer[end:stop]] == 0)
        border = offset[np.searchsorted(offset, end)]
        found = [int(end + g) for g in gaps[:1]] + [int(border)] * bool(border <= stop)
        if found:
            return min(found)
        end = stop
    return len(buffer)


def words_of(column: pa.Array, table: np.ndarray = SPACED) -> Words:
    """All words of a binary column of texts."""
    buffer, offset = bytes_of(column)
    hashes, starts, ends, at = [], [], [], 0
    while at < len(buffer):
        stop = _cut(buffer, offset, table, at)
        value = table[buffer[at:stop]]
        inside = np.zeros(len(value) + 2, np.int8)
        inside[1:-1] = value != 0
        edge = np.diff(inside)
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        inner = offset[np.searchsorted(offset, at, "right"):np.searchsorted(offset, stop)] - at
        joined = np.unique(inner[(inside[inner] != 0) & (inside[inner + 1] != 0)]) if len(inner) else inner
        if len(joined):  # two texts meet without a separator
            start = np.sort(np.concatenate([start, joined]), kind="stable")
            end = np.sort(np.concatenate([end, joined]), kind="stable")
        if len(start):
            total = np.zeros(len(value) + 1, np.uint64)
            np.cumsum(value * _power("up", _BASE, len(value))[:len(value)], out=total[1:])
            hashes.append(mix((total[end] - total[start]) * _power("down", _INVERSE, len(value))[start]))
            starts.append(start + at)
            ends.append(end + at)
        at = stop
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start = join(starts, np.int64)
    return Words(buffer, offset, join(hashes, np.uint64), start, join(ends, np.int64),
                 np.searchsorted(start, offset))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` consecutive words, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(_BASE)
        out += hashes[k:k + n]
        out ^= out >> np.uint64(29)
    return mix(out)
