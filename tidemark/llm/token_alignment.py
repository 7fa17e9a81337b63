"""Alignment of two tokenizers over the bytes of a text.

A is a byte-level BPE file of `tokenizers`, B a `sentencepiece` model. Both encode
a blank and the text. Where tokens of both end at one byte the text is cut, and
what lies between two cuts is a group of A tokens beside B tokens that spell the
same bytes. Two tokens that end together are linked.

The ends of tokens come from the libraries' spans: character offsets of A, the
spans of B's proto. These are coarse: fragments of one character share its span or
have none (byte pieces), so their ends are refined with the tokens' decoded bytes.

A blank after a character that is no white space starts a token in both
tokenizers. Texts are parted there, and each distinct part is aligned once and
remembered; parts not met before are encoded together, many at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import sha256
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import small
from tidemark.llm.words import in_slices
from tidemark.runtime import stage

MARK = "▁"
SHIFT = 32  # a link is A's id, shifted, and B's id
SLICE = 1 << 20
STEP = 1 << 19  # characters of a text parted at once
CHUNK = 1 << 17  # characters of parts encoded together
KEPT, KEPT_CHARS = 250_000, 25_000_000  # parts that a process remembers
_PIECE = attrgetter("id", "end")

_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")
_INNER = re.compile(f"[^{MARK}]{MARK}")
# A part: up to the next blank that follows a character that is no white space. A single
# blank at the end goes with the part before: alone it would be an empty text for B.
_CUT = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
_PART = re.compile(r".[^ ]*(?:(?<=\s) [^ ]*)*(?: \Z)?", re.DOTALL)


@dataclass
class Files:
    """Contents of the two vocabulary files."""

    a: bytes
    b: bytes

    @staticmethod
    def read(a: str, b: str) -> Files:
        with open(a, "rb") as x, open(b, "rb") as y:
            return Files(x.read(), y.read())


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable
    Latin-1 characters for themselves, the other bytes from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, files: Files):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(files.a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=files.b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        hexes = [_BYTE.match(p) for p in pieces]
        self.bytes_b = [bytes([int(m[1], 16)]) if m else p.replace(MARK, " ").encode() for p, m in zip(pieces, hexes, strict=True)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.is_byte = np.array([m is not None for m in hexes])
        # No piece of B may cross the start of a part.
        self.parted = not any(_INNER.search(p) for p in pieces)
        # An id in decimal with what may follow it: of A a comma or a bar, of B a comma or a semicolon.
        ids = range(max(len(self.bytes_a), len(pieces)))
        self.decimal = [f"{i}{mark}" for i in ids for mark in ",|;"]

    def align(self, whole: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and of B, and places of the tokens of either that end together; None if one spells it otherwise."""
        a = self.a.encode(whole, add_special_tokens=False)
        b = self.b.encode(whole[1:], return_type="proto", num_threads=1).pieces
        pieces = list(chain.from_iterable(map(_PIECE, b)))
        ids_a, ids_b, spelled = a.ids, pieces[::2], whole.encode()
        if (b"".join(map(self.bytes_a.__getitem__, ids_a)) != spelled
                or b"".join(map(self.bytes_b.__getitem__, ids_b)) != spelled):
            return None
        ids_a, ids_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a = np.fromiter(chain.from_iterable(a.offsets), np.int64, 2 * len(ids_a))[1::2]
        # B's spans count the bytes of the text without the blank put before it.
        ends_b = np.array(pieces[1::2], np.int64) + 1
        if len(spelled) > len(whole) or self.is_byte[ids_b].any():
            starts = np.flatnonzero(np.frombuffer(spelled, np.uint8) & 0xC0 != 0x80)
            ends_a = refine(np.append(starts, len(spelled))[ends_a], self.size_a[ids_a])
            ends_b = refine(ends_b, self.size_b[ids_b])
        _, last_a, last_b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        return ids_a, ids_b, last_a, last_b

    def decimals(self, ids_a: np.ndarray, ids_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The tokens of the groups in order, each with its mark: a1, a2| b1; a3| b2, b3;"""
        n_a, n_b = len(ids_a), len(ids_b)
        group_a, group_b = np.searchsorted(last_a, np.arange(n_a)), np.searchsorted(last_b, np.arange(n_b))
        first_b = np.append(0, last_b[:-1] + 1)
        out = np.empty(n_a + n_b, np.int64)
        mark_a, mark_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        mark_a[last_a], mark_b[last_b] = 1, 2
        out[np.arange(n_a) + first_b[group_a]] = ids_a * 3 + mark_a
        out[np.arange(n_b) + last_a[group_b] + 1] = ids_b * 3 + mark_b
        return list(map(self.decimal.__getitem__, out.tolist()))


def refine(ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens: the span's, where the decoded bytes up to the token lead there as
    well; fragments of one character have its whole span or none, so theirs follow
    from the decoded bytes alone."""
    decoded = np.cumsum(sizes)
    return np.where(ends == decoded, ends, decoded)


@cache
def _loaded(a: bytes, b: bytes) -> Parts:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark shares out the cores
    return Parts(Aligner(Files(a, b)))


Part = tuple[int, int, bytes, str] | None  # tokens of A, of B, links, groups as text; None: not spelled so


class Parts:
    """Aligned parts by their text.

    They are remembered in two halves: when the newer one is full it takes the place of
    the older, and parts met again move over, so that frequent parts are never lost.
    """

    def __init__(self, aligner: Aligner):
        self.aligner, self.chars = aligner, 0
        self.known: dict[str, Part] = {}
        self.older: dict[str, Part] = {}

    def of(self, text: str) -> Iterator[list[str]]:
        """The parts of a blank and the text, in order, some at a time."""
        whole, at = " " + text, 0
        if not self.aligner.parted:
            yield [whole]
            return
        while m := _CUT.search(whole, at + STEP):
            yield _PART.findall(whole[at:m.start()])
            at = m.start()
        yield _PART.findall(whole[at:])

    def add(self, parts: list[str]) -> None:
        """Align parts not met before, as many at once as a chunk takes."""
        if 2 * len(self.known) > KEPT or 2 * self.chars > KEPT_CHARS:
            self.older, self.known, self.chars = self.known, {}, 0
        new, size = [], 0
        for part in set(parts).difference(self.known):
            self.chars += len(part)
            if part in self.older:
                self.known[part] = self.older[part]
                continue
            if part[-1].isspace():  # what follows could be joined with it
                self._align([part])
                continue
            new.append(part)
            size += len(part)
            if size > CHUNK:
                self._align(new)
                new, size = [], 0
        self._align(new)

    def _align(self, parts: list[str]) -> None:
        if not parts:
            return
        found = self.aligner.align("".join(parts))
        if found is None:
            if len(parts) == 1:
                self.known[parts[0]] = None
            else:  # look for the part that is spelled otherwise
                self._align(parts[:len(parts) // 2])
                self._align(parts[len(parts) // 2:])
            return
        ids_a, ids_b, last_a, last_b = found
        links = ((ids_a[last_a] << SHIFT) | ids_b[last_b]).tobytes()
        decimals = self.aligner.decimals(*found)
        ends = np.cumsum(self.aligner.size_a[ids_a])[last_a]
        sizes = np.fromiter((len(p.encode()) for p in parts), np.int64, len(parts))
        group = np.searchsorted(ends, np.cumsum(sizes)) + 1  # groups up to the end of each part
        upto_a, upto_b = last_a[group - 1] + 1, last_b[group - 1] + 1
        g = a = b = 0
        for part, g2, a2, b2 in zip(parts, group.tolist(), upto_a.tolist(), upto_b.tolist(), strict=True):
            self.known[part] = a2 - a, b2 - b, links[8 * g:8 * g2], "".join(decimals[a + b:a2 + b2])[:-1]
            g, a, b = g2, a2, b2


class Aligned:
    """The aligned texts of one batch."""

    def __init__(self, parts: Parts):
        self.parts = parts
        self.n_a, self.n_b, self.digest, self.links = [], [], [], []

    def add(self, text: str | None) -> None:
        n_a = n_b = 0
        digest, links = sha256(), []
        for some in self.parts.of(text) if text else ():
            self.parts.add(some)
            found = list(map(self.parts.known.__getitem__, some))
            if None in found:
                n_a = n_b = 0
                links.clear()
                break
            of_a, of_b, linked, groups = zip(*found, strict=True)
            digest.update((";" if links else "").encode() + ";".join(groups).encode())
            links.append(np.frombuffer(b"".join(linked), np.int64))
            n_a, n_b = n_a + sum(of_a), n_b + sum(of_b)
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.digest.append(digest.hexdigest() if links else "")
        self.links.append(np.concatenate(links) if links else np.zeros(0, np.int64))

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        size = np.array([len(x) for x in self.links], np.int64)
        places = pa.array(np.append(0, np.cumsum(size)), pa.int32())
        links = pa.ListArray.from_arrays(places, pa.array(np.concatenate(self.links)))
        # Every token has bytes, so one token of either side ends a group: its link.
        columns = [pa.array(c, pa.int64()) for c in (self.n_a, self.n_b, size, size)]
        return pa.RecordBatch.from_arrays([ids, *columns, pa.array(self.digest, pa.string()), links], names=_NAMES)


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]


def _aligned(files: Files) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _loaded(files.a, files.b)
        for batch in in_slices(batches, "text", SLICE):
            rows = Aligned(parts)
            for text in batch.column("text"):
                value = text.as_py()
                rows.add(None if value is None else value.decode())
            yield rows.batch(batch.column("doc_id"))

    return run


def align(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens, groups and links of every text, without counts of the corpus.

    Columns as of `align_corpus`, with `links` (A's id shifted by 32 bits, and B's
    id) in order of the text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_aligned(files), "doc_id long, n_a long, n_b long, n_groups long, n_links long, "
                                            "groups_sha256 string, links array<bigint>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, count, best): links of the corpus by their id pair; best: none of the B id is more frequent."""
    counts = stage(aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("count")))
    b = F.col("link").bitwiseAND((1 << SHIFT) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("link", "count", (F.col("count") == F.col("most")).alias("best"))


def align_corpus(docs: DataFrame, files: Files, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of every text, with the weight of its links in the whole corpus.

    Returns one row per input row: `doc_id`, `n_a`, `n_b` (tokens), `n_groups`,
    `n_links`, `n_best` (links whose id pair is the most frequent of its B id in
    the corpus, ties included), `count_sum` (corpus counts of its links' id pairs,
    summed over links), `groups_sha256` of `a1,a2|b1;a3|b2,b3`. A null or empty
    text, and one that either tokenizer does not spell byte by byte (a U+2581 in
    it, for B), has zeros and an empty digest, and adds nothing to the counts.
    Repeated rows count again and stay rows; null ids stay. An empty table gives
    no rows; other columns are not read. Texts may be of any length: parts are
    taken in steps, and what stays of a text is its links.

    Runs jobs when called: the aligned texts and the counts are written once. The
    counts are broadcast up to a counted bound, beyond it joined by a shuffle.
    """
    aligned = stage(align(docs, files, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    counts = small(stage(link_counts(aligned)), COUNTS)
    links = aligned.select("row", F.explode("links").alias("link")).join(counts, "link")
    sums = links.groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.join(sums, F.col("row") == F.col("r"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


# Rows of the table of link counts (17 bytes each) up to which it is broadcast.
COUNTS = 1_000_000
