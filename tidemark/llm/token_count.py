"""Token counts under a unigram vocabulary, without building the tokens.

Aho-Corasick reports every vocabulary piece that ends at a place; dynamic
programming over places carries the best score and its number of pieces. Tie
rules are those of the public unigram tokenizers: pieces are tried from the
earliest start on and replace what is there only with a strictly better score, so
of equal scores the longest last piece stays; a character that no piece of its
own covers costs the least score of the vocabulary less 10. With byte pieces an
unknown character counts its bytes, without them a run of unknown characters
counts once.

Blanks become the mark of a word start and one is put before the text. With
`split` each mark starts a segment that is solved for itself, as tokenizers do that
split at the mark first. Without, the best path is that of the whole text, so
pieces with inner marks (runs of blanks) count; the text is then cut only where no
piece can cross and sums are exact: at the first mark of a run. Counts of segments
met before are kept, and a text costs one look-up for each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PENALTY = 10.0
KEPT = 300_000  # segments whose counts a process remembers
LONGEST = 64  # longer segments are counted each time

_RUN = re.compile(f"(?<!{MARK}){MARK}")
_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_INNER = re.compile(f"[^{MARK}]{MARK}")


class Unigram(dict):
    """Counts by segment; a missing one is computed."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool, split: bool = True):
        super().__init__()
        self.find = ahocorasick.Automaton()
        for piece, score in dict(vocabulary).items():
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - PENALTY
        self.byte_fallback = byte_fallback
        pieces = set().union(*(set(p) for p, _ in vocabulary))
        whole = all(score == int(score) for _, score in vocabulary)
        # A line break that no piece holds parts a segment; sums of whole scores are exact.
        self.parted = byte_fallback and whole and "\n" not in pieces
        self.split = split
        # A mark after another character starts a segment if no piece holds both and no unknown run does.
        self.cut = whole and (byte_fallback or MARK in dict(vocabulary)) and not any(
            _INNER.search(p) for p, _ in vocabulary)

    def __missing__(self, segment: str) -> int:
        n = self.pieces(segment)
        if len(segment) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[segment] = n
        return n

    def pieces(self, segment: str) -> int:
        """Pieces on the best path over one segment."""
        size = len(segment)
        best, count, unknown = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        done = 0  # places up to here are final
        single = reached = False

        def close(place: int) -> None:
            """Add the unknown character that ends here, where no piece covers it."""
            if single:
                return
            score = best[place - 1] + self.unknown
            if not reached or score > best[place]:
                best[place] = score
                if self.byte_fallback:
                    count[place] = count[place - 1] + len(segment[place - 1].encode("utf-8", "surrogatepass"))
                else:
                    count[place] = count[place - 1] + (not unknown[place - 1])
                unknown[place] = True

        for last, (length, score) in self.find.iter(segment):
            while done < last:  # places without any piece, and the one worked on
                done += 1
                close(done)
                single = reached = False
            place = last + 1
            score += best[place - length]
            if not reached or score > best[place]:
                best[place], count[place], reached = score, count[place - length] + 1, True
            single = single or length == 1
        while done < size:
            done += 1
            close(done)
            single = reached = False
        return count[size]

    def tokens(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty have none."""
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        if marked[0] != MARK:
            marked = MARK + marked
        if not self.split and (MARK * 2 in marked or not self.cut):
            if not self.cut:
                return self[marked]
            if self.parted:
                return sum(map(self.__getitem__, _RUN.sub("\n" + MARK, marked).split("\n"))) + text.count("\n")
            return sum(map(self.__getitem__, _SEGMENT.findall(marked)))
        if self.parted:
            return sum(map(self.__getitem__, marked.replace(MARK, "\n" + MARK).split("\n"))) + text.count("\n")
        return sum(map(self.__getitem__, [MARK + part for part in marked.split(MARK)[1:]]))


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores of a sentencepiece model file, and whether it has byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    return ([(model.id_to_piece(i), model.get_score(i)) for i in range(size)],
            any(model.is_byte(i) for i in range(size)))


@cache
def _model(vocabulary: tuple[tuple[str, float], ...], byte_fallback: bool, split: bool) -> Unigram:
    return Unigram(list(vocabulary), byte_fallback, split)


def _count(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(*shared.value)
        for batch in batches:
            texts = batch.column("text")
            counts = [model.tokens(texts[i].as_py()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_chars"),
                                              pa.array(counts, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], byte_fallback: bool,
                 id_col: str = "doc_id", text_col: str = "text", split: bool = True) -> DataFrame:
    """Tokens of every whole text, cut at each blank first (`split`) or not.

    Returns one row per input row: `doc_id`, `n_chars` (code points), `n_tokens`. A
    null or empty text has 0 of both. Null ids and repeated rows are kept; an empty
    table gives no rows. Other columns are not read, whatever their names. The
    vocabulary (some 10,000 pieces) is broadcast.
    """
    if not vocabulary:
        raise ValueError("the vocabulary is empty")
    shared = docs.sparkSession.sparkContext.broadcast((tuple(vocabulary), byte_fallback, split))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_chars"),
                       F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(shared), f"doc_id {kind}, n_chars long, n_tokens long")
