"""Quality rules by line labelling: a linear-chain conditional random field.

Lines with a word are labelled content or boilerplate by Viterbi decoding. Line
features are shares of symbols, capitals and so on, repeated words, and whether
the line occurred before. A document is kept if it passes the base rules and
enough of its words stand in content lines.

The field is trained on documents with a quality label: the lines of a good one
count as content, those of a poor one as boilerplate. The weights are those of
greatest regularised likelihood, found by gradient ascent with
forward-backward sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.words import EXACT, Words, in_slices, windows, words_of
from tidemark.runtime import stage

FEATURES = ("one", "symbols", "bars", "bangs", "capitals", "digits", "repeats", "seen", "length", "word_length")
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
CONTENT_SHARE = 0.5


def _kind(characters: str) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(characters.encode())] = 1
    return table


_SYMBOL, _BAR, _BANG = _kind("#*$%&|<>"), _kind("|"), _kind("!")
_UPPER, _DIGIT = _kind("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _kind("0123456789")
_POINT = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
_WORD_POINT = (_POINT & (EXACT != 0)).astype(np.uint8)


@dataclass(frozen=True)
class Field:
    """Weights of the two labels (0 content, 1 boilerplate): by feature, and from label to label."""

    emit: np.ndarray
    step: np.ndarray


@dataclass
class Lines:
    """Lines with a word of a batch of texts: features, words, and the lines of each text."""

    features: np.ndarray
    words: np.ndarray
    first: np.ndarray


def _sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values between each start and end; ranges are in order and apart."""
    if not len(start):
        return np.zeros(0, np.int64)
    edges = np.stack([start, end], axis=1).ravel()
    if edges[-1] >= len(values):
        values = np.concatenate([values, np.zeros(1, values.dtype)])
    out = np.add.reduceat(values, edges, dtype=np.int64)[::2]
    return np.where(start == end, 0, out)


def _spans(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the lines with a word, their first word and word count."""
    breaks = np.flatnonzero(words.buffer == 10)
    start = np.unique(np.concatenate([words.offset[:-1], breaks + 1])).astype(np.int64)
    if not len(start) or not len(words.start):
        return (np.zeros(0, np.int64),) * 4
    first = np.searchsorted(words.start, start)
    count = np.diff(np.append(first, len(words.start)))
    end = np.append(start[1:], len(words.buffer))
    # A line ends before its line break, or where the next text begins.
    last = np.clip(end - 1, 0, len(words.buffer) - 1)
    end = np.where((end > start) & (words.buffer[last] == 10) & (last >= start), last, end)
    full = count > 0
    return start[full], end[full], first[full], count[full]


def lines_of(words: Words) -> tuple[Lines, np.ndarray]:
    """Lines with their features, and whether each equals an earlier line of its text."""
    start, end, first, count = _spans(words)
    owner = np.searchsorted(words.offset, start, "right") - 1
    seen = np.zeros(len(start))
    raw = words.buffer.tobytes()
    known: set[bytes] = set()
    before = -1
    for i, (a, b, doc) in enumerate(zip(start.tolist(), end.tolist(), owner.tolist(), strict=True)):
        if doc != before:
            known, before = set(), doc
        line = raw[a:b]
        if line in known:
            seen[i] = 1
        else:
            known.add(line)
    size = np.maximum(end - start, 1)
    share = lambda table: _sums(table[words.buffer], start, end) / size
    tenth = lambda table: np.minimum(10 * share(table), 1)  # noqa: E731  a tenth of the line is all it can be
    same = np.zeros(len(words.hash) + 1, np.int64)
    if len(words.hash) > 1:
        np.cumsum(words.hash[1:] == words.hash[:-1], out=same[2:])
    repeats = (same[first + count] - same[np.minimum(first + 1, len(words.hash))]) / np.maximum(count - 1, 1)
    letters = _sums(_WORD_POINT[words.buffer], start, end)
    features = np.stack([
        np.ones(len(start)), tenth(_SYMBOL), tenth(_BAR), tenth(_BANG), share(_UPPER), tenth(_DIGIT), repeats, seen,
        np.log1p(count) / 5, np.minimum(letters / np.maximum(count, 1), 20) / 10], axis=1)
    return Lines(features, count, np.searchsorted(owner, np.arange(len(words) + 1))), seen


def decode(field: Field, lines: Lines) -> np.ndarray:
    """Best label of every line, all texts of the batch side by side; ties go to content."""
    score = lines.features @ field.emit
    best = np.zeros(len(score), np.int8)
    size = np.diff(lines.first)
    order = np.argsort(-size, kind="stable")
    start, size = lines.first[:-1][order], size[order]
    back = np.zeros(score.shape, np.int8)
    total = np.zeros((len(order), 2))
    for t in range(int(size[0]) if len(size) else 0):
        k = np.searchsorted(-size, -t, "left")  # texts with more than t lines
        place = start[:k] + t
        if t == 0:
            total[:k] = score[place]
            continue
        options = total[:k, :, None] + field.step
        back[place] = options.argmax(axis=1)
        total[:k] = options.max(axis=1) + score[place]
    label = total.argmax(axis=1)
    for t in range((int(size[0]) if len(size) else 0) - 1, -1, -1):
        k = np.searchsorted(-size, -t, "left")
        place = start[:k] + t
        best[place] = label[:k]
        label[:k] = back[place, label[:k]]
    return best


def train(documents: list[np.ndarray], labels: list[int], rounds: int = 150, ridge: float = 1e-3) -> Field:
    """Weights of greatest likelihood; each document counts the same, whatever its length.

    Without documents of both kinds every line is content.
    """
    width = len(FEATURES)
    if len(set(labels)) < 2:
        return Field(np.tile([1.0, 0.0], (width, 1)), np.zeros((2, 2)))
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    y = np.array([labels[i] for i in order])
    size = np.array([len(documents[i]) for i in order])
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    x = np.concatenate([documents[i] for i in order])
    share = np.bincount(y)[y] * 2.0
    weight = np.repeat(1 / (share * size), size)
    owner = np.repeat(np.arange(len(y)), size)
    places = [start[:np.searchsorted(-size, -t, "left")] + t for t in range(int(size[0]))]
    parameters = np.zeros(2 * width + 4)
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    aim = np.stack([y[owner] == 0, y[owner] == 1], axis=1)

    def log_sum(a: np.ndarray, axis: int) -> np.ndarray:
        top = a.max(axis=axis)
        return top + np.log(np.exp(a - np.expand_dims(top, axis)).sum(axis=axis))

    for n in range(1, rounds + 1):
        emit, step = parameters[:2 * width].reshape(width, 2), parameters[2 * width:].reshape(2, 2)
        score = x @ emit
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, len(places)):
            ahead[places[t]] += log_sum(ahead[places[t] - 1][:, :, None] + step, 1)
        for t in range(len(places) - 1, 0, -1):
            behind[places[t] - 1] = log_sum(step + (score[places[t]] + behind[places[t]])[:, None, :], 2)
        norm = log_sum(ahead[start + size - 1], 1)[owner]
        here = np.exp(ahead + behind - norm[:, None])
        slope = x.T @ ((aim - here) * weight[:, None])
        inner = np.concatenate(places[1:]) if len(places) > 1 else np.zeros(0, np.int64)
        pair = np.exp(ahead[inner - 1][:, :, None] + step + (score[inner] + behind[inner])[:, None, :]
                      - norm[inner][:, None, None])
        truth = aim[inner - 1][:, :, None] & aim[inner][:, None, :]
        turn = ((truth - pair) * weight[inner][:, None, None]).sum(axis=0)
        gradient = np.concatenate([slope.ravel(), turn.ravel()]) - ridge * parameters
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient**2
        parameters = parameters + 0.2 * (mean / (1 - 0.9**n)) / (np.sqrt(square / (1 - 0.99**n)) + 1e-8)
    return Field(parameters[:2 * width].reshape(width, 2), parameters[2 * width:].reshape(2, 2))


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_slices(batches, "text"):
        lines, _ = lines_of(words_of(batch.column("text"), EXACT))
        rows = [lines.features[lines.first[i]:lines.first[i + 1]].ravel() for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("h"),
                                          pa.array(rows, pa.list_(pa.float64()))], names=["quality", "h", "x"])


def fit(docs: DataFrame, labels: DataFrame, rows_per_label: int = 200, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Field:
    """Train on at most `rows_per_label` labelled documents of either quality, chosen by hash.

    A hash threshold taken from the label counts leaves about four times as many
    labels; these are ranked, and only chosen documents are read for features.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("quality")).where(
        F.col("id").isNotNull() & F.col("quality").isin(0, 1)).distinct()
    counts = dict(known.groupBy("quality").count().collect())
    top = float(1 << 63)
    reach = F.lit(-top)
    for value, n in counts.items():
        reach = F.when(F.col("quality") == value, -top + 2 * top * min(1.0, 4 * rows_per_label / n)).otherwise(reach)
    rank = F.row_number().over(Window.partitionBy("quality").orderBy("h", "id"))
    chosen = stage(known.withColumn("h", F.xxhash64("id")).where(F.col("h").cast("double") <= reach)
                   .withColumn("rank", rank).where(F.col("rank") <= rows_per_label).drop("rank"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    # At most 2 * rows_per_label ids: a bounded broadcast. Of repeated ids one row is used.
    rows = (texts.join(F.broadcast(chosen), "id").groupBy("id")
            .agg(F.first("quality").alias("quality"), F.first("h").alias("h"), F.max("text").alias("text"))
            .mapInArrow(_line_features, "quality int, h long, x array<double>").collect())
    rows = sorted((r for r in rows if r.x), key=lambda r: (r.quality, r.h))
    return train([np.array(r.x).reshape(-1, len(FEATURES)) for r in rows], [1 - r.quality for r in rows])


def _repeated(hashes: np.ndarray) -> int:
    """Words within windows of eight that occur twice or more."""
    own = windows(hashes, WINDOW)
    if len(own) < 2:
        return 0
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    start = np.flatnonzero(np.isin(own, twice))
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[start] += 1
    cover[start + WINDOW] -= 1
    return int((np.cumsum(cover) > 0).sum())


def _judge(field: Field, share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            words = words_of(batch.column("text"), EXACT)
            lines, seen = lines_of(words)
            label = decode(field, lines)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lines.first))
            per = lambda w: np.bincount(owner, w, batch.num_rows).astype(np.int64)
            start, end = words.offset[:-1], words.offset[1:]
            n_words = np.diff(words.first)
            repeat = np.array([_repeated(words.hash[words.of(i)]) for i in range(batch.num_rows)], np.int64)
            failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
            content = per(lines.words * (label == 0)) / np.maximum(n_words, 1)
            columns = {
                "n_words": n_words.astype(np.int64), "word_chars": _sums(_WORD_POINT[words.buffer], start, end),
                "n_symbols": _sums(_SYMBOL[words.buffer], start, end), "n_dup_lines": per(seen),
                "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & (content >= share),
                "n_lines": np.diff(lines.first).astype(np.int64), "n_content_lines": per(label == 0),
                "content_share": content}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v) for v in columns.values())],
                                             names=["doc_id", *columns])

    return run


def judge_lines(docs: DataFrame, field: Field, share: float = CONTENT_SHARE, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Base counts and verdict for every whole text.

    Returns one row per input row: `doc_id`, `n_words`, `word_chars`, `n_symbols`,
    `n_dup_lines`, `n_repeat_words`, `base_failed`, `kept`, `n_lines` (with a
    word), `n_content_lines`, `content_share` (of words). A null or empty text has
    no words and fails. Null ids and repeated rows are kept. Other columns are not
    read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _judge(field, share),
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, n_lines long, n_content_lines long, content_share double")
