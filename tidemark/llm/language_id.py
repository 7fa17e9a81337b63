"""Language identification with a string kernel.

A text's spectrum is the set of its 1-, 2- and 3-letter sequences, over
lower-cased letters with one mark for any run of other characters. The kernel of
two texts is the number of sequences present in both, over the root of the
product of both numbers (a blended-spectrum presence kernel). Nystroem landmarks,
texts of the training sample, map a text to its kernel values against them,
whitened by the landmarks' own kernel; kernel ridge regression is then solved
there, one language against the rest.

The kernel is an inner product of presence rows, so landmark matrix, whitening
and regression weights multiply into one matrix with a row for each sequence that
the landmarks hold. Scoring multiplies it with the presence matrix of a block of texts.
Sequences are packed into 64-bit codes, so every letter of the sample counts,
however many scripts and letters the languages have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.words import in_slices
from tidemark.runtime import stage

# Class 0 is a break between letters, 1 any letter that was not learned. A code is
# the length of a sequence and up to three classes of so many bits.
BITS = 20
UNDETERMINED = "und"
# Cells of a presence matrix: 32 MB of doubles.
BLOCK_CELLS = 4_000_000
# Below this a text resembles no learned language.
LEAST_SCORE = 0.05


@dataclass(frozen=True)
class Model:
    """What scoring needs: letters, sequence codes, weights and languages."""

    letters: tuple[int, ...]
    codes: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    languages: tuple[str, ...]


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(code).isalpha() for code in range(0x110000)), np.uint8, 0x110000)


class Spectrum:
    """Sequences present in a text."""

    def __init__(self, letters: tuple[int, ...]):
        self.classes = _is_letter().astype(np.int64)
        self.classes[list(letters)] = np.arange(2, 2 + len(letters))

    def mark(self, text: str) -> np.ndarray:
        """Sorted codes of all sequences of the text, each once."""
        c = self.classes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        c = np.concatenate([[0], c, [0]])
        c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]
        two = c[:-1] << BITS | c[1:]
        # shorter sequences are the heads of longer ones, but for those at the end
        three = np.unique(two[:-1] << BITS | c[2:])
        pairs = np.unique(np.append(three >> BITS, two[-1:]))
        ones = np.unique(np.append(pairs >> BITS, c[-1:]))
        return np.concatenate([ones, pairs | 1 << 3 * BITS, three | 2 << 3 * BITS])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _learned(codes: np.ndarray) -> np.ndarray:
    """Whether a sequence has a letter and only learned ones."""
    classes = np.stack([codes >> k * BITS & (1 << BITS) - 1 for k in range(3)])
    used = np.arange(3)[:, None] <= codes >> 3 * BITS
    return ~((classes == 1) & used).any(axis=0) & ((classes > 1) & used).any(axis=0)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[int, int] = {}
        for text in batch.column("text"):
            points, n = np.unique(np.frombuffer(text.as_py().lower().encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
            for p, k in zip(points.tolist(), n.tolist(), strict=True):
                if chr(p).isalpha():
                    counts[p] = counts.get(p, 0) + k
        yield pa.RecordBatch.from_pydict({"point": pa.array(list(counts), pa.int64()),
                                          "n": pa.array(list(counts.values()), pa.int64())})


def _codes(letters: tuple[int, ...]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(letters)
        for batch in batches:
            out = [spectrum.mark(text.as_py()).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("rank"), pa.array(out, pa.binary())],
                names=["lang", "rank", "codes"])

    return run


def held_out(id_col: str) -> Column:
    """crc32 of the id as text leaves 2 at division by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, rows_per_language: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """At most so many labelled, not held-out rows with letters of each label, chosen by hash.

    A hash threshold, taken from the counts of exactly these rows, leaves about four times
    as many as wanted of each label; only these are ranked. A label whose usable rows are
    few, however many others it has, gives them all.
    """
    pool = docs.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text"), held_out(id_col).alias("out"),
                       F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"),
                       F.col(id_col).isNotNull().alias("known"))
    pool = pool.where(F.col("lang").isNotNull() & F.col("known") & ~F.col("out") & F.col("text").rlike(r"\p{L}"))
    counts = dict(pool.groupBy("lang").count().collect())
    if not counts:
        return pool.limit(0).select("lang", "text", F.lit(0).alias("rank"))
    top = float(1 << 63)
    reach = {k: -top + 2 * top * min(1.0, 4 * rows_per_language / n) for k, n in counts.items()}
    limit = F.create_map(*[F.lit(x) for pair in reach.items() for x in pair])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")).alias("rank")
    return (pool.where(F.col("h").cast("double") <= limit[F.col("lang")])
            .select("lang", "text", rank).where(F.col("rank") <= rows_per_language))


def fit(docs: DataFrame, rows_per_language: int = 300, landmarks_per_language: int = 60, ridge: float = 1e-3,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on at most `rows_per_language` rows of each language that are not held out.

    The driver receives the letters and the sequence codes of these rows only, of
    8 bytes for each distinct sequence of a text.
    """
    sample = stage(training_sample(docs, rows_per_language, id_col, text_col, label_col))
    letters = (sample.select("text").mapInArrow(_letters, "point long, n long").groupBy("point")
               .agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").collect())
    points = tuple(int(r.point) for r in letters)
    rows = sample.mapInArrow(_codes(points), "lang string, rank int, codes binary").collect()
    rows.sort(key=lambda r: (r["rank"], r.lang))
    languages = tuple(sorted({r.lang for r in rows}))
    if not rows:
        return Model(points, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), ())
    spectra = [np.frombuffer(r.codes, np.int64) for r in rows]
    marks = [i for i, r in enumerate(rows) if r["rank"] <= landmarks_per_language]
    codes = np.unique(np.concatenate([spectra[i] for i in marks]))
    codes = codes[_learned(codes)]

    places = [(np.searchsorted(codes, x), x) for x in spectra]
    own = [place[np.append(codes, -1)[place] == x] for place, x in places]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    every, root = np.concatenate(own), np.sqrt([len(x) for x in spectra])
    kernel = np.zeros((len(rows), len(marks)))  # of every row with every landmark
    for k, i in enumerate(marks):
        held = np.zeros(len(codes), bool)
        held[own[i]] = True
        total = np.concatenate([[0], np.cumsum(held[every])])
        kernel[:, k] = (total[starts[1:]] - total[starts[:-1]]) / (root * root[i])
    values, vectors = np.linalg.eigh(kernel[marks])
    sound = values > 1e-8 * values[-1]
    white = vectors[:, sound] / np.sqrt(values[sound])
    z = kernel @ white
    label = np.array([languages.index(r.lang) for r in rows])
    y = (label[:, None] == np.arange(len(languages))).astype(float)
    share = 1 / np.bincount(label)[label]  # every language weighs the same
    share /= share.sum()
    centre, level = share @ z, share @ y
    zc = (z - centre) * share[:, None]
    beta = np.linalg.solve(zc.T @ (z - centre) + ridge * np.eye(z.shape[1]) / len(languages), zc.T @ (y - level))
    weights = np.zeros((len(codes), len(languages)))
    for i, weight in zip(marks, white @ beta, strict=True):
        weights[own[i]] += weight / root[i]
    return Model(points, codes, weights, level - centre @ beta, languages)


class Scorer:
    """Predictions for a batch of texts, one matrix product for a block of them.

    The score is the regression's value, cut to 0 to 1, times the share of the
    text's sequences that the landmarks hold: a text in no learned language scores
    near 0, whatever the regression makes of it.
    """

    def __init__(self, model: Model):
        self.model, self.spectrum = model, Spectrum(model.letters)
        self.known = np.append(model.codes, -1)  # a code beyond the last is not known
        self.rows = max(1, BLOCK_CELLS // max(1, len(model.codes)))

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        model = self.model
        names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not model.languages:
            return names, scores
        lettered = [i for i in range(len(texts)) if has_letter(texts[i].as_py())]
        for start in range(0, len(lettered), self.rows):
            block = lettered[start:start + self.rows]
            present = np.zeros((len(block), len(model.codes)))
            size = np.zeros(len(block))
            for row, i in enumerate(block):
                codes = self.spectrum.mark(texts[i].as_py())
                place = np.searchsorted(model.codes, codes)
                present[row, place[self.known[place] == codes]] = 1
                size[row] = len(codes)
            out = present @ model.weights / np.sqrt(size)[:, None] + model.offset
            scores[block] = out.max(axis=1).clip(0, 1) * present.sum(axis=1) / size
            for i, best in zip(block, out.argmax(axis=1).tolist(), strict=True):
                names[i] = model.languages[best]
        return names, scores


def _predict(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in in_slices(batches, "text"):
            names, scores = score(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def _known(model: Model, least: float, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in in_slices(batches, text_col):
            names, scores = score(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array((np.array(names) != UNDETERMINED) & (scores >= least)))

    return run


def in_known_language(docs: DataFrame, model: Model, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text has a letter and scores at least `least` in some language."""
    return docs.mapInArrow(_known(model, least, text_col), docs.schema)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text, from the text alone.

    Returns one row per input row: `doc_id`, `held_out`, `lang_pred`, `score`.
    A null text, an empty one and one without a letter give `und` and 0, as does
    a model that saw no labelled row. A null id is kept, with `held_out` false;
    repeated rows are kept. Ties between languages go to the first by name.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"),
                       F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
