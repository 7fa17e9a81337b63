"""Spelling variants: words one inserted, deleted or replaced character apart.

Words are arranged by their frequency vector: how often each of 16 groups of
letters occurs. Two words one edit apart differ in it by a surplus of one at most
and a deficit of one at most. So a trie over the successive counts is searched
depth first with a budget of one surplus and one deficit; the words at the leaves
that are left are compared letter by letter.

The top of the trie (length and the first four counts) is dealt by Spark: a word
goes as an entry to its own subtree and as a query to each subtree within the
budget; of two words of equal length only one asks for the other. A subtree of
many words is cut into blocks, and so are its queries, so that no task gathers
more than a block of entries. The rest of the trie is searched inside the tasks,
where a node takes all its queries at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import small
from tidemark.llm.line_dedup import fold
from tidemark.runtime import stage

RUN = "([A-Za-zÀ-ÿ]+)"
LEAST_CHARS, LEAST_COUNT, RATIO, NOISE = 5, 3, 2, 97
GROUPS, TOP = 16, 4
BLOCK, QUERIES = 100_000, 2_000_000  # entries and queries of a unit
SHORT = 31  # longer words are compared one pair at a time
LEAF, CHUNK = 24, 4096

# Letters by frequency, dealt to the groups in turn; all others by their code.
_ORDER = "etaoinshrdlcumwfgypbvkjxqz"


def group_of(code: int) -> int:
    """The letter group of a code point."""
    letter = chr(code)
    return (_ORDER.index(letter) if letter in _ORDER else code) % GROUPS


_GROUP = np.array([GROUPS, *(group_of(c) for c in range(1, 256))], np.uint8)


def _steps() -> list[tuple[int, ...]]:
    """Changes of (length, first counts) that lead from a word to a subtree it asks.

    Longer by one: one surplus at most. Of equal length: a surplus and a deficit at
    most, and of the two directions the one that comes first in order.
    """
    out = []
    for step in product((-1, 0, 1), repeat=TOP):
        more, less = step.count(1), step.count(-1)
        if more <= 1 and less <= 1 and step >= (0,) * TOP:
            out.append((0, *step))
        if more <= 1 and not less:
            out.append((1, *step))
    return out


def noisy(run: Column, doc_id: Column) -> Column:
    """The run, without one code point where its checksum with the id asks for it."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    place = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(h % NOISE == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of enough code points and occurrences, over all texts."""
    runs = docs.select(F.col(id_col).alias("i"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(1))).alias("run"))
    words = runs.select("i", fold(F.col("run")).alias("run")).select(noisy(F.col("run"), F.col("i")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _counted(words: DataFrame) -> DataFrame:
    """Words with `len` and the counts c1 to c4 of the first groups."""
    alphabet = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]
    out = words.select("word", "n", F.length("word").alias("len"))
    for k in range(TOP):
        own = "".join(c for c in alphabet if group_of(ord(c)) == k)
        out = out.withColumn(f"c{k}", F.col("len") - F.length(F.translate("word", own, "")))
    return out


def _units(words: DataFrame) -> DataFrame:
    """Entries and queries (subtree, i, j, asks, word, n), by the blocks they meet in."""
    counts = ["len", *(f"c{k}" for k in range(TOP))]
    subtree = F.concat_ws(",", *counts).alias("subtree")
    entries = _counted(words).select(subtree, "word", "n")
    steps = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(counts, step, strict=True)]) for step in _steps()])
    moved = [F.col(c) + F.col(f"step.{c}") for c in counts]
    asked = (_counted(words).select(*counts, "word", "n", F.explode(steps).alias("step"))
             .select("word", "n", *(m.alias(c) for m, c in zip(moved, counts, strict=True)))
             .where(F.least(*counts) >= 0).select(subtree, "word", "n"))
    n_entries = entries.groupBy("subtree").agg(F.count("*").alias("e"))
    n_asked = asked.groupBy("subtree").agg(F.count("*").alias("q"))
    sizes = small(stage(n_entries.join(n_asked, "subtree").select(
        "subtree", F.ceil(F.col("e") / BLOCK).cast("int").alias("bi"), F.ceil(F.col("q") / QUERIES).cast("int").alias("bj"))))
    own = F.xxhash64("word")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    entries = entries.join(sizes, "subtree").select(
        "subtree", F.pmod(own, "bi").cast("int").alias("i"), every("bj").alias("j"), F.lit(False).alias("asks"), "word", "n")
    asked = asked.join(sizes, "subtree").select(
        "subtree", every("bi").alias("i"), F.pmod(own, "bj").cast("int").alias("j"), F.lit(True).alias("asks"), "word", "n")
    unit = ["subtree", "i", "j"]
    return entries.union(asked).repartition(*unit).sortWithinPartitions(*unit, "asks")


class Words:
    """Words with their letters, lengths and frequency vectors."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.letters = np.array(words, f"U{SHORT}").view(np.uint32).reshape(len(words), SHORT)
        group = _GROUP[self.letters]
        self.vector = np.stack([(group == k).sum(axis=1) for k in range(GROUPS)], axis=1).astype(np.int32)
        for i in np.flatnonzero(self.size > SHORT):
            codes = np.frombuffer(words[i].encode("utf-32-le"), np.uint32)
            self.vector[i] = np.bincount(_GROUP[codes], minlength=GROUPS)[:GROUPS]


class Trie:
    """Entries in the order of their frequency vectors: a node is a run of them."""

    def __init__(self, entries: Words):
        order = np.lexsort(entries.vector.T[::-1])
        self.entries, self.order = entries, order
        self.vector = np.ascontiguousarray(entries.vector[order])

    def search(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, entry) places whose vectors differ by a surplus and a deficit of one at most."""
        every = np.arange(len(queries))
        one = np.ones(len(queries), np.int8)
        stack = [(0, len(self.order), 0, every, one, one)]
        while stack:
            low, high, level, asking, surplus, deficit = stack.pop()
            if high - low <= LEAF or level == GROUPS:
                yield from self._leaf(low, high, level, queries, asking, surplus, deficit)
                continue
            column = self.vector[low:high, level]
            starts = np.flatnonzero(np.diff(column, prepend=column[0] - 1))
            wanted = queries[asking, level]
            for start, end in zip(starts, np.append(starts[1:], high - low), strict=True):
                change = column[start] - wanted
                stay = np.flatnonzero((change <= surplus) & (-change <= deficit))
                if len(stay):
                    change = change[stay]
                    stack.append((low + start, low + end, level + 1, asking[stay],
                                  (surplus[stay] - np.maximum(change, 0)).astype(np.int8),
                                  (deficit[stay] - np.maximum(-change, 0)).astype(np.int8)))

    def _leaf(self, low, high, level, queries, asking, surplus, deficit):
        step = max(1, (1 << 16) // (high - low))
        for at in range(0, len(asking), step):
            part = slice(at, at + step)
            change = self.vector[None, low:high, level:] - queries[asking[part], None, level:]
            more = np.maximum(change, 0).sum(axis=2)
            less = more - change.sum(axis=2)
            q, e = np.nonzero((more <= surplus[part, None]) & (less <= deficit[part, None]))
            if len(q):
                yield asking[part][q], self.order[low + e]


def one_edit(left: Words, right: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of pairs whose right word is one replaced or one inserted letter from the left one."""
    more = right.size[b] - left.size[a]
    short = right.size[b] <= SHORT
    good = np.zeros(len(a), bool)
    same = np.flatnonzero(short & (more == 0))
    good[same] = (left.letters[a[same]] != right.letters[b[same]]).sum(axis=1) == 1
    longer = np.flatnonzero(short & (more == 1))
    x, y = left.letters[a[longer]], right.letters[b[longer]]
    first = np.argmax(x != y, axis=1)  # the longer word has a letter where the shorter one has ended
    place = np.arange(SHORT - 1)[None, :]
    shifted = (x[:, :-1] == y[:, 1:]) | (place < first[:, None])
    good[longer] = shifted.all(axis=1)
    for k in np.flatnonzero(~short & ((more == 0) | (more == 1))):
        x, y = left.words[a[k]], right.words[b[k]]
        i = _common(x, y)
        good[k] = x != y and x[i + (len(x) == len(y)):] == y[i + 1:]
    return np.flatnonzero(good)


def _common(x: str, y: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(x), len(y))
    while low < high:
        middle = (low + high + 1) // 2
        if x[low:middle] == y[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _later(left: Words, right: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of equal length those whose right word comes later by (first counts, word); all others."""
    change = right.vector[b, :TOP] - left.vector[a, :TOP]
    lead = np.take_along_axis(change, np.argmax(change != 0, axis=1)[:, None], axis=1)[:, 0]
    keep = (right.size[b] > left.size[a]) | (lead > 0)
    for k in np.flatnonzero((right.size[b] == left.size[a]) & (lead == 0)):
        keep[k] = right.words[b[k]] > left.words[a[k]]
    return keep


def _near(trie: Trie, queries: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in trie.search(queries.vector):
        stay = one_edit(queries, trie.entries, a, b)
        a, b = a[stay], b[stay]
        keep = _later(queries, trie.entries, a, b)
        if keep.any():
            yield a[keep], b[keep]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of every unit; its entries come before its queries."""
    unit, held, trie = None, [], None
    for batch in batches:
        change = np.zeros(batch.num_rows, bool)
        for c in ("subtree", "i", "j", "asks"):
            code = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(change | (np.arange(batch.num_rows) == 0))
        for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
            part = batch.slice(start, end - start)
            key = tuple(part.column(c)[0].as_py() for c in ("subtree", "i", "j"))
            if key != unit:
                unit, held, trie = key, [], None
            if not part.column("asks")[0].as_py():
                held.append(part)
                continue
            if trie is None:
                trie = Trie(_words(held)) if held else None
            for at in range(0, part.num_rows if trie else 0, CHUNK):
                queries = _words([part.slice(at, CHUNK)])
                pairs = list(_near(trie, queries))
                if pairs:
                    a, b = (pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True))
                    left, right = (pa.array(w.words, pa.string()).take(x) for w, x in ((queries, a), (trie.entries, b)))
                    yield pa.RecordBatch.from_arrays(
                        [left, pa.array(queries.n).take(a), right, pa.array(trie.entries.n).take(b)], names=["a", "n_a", "b", "n_b"])


def _words(parts: list[pa.RecordBatch]) -> Words:
    table = pa.Table.from_batches(parts)
    return Words(table.column("word").to_pylist(), table.column("n").to_numpy())


def near_words(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): every pair of distinct words (word, n) one edit apart, once."""
    return _units(words).mapInArrow(_found, "a string, n_a long, b string, n_b long")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: the last one on the way of forms.

    Pointers are doubled, so the rounds grow with the logarithm of the longest way.
    Counts at least double from word to form: a way has no circle.
    """
    now = stage(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stage(now.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = then.select("word", "root")
        if not then.where("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of all texts with the form that each is a likely misspelling of.

    Words are maximal runs of `[A-Za-zÀ-ÿ]`, A-Z lower-cased, of at least 5
    code points and 3 occurrences (`noisy` takes a letter out of some first).
    Returns `word`, `form` (its near word of largest count, the smallest in code
    point order of equal ones, if that count is at least twice its own; else null),
    `root` (the end of the way of forms), `n`, `n_near`, `form_n`. Null and empty
    texts have no words; repeated rows count again; a null id is an empty id. An
    empty table gives no rows. Words may be of any length; other columns are not read.
    """
    words = stage(vocabulary(docs, id_col, text_col))
    pairs = near_words(words)
    both = F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")),
                            F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m"))))
    best = F.min(F.struct((-F.col("m")).alias("m"), "near"))
    near = pairs.select(both).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    common = -F.col("best.m") >= RATIO * F.col("n")
    known = stage(words.join(near, "word", "left").select(
        "word", F.when(common, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, -F.col("best.m")).alias("form_n")))
    roots = follow(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
