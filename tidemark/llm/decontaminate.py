"""Benchmark decontamination: which documents contain a test item.

Containment is the share of an item's distinct five-word shingles that occur in
the whole document. Items are short and documents long, so signatures of equal
length on both sides would miss most hits (an item of 40 shingles inside a
document of 20,000 has a Jaccard similarity of 0.002). Items are therefore
partitioned by size, and an item is represented by its bottom-k MinHash sketch
with k chosen by its size: an item of q shingles needs m = ceil(0.8 q) of them
in the document, so of its q - m + 1 least hash values at least one occurs in
every document that contains it. A document's hash values are probed against the
sketches of the partitions it is large enough for; none of its values is left
out, so no containing document is missed. Candidates are counted on hashes and
then verified on the words themselves.

Items enter in blocks of bounded size, each one broadcast index and one pass over
the documents; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import ALNUM, Words, in_slices, windows, words_of

WIDTH = 5
LOW, HIGH = 4, 5  # containment of at least 4/5
BLOCK_BYTES = 32 << 20
_FILTER = 1 << 22


def needed(size: int) -> int:
    """Shingles of an item of this size that a document must hold."""
    return -(-size * LOW // HIGH)


@dataclass
class Partition:
    """Items of one size class: fewest shingles needed, sketch values and their items."""

    least: int
    sketch: np.ndarray
    item: np.ndarray


@dataclass
class Index:
    """Items by position: ids, shingle hashes, words; sketches by size class."""

    ids: list
    hashes: list[np.ndarray]
    words: list[list[bytes]]
    partitions: list[Partition]

    def filter(self) -> np.ndarray:
        """One bit for each possible low part of a sketch value."""
        bits = np.zeros(_FILTER, bool)
        for part in self.partitions:
            bits[part.sketch & np.uint64(_FILTER - 1)] = True
        return bits


def folded(texts: Iterable[str | None]) -> pa.Array:
    """Case-folded texts in UTF-8, so that a passage in capitals is found; null is empty."""
    return pa.array([(t or "").casefold().encode() for t in texts], pa.large_binary())


def _word_list(words: Words, i: int) -> list[bytes]:
    part = words.of(i)
    return [words.buffer[a:b].tobytes() for a, b in zip(words.start[part], words.end[part], strict=True)]


def _shingles(words: list[bytes]) -> set[tuple[bytes, ...]]:
    return set(zip(*(words[k:] for k in range(WIDTH)), strict=False))


def build_index(ids: list, texts: list[str | None]) -> Index:
    """Sketches of a block of items. Items of fewer than five words have no shingle and take no part."""
    words = words_of(folded(texts), ALNUM)
    index = Index([], [], [], [])
    classes: dict[int, list[int]] = {}
    for i in range(len(words)):
        hashes = np.unique(windows(words.hash[words.of(i)], WIDTH))
        if len(hashes):
            classes.setdefault(len(hashes).bit_length(), []).append(len(index.ids))
            index.ids.append(ids[i])
            index.hashes.append(hashes)
            index.words.append(_word_list(words, i))
    for members in classes.values():
        sketches = [index.hashes[k][:len(index.hashes[k]) - needed(len(index.hashes[k])) + 1] for k in members]
        values = np.concatenate(sketches)
        item = np.repeat(np.array(members), [len(s) for s in sketches])
        order = np.argsort(values, kind="stable")
        index.partitions.append(
            Partition(min(needed(len(index.hashes[k])) for k in members), values[order], item[order]))
    return index


def _candidates(index: Index, hashes: np.ndarray, distinct: int) -> set[int]:
    """Items of which a document has a sketch value; hashes: those that pass the filter."""
    found: set[int] = set()
    for part in index.partitions:
        if distinct >= part.least:
            lo = np.searchsorted(part.sketch, hashes, "left")
            hi = np.searchsorted(part.sketch, hashes, "right")
            for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update(part.item[a:b].tolist())
    return found


class Search:
    """Items contained in the texts of a batch, found with one index."""

    def __init__(self, index: Index):
        self.index, self.bits, self.sets = index, index.filter(), {}

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of each containment of at least 0.8."""
        words = words_of(folded(v.as_py() for v in texts), ALNUM)
        every = windows(words.hash, WIDTH)
        hit = np.flatnonzero(self.bits[every & np.uint64(_FILTER - 1)])
        owner = np.searchsorted(words.first, hit, "right") - 1
        inside = hit + WIDTH <= words.first[owner + 1]  # not across two texts
        hit, owner = hit[inside], owner[inside]
        for row in np.unique(owner).tolist():
            first, last = words.first[row], words.first[row + 1] - WIDTH + 1
            probes = np.unique(every[hit[np.searchsorted(owner, row):np.searchsorted(owner, row, "right")]])
            found = _candidates(self.index, probes, last - first)
            if not found:
                continue
            own, full = np.unique(every[first:last]), None
            for k in sorted(found):
                mine = self.index.hashes[k]
                if np.isin(mine, own, assume_unique=True).sum() < needed(len(mine)):
                    continue
                if full is None:
                    full = _shingles(_word_list(words, row))
                if k not in self.sets:
                    self.sets[k] = _shingles(self.index.words[k])
                shared = len(self.sets[k] & full)
                if shared >= needed(len(self.sets[k])):
                    yield row, k, shared


def _pairs(index, item_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(index.value)
        for batch in in_slices(batches, "text"):
            found = list(search(batch.column("text")))
            size = [len(search.sets[k]) for _, k, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array([r for r, _, _ in found], pa.int64())),
                 pa.array([index.value.ids[k] for _, k, _ in found], item_type),
                 pa.array([n for _, _, n in found], pa.int64()), pa.array(size, pa.int64())],
                names=["doc_id", "item_id", "n_shared", "n_item"])

    return run


def _clean(index, text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(index.value)
        for batch in in_slices(batches, text_col):
            texts = batch.column(batch.schema.get_field_index(text_col))
            clean = np.ones(batch.num_rows, bool)
            clean[[row for row, _, _ in search(texts)]] = False
            yield batch.filter(pa.array(clean))

    return run


def _indexes(items: DataFrame, item_col: str, item_text_col: str, block_bytes: int) -> Iterator:
    """Broadcast indexes over blocks of items of about `block_bytes` of text each."""
    wanted = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        rows = wanted.where(block == b).collect()
        yield items.sparkSession.sparkContext.broadcast(build_index([r.item_id for r in rows], [r.text for r in rows]))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    item_col: str = "item_id", item_text_col: str = "text",
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(document, item) pairs with a containment of at least 0.8.

    Returns `doc_id`, `item_id`, `n_shared`, `n_item` (distinct shingles),
    `containment`. Words are runs of ASCII letters and digits and of anything
    beyond ASCII, case-folded, so case, punctuation and spacing don't matter. A null
    or empty text contains nothing; an item of fewer than five words is contained
    nowhere. Null ids are kept. Each row of documents and each row of items counts
    for itself, so repeated rows give repeated pairs. Empty tables give no pairs.
    Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type, item_type = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, n_shared long, n_item long"
    arrow = {"string": pa.string(), "int": pa.int32()}.get(item_type, pa.int64())
    found = [rows.mapInArrow(_pairs(index, arrow), schema)
             for index in _indexes(items, item_col, item_text_col, block_bytes)]
    return reduce(DataFrame.union, found).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows, with all columns, whose text contains no item."""
    for index in _indexes(items, item_col, item_text_col, block_bytes):
        docs = docs.mapInArrow(_clean(index, text_col), docs.schema)
    return docs
