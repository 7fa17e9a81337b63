"""Near-duplicate groups: MinHash bands with sequential Bayesian verification.

1. One scan turns every text into its set of word-pair hashes, a 128-bit print of
   the set, MinHash values in bands, and one byte of each value. Equal sets form
   a class; all further work is on classes.
2. Classes that share a band value are candidates. In each such bucket a member
   chosen by hash is the centre, and only member-centre pairs are made.
3. Pairs compare their signature bytes batch by batch and stop as soon as the
   posterior probability of reaching the threshold falls below `miss`. Survivors
   are verified on the full word-pair sets of the texts.
4. What the centres have joined is one component. Buckets with members of several
   components are gathered by their largest component, the host, so that a member
   of many alike buckets is there once. Of each host the members outside of it are
   compared, in blocks, with all others of its buckets. Survivors are verified as
   before. Together with step 2 every pair that shares a bucket is either in one
   component already or compared, so no candidate is left out.

Two sets at the threshold of 0.8 share no band with probability
(1 - 0.8 ** 6) ** 40 = 5e-6; more similar ones with less.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components, small
from tidemark.llm.words import SPACED, in_slices, mix, words_of
from tidemark.runtime import release, stage

ROWS, BANDS, BATCH = 6, 40, 24
HASHES = ROWS * BANDS
MISS = 1e-5
BLOCK = 512  # members of a block
BLOCK_BYTES = 4 << 20  # and their texts
WIDTH = 2  # words of a shingle
LOW, HIGH = 4, 5  # at least 100 * shared >= 80 * union

_random = np.random.default_rng(77)
_A = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of sequences of `width` words; fewer words are one shingle."""
    if len(words) < 2:
        return mix(words + np.uint64(1))
    width = min(width, len(words))
    total = words[:len(words) - width + 1]
    for k in range(1, width):
        total = total * _ROLL + words[k:len(words) - width + 1 + k]
    return np.unique(mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of each hash function over the shingles."""
    x = shingles.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at:at + 256, None] * _A + _B).min(axis=0), out=out)
    return out


def _features(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            words = words_of(batch.column("text"), SPACED)
            size, prints, bands, signs = [], [], [], []
            seen: dict[bytes, tuple[np.ndarray, bytes]] = {}
            for i in range(len(words)):
                own = words.hash[words.of(i)]
                if not len(own):
                    size.append(0)
                    prints.append(None)
                    bands.append(None)
                    signs.append(None)
                    continue
                shingles = shingle_hashes(own, width)
                key = blake2b(shingles.tobytes(), digest_size=16).digest()
                if key not in seen:
                    low = signature(shingles)
                    band = mix(low.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1))
                    total = np.arange(BANDS, dtype=np.uint64)
                    for row in range(ROWS):
                        total = mix(total * _ROLL + band[:, row])
                    seen[key] = total.view(np.int64), mix(low.astype(np.uint64)).astype(np.uint8).tobytes()
                size.append(len(shingles))
                prints.append(key)
                bands.append(seen[key][0])
                signs.append(seen[key][1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("h"), pa.array(size, pa.int64()), pa.array(prints, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(signs, pa.binary())],
                names=["id", "h", "n", "cls", "bands", "sig"])

    return run


def least_matches(low: float, miss: float) -> np.ndarray:
    """Matches a pair needs after each batch to stay in.

    With a uniform prior on the probability of a match, the posterior
    probability that it is at least p after m matches of n is
    P(Binomial(n + 1, p) <= m). One byte of two different values agrees in 1 of
    256 cases.
    """
    p = low + (1 - low) / 256
    needed = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss and m < n:
            m += 1
            total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        needed.append(m)
    return np.array(needed)


_NEEDED = least_matches(LOW / HIGH, MISS)


def survivors(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in the pair list (a, b) whose signatures stay above the bound."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k, need in enumerate(_NEEDED):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[a[alive], part] == right[b[alive], part]).sum(axis=1)
        stay = matches >= need
        alive, matches = alive[stay], matches[stay]
    return alive


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = np.arange(batch.num_rows)
        stay = survivors(_signs(batch.column("sig_a")), _signs(batch.column("sig_b")), every, every)
        yield batch.select(["a", "b"]).take(pa.array(stay))


@dataclass
class _Side:
    """Members of one block of a host."""

    cls: pa.Array
    comp: np.ndarray
    sig: np.ndarray
    text: pa.Array | None

    @staticmethod
    def of(members: pa.StructArray) -> _Side:
        text = members.field("text") if members.type.get_field_index("text") >= 0 else None
        return _Side(members.field("cls"), members.field("comp").to_numpy(zero_copy_only=False),
                     _signs(members.field("sig")), text)


def _candidates(left: _Side, right: _Side, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different components of two blocks that pass the bound."""
    step = max(1, (1 << 16) // max(1, len(right.comp)))
    for at in range(0, len(left.comp), step):
        apart = left.comp[at:at + step, None] != right.comp[None, :]
        if same:
            apart &= np.arange(at, at + len(apart))[:, None] < np.arange(len(right.comp))[None, :]
        a, b = np.nonzero(apart)
        a = a + at
        stay = survivors(left.sig, right.sig, a, b)
        if len(stay):
            yield a[stay], b[stay]


def _block_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bool, int, bool, _Side, _Side]]:
    for row in range(batch.num_rows):
        i, key, out, j = (batch.column(c)[row].as_py() for c in ("i", "key", "out", "j"))
        yield i, key, out, j, out and i == j, *(_Side.of(batch.column(c)[row].values) for c in ("x", "y"))


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of hosts that have a pair to verify."""
    for batch in batches:
        keys, outs, found = [], [], []
        for _, key, out, _, same, left, right in _block_rows(batch):
            for a, b in _candidates(left, right, same):
                for side, places, is_out in ((left, a, True), (right, b, out)):
                    chosen = side.cls.take(pa.array(np.unique(places)))
                    found.append(chosen)
                    keys += [key] * len(chosen)
                    outs += [is_out] * len(chosen)
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(outs), pa.concat_arrays(found).cast(pa.binary())],
                names=["key", "out", "cls"])


def _block_links(width: int) -> Callable:
    """Verified pairs of two blocks; none between components that a pair before has joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            for _, _, _, _, same, left, right in _block_rows(batch):
                parent: dict[int, int] = {}
                sets: dict[tuple[bool, int], set] = {}

                def root(c: int, parent: dict[int, int] = parent) -> int:
                    while parent.get(c, c) != c:
                        c = parent[c]
                    return c

                def shingles(side: _Side, i: int, sets: dict = sets, left: _Side = left) -> set:
                    k = side is left, i
                    if k not in sets:
                        sets[k] = shingle_set(side.text[i].as_py(), width)
                    return sets[k]

                for a, b in _candidates(left, right, same):
                    for i, j in zip(a.tolist(), b.tolist(), strict=True):
                        ends = root(int(left.comp[i])), root(int(right.comp[j]))
                        if ends[0] != ends[1] and similar(shingles(left, i), shingles(right, j)):
                            parent[ends[0]] = ends[1]
                            found_a.append(left.cls[i].as_py())
                            found_b.append(right.cls[j].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], names=["a", "b"])

    return run


def shingle_set(text: bytes, width: int = WIDTH) -> set[tuple[bytes, ...]]:
    """Distinct sequences of `width` words of a text with words; of fewer words, these."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space
    width = min(width, len(words))
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def similar(left: set, right: set) -> bool:
    """Whether the sets reach the threshold."""
    if min(len(left), len(right)) * HIGH < max(len(left), len(right)) * LOW:
        return False
    shared = len(left & right)
    return HIGH * shared >= LOW * (len(left) + len(right) - shared)


def _sets(width: int) -> Callable:
    """Pairs whose full sets of word pairs reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, set] = OrderedDict()

        def shingles(key: bytes, text: bytes) -> set:
            if key not in kept:
                kept[key] = shingle_set(text, width)
                while len(kept) > 1 and sum(map(len, kept.values())) > 200_000:
                    kept.popitem(last=False)
            kept.move_to_end(key)
            return kept[key]

        for batch in batches:
            stay = []
            columns = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            for i, (a, b, text_a, text_b) in enumerate(zip(*columns, strict=True)):
                if similar(shingles(a.as_py(), text_a.as_py()), shingles(b.as_py(), text_b.as_py())):
                    stay.append(i)
            yield batch.select(["a", "b"]).take(pa.array(stay, pa.int64()))

    return run


_PAIR = "a binary, b binary"


def _sided(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Pairs (a, b) with a column of the class table for either side."""
    for side in ("a", "b"):
        own = table.select(F.col("cls").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns))
        pairs = pairs.join(own, side)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Group documents whose sets of distinct sequences of `width` words are linked at 0.8 or more.

    Returns one row per input row: `doc_id`, `n_shingles`, `component_id` (the
    least id reachable by links), `kept` (the row has that id), and `text_hash`.
    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of
    fewer words has these as its only shingle. A null or wordless text has no
    shingles and is linked with nothing: it is its own component. Rows with a
    null id take part; such a row has `kept` false, or null where no id can be
    reached. Repeated rows are kept as rows and share a component. Other columns
    are not read, whatever their names.

    Runs jobs when called; its tables stay in the shared folder.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    features = stage(
        rows.select("id", F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("text"))
        .mapInArrow(_features(width), "id long, h long, n long, cls binary, bands array<bigint>, sig binary"))
    full = features.where("cls is not null")
    members = full.select("cls", F.explode("bands").alias("key")).distinct()
    buckets = members.groupBy("key").agg(F.count("*").alias("size"), F.min(F.xxhash64("cls", "key")).alias("centre"))
    shared = stage(members.join(buckets.where("size > 1"), "key")
                   .select("key", "cls", (F.xxhash64("cls", "key") == F.col("centre")).alias("is_centre")))

    named = shared.select("cls").distinct()
    classes = stage(
        full.join(named, "cls", "left_semi").groupBy("cls")
        .agg(F.min("h").alias("h"), F.first("sig").alias("sig")))
    texts = _texts_of(rows, classes)

    centres = shared.where("is_centre").groupBy("key").agg(F.min("cls").alias("b"))
    star = _pairs(shared.join(centres, "key").where("cls <> b").select(F.col("cls").alias("a"), "b"))
    star = stage(_sided(star, classes, "sig").mapInArrow(_prune, _PAIR))
    linked = stage(_verified(star, texts, width))
    joined = components(linked).select(F.col("node").alias("cls"), F.col("component").alias("comp"))

    release(star)
    more = _rest(shared, classes, stage(joined), texts, width)
    release(shared, classes, texts)
    groups = components(linked.union(more)).select(F.col("node").alias("cls"), "component")

    least = full.groupBy("cls").agg(F.min("id").alias("least")).join(groups, "cls", "left")
    least = least.withColumn("component", F.coalesce("component", "cls"))
    roots = least.groupBy("component").agg(F.min("least").alias("root"))
    labels = least.join(roots, "component").select("cls", "component", "root")
    out = features.select("id", "h", "n", "cls").join(labels, "cls", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("root")).alias("component_id"),
        F.hex("component").alias("group"), F.col("h").alias("text_hash"))
    kept: Column = F.when(F.col("component_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "group", "text_hash")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows, with all columns, without all but one row of every group of near-duplicates.

    The row of least id stays (null ids last, then by the text's hash); of rows
    that repeat it one stays. Texts without words are in no group and stay.
    """
    labels = stage(near_duplicates(docs, id_col, text_col, width).where("group is not null"))
    key = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_hash")
    best = labels.groupBy("group").agg(F.min(key).alias("best"))
    marked = labels.select("group", key.alias("own")).join(best, "group")
    gone = small(stage(marked.where("own <> best").select("own.doc_id", "own.text_hash").distinct()))
    again = small(stage(marked.where("own = best").groupBy("own.doc_id", "own.text_hash").count().where("count > 1")))
    columns = [F.col(f"row.{_quoted(c)}").alias(c) for c in docs.columns]
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"),
                       F.struct(*(F.col(_quoted(c)) for c in docs.columns)).alias("row"))

    def same(other: DataFrame) -> Column:
        return F.col("i").eqNullSafe(other["doc_id"]) & (F.col("h") == other["text_hash"])

    rows = rows.join(gone, same(gone), "left_anti")
    once = rows.join(again, same(again), "left_anti")
    if again.limit(1).count():
        once = once.union(rows.join(again, same(again), "left_semi").dropDuplicates(["i", "h"]))
    return once.select(*columns)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _texts_of(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, text) of the candidate classes, each text once."""
    wanted = classes.select("cls", "h")
    text = (rows.select(F.xxhash64("t").alias("h"), F.col("t").cast("binary").alias("text"))
            .join(small(wanted.select("h")), "h", "left_semi")
            .groupBy("h").agg(F.first("text").alias("text")))
    return stage(text.join(wanted, "h").select("cls", "text"))


def _verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    return _sided(pairs, texts, "text").mapInArrow(_sets(width), _PAIR)


def _rest(shared: DataFrame, classes: DataFrame, joined: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Verified pairs of different components that share a bucket."""
    rows = (shared.select("key", "cls").join(joined, "cls", "left")
            .withColumn("comp", F.xxhash64(F.coalesce("comp", "cls"))))
    size = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    # The largest component of a bucket of several is its host; ties go to the greater value.
    hosts = (size.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("k")).where("k > 1")
             .select(F.col("key").alias("bucket"), F.col("m.comp").alias("host")))
    rows = stage(rows.join(hosts, F.col("key") == F.col("bucket"))
                 .select(F.col("host").alias("key"), "cls", "comp", (F.col("comp") != F.col("host")).alias("out")).distinct())
    signs = classes.select("cls", "sig")
    blocks = _blocks(rows.join(signs, "cls").withColumn("size", F.lit(1)), BLOCK, ["cls", "comp", "sig"])
    named = stage(_pairs_of(blocks).mapInArrow(_involved, "key long, out boolean, cls binary").distinct())
    release(blocks)
    members = (rows.join(named, ["key", "out", "cls"]).join(signs, "cls").join(texts, "cls")
               .withColumn("size", F.greatest(F.octet_length("text"), F.lit(BLOCK_BYTES // BLOCK))))
    blocks = _blocks(members, BLOCK_BYTES, ["cls", "comp", "sig", "text"])
    found = stage(_pairs_of(blocks).mapInArrow(_block_links(width), _PAIR))
    release(rows, named, blocks)
    return found


def _blocks(members: DataFrame, most: int, columns: list[str]) -> DataFrame:
    """Members of a host, dealt by hash to as many blocks as their sizes ask for.

    Only hosts of several blocks need their sizes, and these are few.
    """
    members = stage(members)
    large = members.groupBy("key", "out").agg(F.ceil(F.sum("size") / most).alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("cls"), F.coalesce("blocks", F.lit(1))).alias("block")
    blocks = stage(members.join(small(stage(large)), ["key", "out"], "left")
                   .select("key", "out", block, F.struct(*columns).alias("member"))
                   .groupBy("key", "out", "block").agg(F.collect_list("member").alias("side")))
    release(members)
    return blocks


def _pairs_of(blocks: DataFrame) -> DataFrame:
    """Pairs of blocks of a host: each block outside of it with all others."""
    left = blocks.where("out").select("key", F.col("block").alias("i"), F.col("side").alias("x"))
    right = blocks.select("key", "out", F.col("block").alias("j"), F.col("side").alias("y"))
    return left.join(right, "key").where("not out or i <= j")
