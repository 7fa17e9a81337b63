"""Fixity audit of WARC replicas with Merkle trees.

A replica is a table of records at places (file, ordinal). Each record is hashed;
64 consecutive records form a range, 64 ranges a file, and files are combined 64
by 64 up to one root. A node's hash covers number, bytes and hash of its children
in order, so it fixes the ordered offset ranges below it. The audit compares the
roots and follows only branches that differ, down to the records.

Payloads are hashed where they are read. Only digests are shuffled, a node never
has more than 64 children, and every level is a 64th of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.graph import small
from tidemark.runtime import stage

BITS = 6  # 64 children a node
FILE_BITS = 2 * BITS  # 4096 records a file


def warc_record(url: Column, payload: Column) -> Column:
    """The response record of a page; a null URL or payload is empty."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload, F.lit("\r\n\r\n"))


def manifest(rows: DataFrame, replicas: dict[str, Column], *keep: str) -> DataFrame:
    """Places, sizes and digests of the records of all replicas, written once.

    `replicas` gives each replica's record for a row (null: not in that replica).
    A task lays its rows out in files of 4096 records in reading order; the table
    written here fixes these places for all that follows, so neither a key nor a
    repeated row can make a file larger than others.
    """
    place = F.monotonically_increasing_id()
    out = rows.select(
        F.shiftright(place, FILE_BITS).alias("block"), F.pmod(place, F.lit(1 << FILE_BITS)).cast("long").alias("ordinal"),
        *(F.col(c) for c in keep),
        *(F.octet_length(record).cast("long").alias(f"size_{name}") for name, record in replicas.items()),
        *(F.sha2(record.cast("binary"), 256).alias(f"sha256_{name}") for name, record in replicas.items()))
    out = stage(out)
    # Files numbered closely: the task's number, then the file of the task.
    task, own = F.shiftright("block", 33 - FILE_BITS), F.pmod("block", F.lit(1 << (33 - FILE_BITS)))
    most = out.agg(F.max(own)).first()[0] or 0
    return out.withColumn("file", task * (1 << most.bit_length()) + own).drop("block")


def _parents(level: DataFrame) -> DataFrame:
    """The level above: hash over number, bytes and hash of the children in order."""
    child = F.struct("key", "bytes", "hash")
    line = F.transform(F.array_sort(F.collect_list(child)),
                       lambda c: F.concat_ws(":", c["key"].cast("string"), c["bytes"].cast("string"), c["hash"]))
    return (level.groupBy("side", F.shiftright("key", BITS).alias("key"))
            .agg(F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws(",", line), 256).alias("hash")))


def build_tree(records: DataFrame, left: str, right: str) -> list[DataFrame]:
    """Levels (side, key, bytes, hash) of both replicas, records first, root last."""
    key = F.col("file") * (1 << FILE_BITS) + F.col("ordinal")
    side = {name: records.where(F.col(f"size_{name}").isNotNull()).select(
        F.lit(name).alias("side"), key.alias("key"), F.col(f"size_{name}").alias("bytes"),
        F.col(f"sha256_{name}").alias("hash")) for name in (left, right)}
    levels = [side[left].union(side[right])]
    while True:
        levels.append(stage(_parents(levels[-1])))
        if not (levels[-1].agg(F.max("key")).first()[0] or 0):
            return levels


def differing(level: DataFrame, left: str, right: str) -> DataFrame:
    """Keys whose hashes differ between the replicas, or that one of them lacks."""
    def own(name: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col("hash")))

    return (level.groupBy("key").agg(own(left).alias("a"), own(right).alias("b"))
            .where(~F.col("a").eqNullSafe(F.col("b"))).select("key"))


def audit(records: DataFrame, left: str, right: str) -> DataFrame:
    """Records in which two replicas differ, with their offsets in the left one.

    `records` is a manifest. Returns its columns with `offset` (of the record in
    the left replica's file, whether or not it is there), `end`, and `kind`:
    `missing` or `extra` on the right, `resized`, or `altered` (equal size). Equal
    roots end the audit with no rows; an empty manifest has none.
    """
    levels = build_tree(records, left, right)
    wrong = stage(differing(levels[-1], left, right))
    for level in levels[-2::-1]:
        branch = F.shiftright("key", BITS)
        below = level.join(small(wrong.select(F.col("key").alias("up"))), branch == F.col("up"), "left_semi")
        wrong = stage(differing(below, left, right))
    key = F.col("file") * (1 << FILE_BITS) + F.col("ordinal")
    files = stage(wrong.select(F.shiftright("key", FILE_BITS).alias("file")).distinct())
    size = F.coalesce(f"size_{left}", F.lit(0))
    before = F.sum(size).over(Window.partitionBy("file").orderBy("ordinal")) - size
    found = (records.join(small(files), "file", "left_semi")
             .withColumns({"offset": before, "end": before + size, "key": key})
             .join(small(wrong), "key", "left_semi").drop("key"))
    a, b = F.col(f"size_{left}"), F.col(f"size_{right}")
    return found.withColumn("kind", F.when(b.isNull(), "missing").when(a.isNull(), "extra")
                            .when(a != b, "resized").otherwise("altered"))


def damaged(page_id: Column, url: Column, payload: Column) -> Column:
    """A second replica to audit: of 97 parts by MD5 of the id, one is altered, one cut, one lost."""
    part = F.conv(F.substring(F.md5(F.coalesce(page_id.cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int") % 97
    payload = F.coalesce(payload, F.lit(""))
    return (F.when(part == 1, warc_record(url, F.concat(F.lit("#"), F.substring(payload, 2, 1 << 30))))
            .when(part == 2, warc_record(url, F.left(payload, F.greatest(F.length(payload) - 10, F.lit(0)))))
            .when(part != 3, warc_record(url, payload)))
