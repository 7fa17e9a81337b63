"""Lines that many documents share, dropped from all but one; DataFrame functions only.

1. Texts are exploded to lines. A line's key is the line without ASCII white space
   at its ends, A-Z lower-cased; keys of `least_chars` code points and more are
   hashed to 128 bits.
2. Distinct documents are counted per hash: equal lines of a document fold into
   one row first, and hashes combine on the map side, so that a line of all
   documents is no larger than any other.
3. The keys over the threshold meet the lines again; what comes out are the places
   of dropped lines, gathered per text.
4. Each text is put together again from its places less the dropped ones, in order.
   Both steps are linear in the lines of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import small
from tidemark.runtime import stage

LEAST_CHARS = 20
LEAST_DOCS = 3
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    """Lines of a text; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def fold(text: Column) -> Column:
    """A-Z in lower case, nothing else; a text of ASCII only takes the shorter way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return fold(F.btrim(line, F.lit(_WHITE)))


def keyed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc, t, place, h): 128-bit hash of every line key that is long enough; `t` is the text's."""
    keys = F.transform(lines(F.col("text")), line_key)
    return (docs.select("doc", _print(F.col("text")).alias("t"), F.posexplode(keys).alias("place", "key"))
            .where(F.length("key") >= least_chars)
            .select("doc", "t", "place", F.unhex(F.md5("key")).alias("h")))


def shared_keys(found: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(h, keeper): keys of at least `least_docs` documents and the greatest id among these.

    A document is an id; all rows without an id count as one.
    """
    each = found.select("h", "doc").distinct()
    return each.groupBy("h").agg(F.count("*").alias("docs"), F.max("doc").alias("keeper")).where(
        F.col("docs") >= least_docs).select("h", "keeper")


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Every text without the lines that at least `least_docs` documents hold.

    Returns one row per input row: `doc_id`, `n_lines` (before dropping),
    `n_dropped`, `text` (the other lines, joined by a line break). Of a shared key
    all lines stay in the greatest doc_id that holds it, its repeats included, and
    go from all other documents. Shorter keys and rarer ones stay. A null or empty
    text is one empty line. Rows of one id are one document: a line stays in all
    or in none of them. Rows without an id count as one document together, and
    never keep a shared line. An empty table gives no rows; other columns are not
    read, whatever their names. Texts and lines may be of any length.

    Runs jobs when called: hashes and places of lines are written once, and so are
    the shared keys, which are broadcast up to a counted bound. Beyond it the join
    shuffles and AQE splits hot keys.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    found = stage(keyed_lines(docs, least_chars))
    shared = small(stage(shared_keys(found, least_docs)))
    dropped = (found.join(shared, "h").where(~F.col("doc").eqNullSafe(F.col("keeper")))
               .groupBy(F.col("doc").alias("d"), "t").agg(F.collect_set("place").alias("places")))
    whole = docs.select("doc", _print(F.col("text")).alias("own"), lines(F.col("text")).alias("lines"))
    both = whole.join(dropped, F.col("doc").eqNullSafe(F.col("d")) & (F.col("own") == F.col("t")), "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "places")
    kept = F.when(F.col("places").isNull(), F.col("lines")).otherwise(
        F.transform(places, lambda i: F.get(F.col("lines"), i)))
    return both.select(F.col("doc").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
                       F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
                       F.array_join(kept, "\n").alias("text"))


def _print(text: Column) -> Column:
    """128 bits of a text, to tell rows of one id apart; null is like empty."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text))
