"""License scan: notice phrases, identifier tags, and licence expressions.

An Aho-Corasick automaton finds notice phrases and tag names over the text's
words, lower-cased and joined by one blank. The expression behind a tag is read
by a shunting-yard parser (`with` binds closer than `and`, that closer than `or`,
parentheses as usual) and evaluated to the licences it names and to the strictest
duty that a user who may choose cannot avoid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ("spdx license identifier", "license expression")
GRANTS = frozenset("licensed license released distributed under available permission terms".split())

# Label and duty of licence identifiers, by their start; the first fit holds.
PERMISSIVE, WEAK, STRONG, UNKNOWN = 1, 2, 3, 4
FAMILIES = (
    ("agpl", "agpl", STRONG), ("lgpl", "lgpl", WEAK), ("gpl", "gpl", STRONG), ("apache", "apache", PERMISSIVE),
    ("mit", "mit", PERMISSIVE), ("bsd", "bsd", PERMISSIVE), ("0bsd", "bsd", PERMISSIVE), ("isc", "isc", PERMISSIVE),
    ("bsl", "bsl", PERMISSIVE), ("zlib", "zlib", PERMISSIVE), ("unlicense", "public-domain", PERMISSIVE),
    ("mpl", "mpl", WEAK), ("epl", "epl", WEAK), ("cddl", "cddl", WEAK), ("eupl", "eupl", STRONG),
    ("cc0", "cc0", PERMISSIVE), ("cc-by-nc", "cc-by-nc", UNKNOWN), ("cc-by-nd", "cc-by-nd", UNKNOWN),
    ("cc-by-sa", "cc-by-sa", STRONG), ("cc-by", "cc-by", PERMISSIVE),
)
DUTIES = {PERMISSIVE: "permissive", WEAK: "weak copyleft", STRONG: "strong copyleft", UNKNOWN: "other"}

# Bytes beside 0-9, a-z and those beyond ASCII part words; A-Z is lower-cased.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))
_TAG = re.compile(r"(?:spdx-license-identifier|license-expression)[\"']?[ \t]*[:=][ \t]*[\"']?([^\r\n]*)", re.I | re.A)
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass(frozen=True)
class Licence:
    """Value of an expression: labels named in it, and the duty left."""

    labels: frozenset[str]
    duty: int


def licence(identifier: str) -> Licence:
    low = identifier.lower()
    for start, label, duty in FAMILIES:
        if low.startswith(start):
            return Licence(frozenset([label]), duty)
    return Licence(frozenset([low]), UNKNOWN)


def _apply(operator: str, left: Licence, right: Licence) -> Licence:
    if operator == "with":  # an exception loosens strong copyleft, and names no licence
        return Licence(left.labels, WEAK if left.duty == STRONG else left.duty)
    pick = min if operator == "or" else max
    return Licence(left.labels | right.labels, pick(left.duty, right.duty))


def evaluate(expression: str) -> Licence | None:
    """Value of the longest sound expression at the start; None if there is none.

    Reading ends where an operand or an operator cannot follow (as at a comment's
    end). An operator without its right side or an open parenthesis is unsound.
    """
    values: list[Licence] = []
    pending: list[str] = []
    operand = True  # an operand comes next
    at = 0

    def reduce() -> None:
        right, left = values.pop(), values.pop()
        values.append(_apply(pending.pop(), left, right))

    while m := _TOKEN.match(expression, at):
        token = m[1]
        binds = _BINDS.get(token.lower())
        if operand:
            if binds or token == ")":
                return None
            if token == "(":
                pending.append(token)
            else:
                values.append(licence(token))
                operand = False
        elif token == ")":
            if "(" not in pending:
                break
            while pending[-1] != "(":
                reduce()
            pending.pop()
        elif binds:
            while pending and pending[-1] != "(" and _BINDS[pending[-1]] >= binds:
                reduce()
            pending.append(token.lower())
            operand = True
        else:
            break
        at = m.end()
    if operand or "(" in pending:
        return None
    while pending:
        reduce()
    return values[0]


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, *TAGS]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@dataclass
class Scan:
    n_words: int
    base: list[tuple[int, str]]
    labels: set[str]
    duty: int | None
    score: float


def scan(text: bytes) -> Scan:
    """Licence marks of one text.

    `score` is 1 with a sound tag, 0.9 with a notice in a sentence that grants
    something (one of the grant words among the eight before it), 0.6 with any
    other notice, 0.3 with an unsound tag, else 0.
    """
    words = text.translate(_WORDS).split()
    line = f" {b' '.join(words).decode('latin-1')} "
    out = Scan(len(words), [], set(), None, 0.0)
    tagged = False
    seen = blanks = 0
    for last, phrase in _automaton().iter(line):
        if phrase in TAGS:
            tagged = True
            continue
        blanks += line.count(" ", seen, last)
        seen = last
        place = blanks - phrase.count(" ") - 1
        if phrase in BASE:
            out.base.append((place, BASE[phrase]))
        out.labels.add(BASE.get(phrase) or NOTICES[phrase])
        before = {w.decode("latin-1") for w in words[max(0, place - 8):place]}
        out.score = max(out.score, 0.9 if before & GRANTS else 0.6)
    if tagged:
        for m in _TAG.finditer(text.decode("utf-8", "replace")):
            value = evaluate(m[1])
            out.score = max(out.score, 0.3 if value is None else 1.0)
            if value is not None:
                out.labels |= value.labels
                out.duty = max(out.duty or 0, value.duty)
    return out


def _scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
             "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "duty": pa.string()}
    for batch in batches:
        out: dict[str, list] = {name: [] for name in types}
        for value in batch.column("text"):
            found = scan(value.as_py() or b"")
            places = [place for place, _ in found.base]
            base = {label for _, label in found.base}
            row = (found.n_words, len(places), min(places, default=None), max(places, default=None),
                   ",".join(sorted(base)), ",".join(sorted(base | found.labels)), found.score,
                   DUTIES.get(found.duty))
            for name, x in zip(types, row, strict=True):
                out[name].append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(out[n], t) for n, t in types.items())], names=["doc_id", *types])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices and tags of every whole text.

    Returns one row per input row: `doc_id`, `n_words`, `n_base` (places of base
    phrases), `first_word`, `last_word` (their smallest and largest start, words
    from 0; null without any), `base_labels`, `labels` (distinct, sorted, joined by
    commas; empty without any), `score`, `duty` (of tags; null without any). A null
    text counts as empty. Null ids and repeated rows are kept. Other columns are
    not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan_rows, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
                    "labels string, score double, duty string")
