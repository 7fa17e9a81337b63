"""Text helpers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_clean(c: Column | str) -> Column:
    """Strip control characters, then surrounding blanks."""
    return F.trim(F.regexp_replace(_col(c), r"\p{Cntrl}", ""))


def strip_space(c: Column | str) -> Column:
    """Strip white space of any kind from both ends."""
    return F.regexp_replace(_col(c), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def canonical_text(c: Column | str, mapping: dict[str, str], strip: bool = False) -> Column:
    """Look a lower-cased spelling up in a small fixed mapping.

    A miss keeps the original text untouched (blanks included); NULL stays NULL.
    """
    value = _col(c)
    key = F.lower(strip_space(value) if strip else value)
    pairs = list(chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), value)
