"""Scalar Column helpers. Everything stays in JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c: Column | str) -> Column:
    return _col(c).cast("double")


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b in doubles; NULL when b is 0 or NULL (ANSI `/` would raise)."""
    return F.try_divide(as_double(a), as_double(b))


def round_to(c: Column | str, digits: int) -> Column:
    """Round half away from zero as a reader of the decimal text would.

    A double such as 28.499999999999996 is first brought to 12 decimals, so a
    different summation order cannot flip a rounding tie.
    """
    return F.round(_col(c).cast("decimal(38,12)"), digits).cast("double")


def pct(a: Column | str, b: Column | str, digits: int | None = 2) -> Column:
    """100 * a / b; the factor is a double, a DECIMAL literal would cut digits."""
    rate = F.try_divide(F.lit(100.0) * as_double(a), as_double(b))
    return rate if digits is None else round_to(rate, digits)


def per_mille(a: Column | str, b: Column | str, digits: int = 2) -> Column:
    return round_to(F.try_divide(F.lit(1000.0) * as_double(a), as_double(b)), digits)


def flag(c: Column | str, yes: str = "Yes") -> Column:
    """Yes/No text to a summable 0/1; NULL text counts as 0."""
    return F.when(_col(c) == yes, F.lit(1)).otherwise(F.lit(0))


def band(c: Column | str, edges: Sequence, labels: Sequence[str], inclusive: bool = False,
         null_label: str | None = None) -> Column:
    """Label by ascending upper edges (`<`, or `<=` when inclusive).

    len(labels) == len(edges) + 1. NULL falls to the last label, as in a
    searched CASE with an ELSE branch, unless null_label routes it elsewhere.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("band needs one more label than edges")
    value = _col(c)
    out = F.when(value.isNull(), F.lit(null_label)) if null_label is not None else None
    for edge, label in zip(edges, labels):
        test = value <= edge if inclusive else value < edge
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def ordinal(c: Column | str, values: Sequence[str]) -> Column:
    """1-based position of a category in its natural order; NULL if unlisted."""
    value = _col(c)
    position = F.array_position(F.array(*[F.lit(v) for v in values]), value)
    return F.nullif(position, F.lit(0))


def clamp(c: Column | str, lo=None, hi=None) -> Column:
    """Limit a value; NULL stays NULL (greatest/least would replace it)."""
    value = _col(c)
    out = value
    if lo is not None:
        lo = lo if isinstance(lo, Column) else F.lit(lo)
        out = F.when(value < lo, lo).otherwise(out)
    if hi is not None:
        hi = hi if isinstance(hi, Column) else F.lit(hi)
        out = F.when(value > hi, hi).otherwise(out)
    return out


def null_if_sentinel(target: Column | str, sentinels: dict[str, object]) -> Column:
    """NULL where every named column equals its sentinel at the same time."""
    hit = F.lit(True)
    for name, value in sentinels.items():
        hit = hit & (F.col(name) == F.lit(value))
    return F.when(hit, F.lit(None)).otherwise(_col(target))


def label_null(c: Column | str, label: str) -> Column:
    return F.coalesce(_col(c), F.lit(label))


def verdict(test: Column, yes: str, no: str) -> Column:
    """Two-way label; a NULL test gives the second label."""
    return F.when(test, F.lit(yes)).otherwise(F.lit(no))
