"""Date helpers: text parsing, month keys and month arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import round_to

DAYS_PER_MONTH = 30.44


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(c: Column | str) -> Column:
    """'YYYY-MM-DD' text to a date; unreadable text gives NULL."""
    return F.try_to_date(_col(c), "yyyy-MM-dd")


def us_date(c: Column | str) -> Column:
    """'MM/DD/YYYY' text to a date; unreadable text gives NULL."""
    return F.try_to_date(_col(c), "MM/dd/yyyy")


def hour_of_time(c: Column | str) -> Column:
    """Hour of 'HH:MM' or 'H:MM' text: the digits its first two characters begin with."""
    return F.regexp_extract(F.substring(_col(c), 1, 2), r"^\s*(\d+)", 1).try_cast("int")


def month_key(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def month_start(key: Column | str) -> Column:
    """First day of a 'YYYY-MM' key."""
    return F.try_to_date(F.concat(_col(key), F.lit("-01")), "yyyy-MM-dd")


def year_of_key(key: Column | str) -> Column:
    return F.substring(_col(key), 1, 4)


def add_months_to_key(key: Column | str, months: int) -> Column:
    return month_key(F.add_months(month_start(key), months))


def month_index(c: Column | str) -> Column:
    """Months since year 0: consecutive months differ by one."""
    value = _col(c)
    return F.year(value) * 12 + F.month(value) - 1


def months_between_index(end: Column | str, start: Column | str) -> Column:
    return month_index(end) - month_index(start)


def months_open(start: Column | str, end: Column | str, snapshot: str | Column,
                days: float = DAYS_PER_MONTH) -> Column:
    """Months from start to end, or to the snapshot while still open, 1 dp."""
    until = F.coalesce(_col(end), F.to_date(F.lit(snapshot)) if isinstance(snapshot, str) else snapshot)
    return round_to(F.datediff(until, _col(start)) / F.lit(days), 1)
