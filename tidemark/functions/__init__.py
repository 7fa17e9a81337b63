from tidemark.functions.dates import (
    add_months_to_key,
    hour_of_time,
    iso_date,
    month_index,
    month_key,
    month_start,
    months_between_index,
    months_open,
    us_date,
    year_of_key,
)
from tidemark.functions.scalars import (
    as_double,
    band,
    clamp,
    flag,
    label_null,
    null_if_sentinel,
    ordinal,
    pct,
    per_mille,
    round_to,
    safe_div,
    verdict,
)
from tidemark.functions.text import canonical_text, strip_space, trim_clean

__all__ = [
    "add_months_to_key", "as_double", "band", "canonical_text", "clamp", "flag",
    "hour_of_time", "iso_date", "label_null", "month_index", "month_key",
    "month_start", "months_between_index", "months_open", "null_if_sentinel",
    "ordinal", "pct", "per_mille", "round_to", "safe_div", "strip_space",
    "trim_clean", "us_date", "verdict", "year_of_key",
]
