"""The query catalogue: one entry per operator, each with its SQL check."""

from tidemark.queries import (  # noqa: F401
    aggregates,
    churn,
    cleaning,
    extended,
    incidents,
    joins,
    measures,
    profit,
    quality,
    scalars,
    sources,
    value,
    windows,
)
from tidemark.queries.base import CATALOGUE

__all__ = ["CATALOGUE"]
