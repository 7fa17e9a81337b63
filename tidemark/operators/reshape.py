"""Long and wide forms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_counts(df: DataFrame, ids: Sequence[str], parts: Mapping[str, tuple[str, str]],
                   names: tuple[str, str] = ("road_user", "outcome"), value: str = "value") -> DataFrame:
    """Wide count columns to one row per (first label, second label)."""
    cells = [
        F.struct(F.lit(a).alias(names[0]), F.lit(b).alias(names[1]), F.col(c).alias(value))
        for c, (a, b) in parts.items()
    ]
    return df.select(*ids, F.inline(F.array(*cells)))


def stack_rows(one_row: DataFrame, labels: Mapping[str, Mapping[str, str]], name: str) -> DataFrame:
    """Labelled rows from one totals row, without reading the source again."""
    cells = [
        F.struct(F.lit(label).alias(name), *[F.col(src).alias(out) for out, src in cols.items()])
        for label, cols in labels.items()
    ]
    return one_row.select(F.inline(F.array(*cells)))


def pivot_matrix(cells: DataFrame, row: str, column: str, value: str, columns: Sequence) -> DataFrame:
    """Long cells to a matrix with stated columns; missing cells are NULL."""
    return cells.groupBy(row).pivot(column, list(columns)).agg(F.max(value))
