"""Data-quality audits: each is one pass over its table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pct, round_to
from tidemark.operators.aggregate import count_distinct_key, rows, value_counts
from tidemark.runtime import materialize, partitions_for, shuffled_wide, spread_rows


def row_and_key_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and rows beyond them, via one row per key."""
    per_key = df.groupBy(key).agg(rows().alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.count(key).alias("distinct_keys"),
        (F.coalesce(F.sum("_n"), F.lit(0)) - F.count(key)).alias("duplicate_rows"),
    )


def likely_duplicates(df: DataFrame, composite: Sequence[str]) -> DataFrame:
    return df.agg((rows() - count_distinct_key(*composite)).alias("likely_duplicates"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count of every column, as (column_name, null_count) rows."""
    cols = list(cols or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in cols]
    return counts.select(F.inline(F.array(*cells)))


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking each named rule (the predicate describes a violation)."""
    return df.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])


def domain_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values of several categorical columns in one pass."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*cells))).dropna(subset=["value"]).distinct()


def range_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """MIN and MAX of every named column."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def cross_table_reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row control totals side by side."""
    return left.crossJoin(F.broadcast(right))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent; a NULL key is an orphan."""
    return child.join(parent.select(key), key, "left_anti")


def orphan_report(child: DataFrame, parent: DataFrame, key: str, value: str) -> DataFrame:
    """Orphan lines, their value and their share of all lines.

    One row per key is matched against the parent, so a hot orphan key does
    not travel row by row.
    """
    per_key = child.groupBy(key).agg(rows().alias("_n"), F.sum(value).alias("_v"))
    known = parent.select(F.col(key), F.lit(True).alias("_known")).distinct()
    missing = F.col("_known").isNull()
    return per_key.join(known, key, "left").agg(
        F.sum(F.when(missing, F.col("_n")).otherwise(F.lit(0))).alias("orphan_lines"),
        round_to(F.sum(F.when(missing, F.col("_v"))), 2).alias("orphan_value"),
        pct(F.sum(F.when(missing, F.col("_n")).otherwise(F.lit(0))), F.sum("_n")).alias("pct_of_all_lines"),
    )


def negative_value_report(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) < 0).agg(
        rows().alias("negative_rows"), round_to(F.sum(col), 2).alias("total_negative_value"))


def component_reconcile(df: DataFrame, checks: Mapping[str, tuple[str, Sequence[str]]],
                        tolerance: float = 0.0) -> DataFrame:
    """Rows checked and, per check, NULL totals and totals off their parts.

    A comparison with a NULL in it is not counted as a mismatch.
    """
    aggs = [rows().alias("rows_checked")]
    for name, (total, parts) in checks.items():
        combined = F.col(parts[0])
        for part in parts[1:]:
            combined = combined + F.col(part)
        off = F.abs(F.col(total) - combined) > F.lit(tolerance)
        aggs += [F.count_if(F.col(total).isNull()).alias(f"{name}_null"), F.count_if(off).alias(f"{name}_mismatch")]
    return df.agg(*aggs)


def spine_completeness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct composite keys and the size of the full key grid."""
    per_key = df.groupBy(*keys).agg(rows().alias("_n"))
    grid = F.countDistinct(keys[0])
    for k in keys[1:]:
        grid = grid * F.countDistinct(k)
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    return per_key.agg(F.sum("_n").alias("total_rows"), F.count_if(complete).alias("distinct_keys"),
                       grid.alias("expected_keys"))


def spine_gaps(df: DataFrame, first: str, second: str) -> DataFrame:
    """Pairs of the grid of two dimensions that no row has.

    The grid is what is asked for, and it holds distinct values only; the pairs
    that exist are taken off by a join. A NULL is a value of the grid and equals
    nothing, so its pairs are reported.
    """
    have = df.select(first, second).distinct()
    grid = have.select(first).distinct().crossJoin(have.select(second).distinct())
    return grid.join(have, [first, second], "left_anti").select(first, second)


def missing_rate_report(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Count and percent of rows where any column of a named group is NULL."""
    aggs = [rows().alias("total_rows")]
    for name, cols in groups.items():
        test = F.col(cols[0]).isNull()
        for c in cols[1:]:
            test = test | F.col(c).isNull()
        aggs += [F.count_if(test).alias(f"missing_{name}"),
                 pct(F.count_if(test), rows(), 1).alias(f"pct_missing_{name}")]
    return df.agg(*aggs)


def sentinel_count(df: DataFrame, sentinels: Mapping[str, object], name: str = "sentinel_rows") -> DataFrame:
    test = F.lit(True)
    for col, value in sentinels.items():
        test = test & (F.col(col) == F.lit(value))
    return df.agg(F.count_if(test).alias(name))


def variant_frequency(df: DataFrame, col: str, lowered: Sequence[str]) -> DataFrame:
    """Raw spellings whose lower-cased text is in the list, with counts."""
    return value_counts(df.where(F.lower(col).isin(*lowered)), col)


def exact_duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows, counted when called.

    The shuffles of what the rows come from are sized by its files as well.
    """
    spark = df.sparkSession
    with shuffled_wide(spark, partitions_for(spark, df.inputFiles())):
        return materialize(spread_rows(df).groupBy(*df.columns).agg(rows().alias("_n")).agg(
            F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")))
