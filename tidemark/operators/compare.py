"""Two loads of one table compared as multisets: no order, repeats counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import stage


def row_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Every distinct row of either load with its number in both, n_old and n_new.

    One aggregate; repeated rows collapse before the shuffle. NULLs equal each other, as
    do NaNs. Both loads have the same column names, in any order.
    """
    if sorted(old.columns) != sorted(new.columns):
        raise ValueError(f"columns differ: {sorted(set(old.columns) ^ set(new.columns))}")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    both = old.withColumns({"n_old": one, "n_new": zero}).unionByName(new.withColumns({"n_old": zero, "n_new": one}))
    return both.groupBy(*old.columns).agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))


def multiset_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows that are not equally often in both loads; none when they are equal."""
    return row_counts(old, new).where("n_old <> n_new")


def compare_loads(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The keys whose rows differ: key, status, n_old, n_new, changed.

    n_old and n_new count all rows of the key. Status: `added` and `dropped` for a key of
    one load only; `repeated` if both hold the same distinct rows in other numbers; else
    `changed`, with the comma-joined names of the columns whose values, as multisets, differ.
    That is '' if only the pairing of values has changed, and NULL for the other statuses. A
    NULL in the key is a value like others. Columns are to be of comparable types.
    """
    key = list(key)
    cells = stage(row_counts(old, new))
    differs = F.col("n_old") != F.col("n_new")
    one_sided = differs & ((F.col("n_old") == 0) | (F.col("n_new") == 0))
    keys = cells.groupBy(*key).agg(
        F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"), F.max(differs).alias("_differs"),
        F.max(one_sided).alias("_one_sided")).where("_differs")
    rest = [c for c in old.columns if c not in key]
    status = (F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "dropped")
              .when(~F.col("_one_sided"), "repeated").otherwise("changed"))
    out = keys.select(*key, status.alias("status"), "n_old", "n_new")
    if not rest:
        return out.withColumn("changed", F.when(F.col("status") == "changed", ""))
    # a column changes where some value of it occurs more often on one side
    values = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("string").alias("_value")) for c in rest]
    columns = (
        cells.where(differs).select(*key, (F.col("n_new") - F.col("n_old")).alias("_more"), F.inline(F.array(*values)))
        .groupBy(*key, "_column", "_value").agg(F.sum("_more").alias("_more")).where("_more <> 0")
        .groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set("_column")), ",").alias("_columns")))
    columns = columns.select(*[F.col(k).alias(f"_key_{k}") for k in key], "_columns")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    changed = F.when(F.col("status") == "changed", F.coalesce("_columns", F.lit("")))
    return out.join(columns, same, "left").withColumn("changed", changed).select(
        *key, "status", "n_old", "n_new", "changed")
