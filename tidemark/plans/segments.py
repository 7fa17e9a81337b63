"""Segment reports shared by the domains: rates, shares and top reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pct, round_to
from tidemark.operators.aggregate import mean, rows, share_of_total, share_within
from tidemark.operators.window import top_k, top_per_group


def segment_rate(df: DataFrame, by: Sequence[str], flag: str = "is_churned", hits: str = "churned",
                 rate: str = "churn_rate_pct", size: str = "customers", digits: int = 2,
                 means: dict[str, str] | None = None) -> DataFrame:
    """Rows, flagged rows and their percentage per segment."""
    extra = [round_to(mean(c), 2).alias(n) for n, c in (means or {}).items()]
    return df.groupBy(*by).agg(rows().alias(size), F.sum(flag).alias(hits),
                               pct(F.sum(flag), rows(), digits).alias(rate), *extra)


def segment_rate_cuts(df: DataFrame, cuts: Sequence[Sequence[str]], flag: str = "is_churned") -> DataFrame:
    """Several segment cuts in one scan (grouping sets).

    The rows are first counted per finest combination, so that only those
    counts are expanded, not the input.
    """
    cols = sorted({c for cut in cuts for c in cut})
    fine = df.groupBy(*cols).agg(rows().alias("_n"), F.sum(flag).alias("_hits"))
    sets = fine.groupingSets([[F.col(c) for c in cut] for cut in cuts], *[F.col(c) for c in cols])
    names = F.concat_ws(" x ", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in cols])
    return sets.agg(names.alias("cut"), F.sum("_n").alias("customers"), F.sum("_hits").alias("churned"),
                    pct(F.sum("_hits"), F.sum("_n")).alias("churn_rate_pct"))


def riskiest_segments(df: DataFrame, by: Sequence[str], min_n: int = 15, k: int = 10) -> DataFrame:
    """Highest rates among segments of a sufficient size."""
    big = segment_rate(df, by).where(F.col("customers") >= min_n)
    return top_k(big, "churn_rate_pct", k, *by)


def reason_share(df: DataFrame, reason: str, name: str = "n", share: str = "pct_of_all",
                 digits: int = 2) -> DataFrame:
    """Count per reason and its percent of all rows given."""
    return share_of_total(df.groupBy(reason).agg(rows().alias(name)), name, share, digits)


def reason_matrix(df: DataFrame, by: str, reason: str, name: str = "n",
                  share: str = "pct_within") -> DataFrame:
    grouped = df.groupBy(by, reason).agg(rows().alias(name))
    return share_within(grouped, name, [by], share)


def top_reason_per(df: DataFrame, by: str, reason: str, name: str = "n") -> DataFrame:
    """Most frequent reason of each group, ties included."""
    return top_per_group(df.groupBy(by, reason).agg(rows().alias(name)), [by], name)


def rate_by_band(df: DataFrame, band: Column, name: str, flag: str = "is_churned") -> DataFrame:
    return segment_rate(df.withColumn(name, band), [name], flag)
