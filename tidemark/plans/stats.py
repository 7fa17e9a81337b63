"""Rank-sum test (Mann-Whitney U, two-sided)."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import as_double
from tidemark.operators.ranks import value_ranks
from tidemark.runtime import spread

# Below this size of one sample, without ties, the exact distribution is used.
EXACT_MAX = 8


def first_in_invoice(sales: DataFrame) -> DataFrame:
    """Order value and first channel per invoice."""
    first = F.min(F.struct("line_no", "product_id", "channel"))
    return spread(sales, "invoice_no").groupBy("invoice_no").agg(
        F.sum("line_total").alias("order_value"), first.alias("_first")
    ).select("invoice_no", "order_value", F.col("_first.channel").alias("channel"))


def rank_sums(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """One row: n1, n2, rank sum and U of the first sample, tie term, z.

    Works on the histogram of distinct values: tied rows share the mean of
    their ranks, and the tie term is summed in doubles (t^3 leaves 64 bits).
    """
    pair = df.where(F.col(group).isin(a, b))
    ranked = value_ranks(pair, value, extra={"n_a": F.count_if(F.col(group) == a)})
    t = as_double("n")
    middle = as_double("before") + (t + 1) / 2
    sums = ranked.agg(
        as_double(F.sum("n_a")).alias("n1"),
        as_double(F.sum(F.col("n") - F.col("n_a"))).alias("n2"),
        F.sum((as_double("n_a") * middle).cast("decimal(38,1)")).cast("double").alias("r1"),
        F.sum(t * t * t - t).alias("tie_term"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    z = F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, spread)
    return sums.withColumn("u_statistic", u1).withColumn("z", z)


@cache
def _numerator(m: int) -> tuple[int, list[int]]:
    """L and the polynomial N with 1 / ((1 - q) (1 - q) ... (1 - q^m)) = N / (1 - q^L)^(m + 1)."""
    period = math.lcm(*range(1, m + 1))
    poly = [1]
    for part in [1, *range(1, m + 1)]:  # times (1 - q^L) / (1 - q^part)
        poly = poly + [0] * period
        for j in range(len(poly) - 1, period - 1, -1):
            poly[j] -= poly[j - period]
        for j in range(part, len(poly)):
            poly[j] += poly[j - part]
    return period, poly


def _partitions_up_to(total: int, m: int) -> int:
    """Partitions of all numbers up to `total` into parts of at most m."""
    if total < 0:
        return 0
    period, poly = _numerator(m)
    places = range(total % period, min(len(poly), total + 1), period)
    return sum(poly[j] * math.comb((total - j) // period + m, m) for j in places if poly[j])


def exact_tail(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, counted in exact integers.

    Arrangements with U = s are partitions of s into at most m parts of at most n
    each, m the smaller sample. The upper bound on the parts is taken off by
    inclusion and exclusion over 2^m terms, each a closed form: the work does not
    depend on n.
    """
    m, n = sorted((int(n1), int(n2)))
    most = m * n - math.ceil(u)  # the distribution is symmetric
    ways = 0
    for chosen in range(1 << m):
        shifts = [n + i + 1 for i in range(m) if chosen >> i & 1]
        ways += (-1) ** len(shifts) * _partitions_up_to(most - sum(shifts), m)
    return float(Fraction(ways, math.comb(m + n, m)))


def two_sided_p(z: float, u: float, n1: float, n2: float, tie_term: float) -> float | None:
    """Normal approximation with continuity and tie correction, or exact."""
    if not n1 or not n2 or z is None or math.isnan(z):
        return None
    if min(n1, n2) <= EXACT_MAX and tie_term == 0:
        return min(1.0, 2 * exact_tail(max(u, n1 * n2 - u), int(n1), int(n2)))
    return min(1.0, math.erfc(z / math.sqrt(2)))


def rank_sum_test(df: DataFrame, value: str, group: str, a: str, b: str) -> DataFrame:
    """U, z and two-sided p for the two named groups, in one row.

    Only the one-row statistic passes through Python (Spark has no erf).
    """

    def finish(batches):
        for pdf in batches:
            p = [two_sided_p(r.z, r.u_statistic, r.n1, r.n2, r.tie_term) for r in pdf.itertuples()]
            yield pdf.assign(p_value=pd.Series(p, dtype="float64"))

    stats = rank_sums(df, value, group, a, b)
    schema = ", ".join(f"{f.name} double" for f in stats.schema.fields) + ", p_value double"
    return stats.mapInPandas(finish, schema)
