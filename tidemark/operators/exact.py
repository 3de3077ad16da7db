"""Exact null distributions of rank tests on small groups, p-values of correlations.

Groups of at most ``limit`` rows hand their ranks, twice over so that ties stay whole numbers, to a dynamic program of their test; larger ones get the
tie-corrected normal approximation.  Nothing is collected before the group's size is known to be within the limit.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import beta_inc, two_sided_normal
from tidemark.operators.quantiles import with_ranks
from tidemark.operators.stats import kendall, log_pearson, rank_sum, signed_rank, spearman
from tidemark.session import settle

#: Groups up to which the distribution is exact, as published: both groups together, differences, pairs without ties.
RANK_SUM_LIMIT, SIGNED_LIMIT, KENDALL_LIMIT = 19, 15, 49


def subset_sums(ranks: np.ndarray, k: int) -> np.ndarray:
    """Probabilities of the sum of ``k`` of the whole-number ``ranks``, every choice alike."""
    ways = np.zeros((k + 1, int(ranks.sum()) + 1))
    ways[0, 0] = 1.0
    for r in ranks.astype(int):
        shifted = np.zeros_like(ways)
        shifted[1:, r:] = ways[:-1, :ways.shape[1] - r] if r else ways[:-1]
        ways += shifted
    return ways[k] / math.comb(len(ranks), k)


def sign_sums(ranks: np.ndarray) -> np.ndarray:
    """Probabilities of the sum of the ranks with a positive sign, every pattern of signs alike."""
    p = np.zeros(int(ranks.sum()) + 1)
    p[0] = 1.0
    for r in ranks.astype(int):
        p = p / 2 + np.concatenate([np.zeros(r), p[:len(p) - r]]) / 2
    return p


def inversions(n: int) -> np.ndarray:
    """Probabilities of the number of discordant pairs of ``n`` untied ranks, every order alike."""
    p = np.ones(1)
    for m in range(2, n + 1):
        p = np.convolve(p, np.full(m, 1 / m))
    return p


def doubled_tail(p: np.ndarray, at: int) -> float:
    """Twice the smaller tail that holds ``at``, one at most."""
    return min(1.0, 2 * min(p[:at + 1].sum(), p[at:].sum()))


@F.pandas_udf(T.DoubleType())
def _rank_sum_p(ranks: pd.Series, k: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([doubled_tail(subset_sums(np.asarray(r), int(n)), int(s)) for r, n, s in zip(ranks, k, w, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _signed_p(ranks: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([doubled_tail(sign_sums(np.asarray(r)), int(s)) for r, s in zip(ranks, w, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _kendall_p(n: pd.Series, discordant: pd.Series) -> pd.Series:
    return pd.Series([doubled_tail(inversions(int(k)), int(d)) for k, d in zip(n, discordant, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def student_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation of ``n`` pairs by Student's distribution."""
    def one(v: float, k: int) -> float | None:
        if pd.isna(v) or k < 3:
            return None
        rest = 1 - v * v
        return 0.0 if rest <= 0 else beta_inc((k - 2) / 2, 0.5, rest)
    return pd.Series([one(v, k) for v, k in zip(r, n, strict=True)], dtype=float)


def rank_sum_test(df: DataFrame, keys: Sequence[str], group: str, first: str, second: str, value: str, limit: int = RANK_SUM_LIMIT,
                  smaller: int = 9, slice_by="auto") -> DataFrame:
    """``rank_sum`` with ``p`` and ``method``: exact up to ``limit`` rows of which one group has at most ``smaller``, else normal with continuity correction."""
    keys = list(keys)
    both = settle(df.where(F.col(group).isin(first, second) & F.col(value).isNotNull()))
    base = settle(rank_sum(both, keys, group, first, second, value, slice_by))
    n, m = F.col("n1"), F.col("n2")
    small = base.where((n > 0) & (m > 0) & (n + m <= limit) & (F.least(n, m) <= smaller)).select(*keys, "n1")
    ranks = with_ranks(both.join(small, keys), keys, value, "_r", slice_by)
    got = ranks.groupBy(*keys).agg(F.collect_list((2 * F.col("_r")).cast("int")).alias("_all"), F.first("n1").alias("_k"),
                                   F.sum(F.when(F.col(group) == first, (2 * F.col("_r")).cast("int"))).alias("_w"))
    exact = got.select(*keys, _rank_sum_p("_all", "_k", "_w").alias("_p"))
    # the corrected numerator over the same deviation: z (|d| - 1/2) / |d|
    d = F.abs(F.col("u") - n * m / 2)
    corrected = two_sided_normal(F.when(d == 0, 0.0).otherwise(F.col("z") * (d - 0.5) / d))
    return base.join(exact, keys, "left").withColumns({
        "p": F.coalesce("_p", corrected), "method": F.when(F.col("_p").isNotNull(), "exact").otherwise("normal")}).drop("_p", "p_normal")


def signed_rank_test(df: DataFrame, keys: Sequence[str], diff: str, limit: int = SIGNED_LIMIT, slice_by="auto") -> DataFrame:
    """``signed_rank`` with ``p`` and ``method``: exact up to ``limit`` differences that are not zero."""
    keys = list(keys)
    rows = settle(df.where((F.col(diff) != 0) & F.col(diff).isNotNull()).withColumn("_m", F.abs(diff)))
    base = settle(signed_rank(rows, keys, diff, slice_by))
    ranks = with_ranks(rows.join(base.where(F.col("n") <= limit).select(*keys), keys), keys, "_m", "_r", slice_by)
    twice = (2 * F.col("_r")).cast("int")
    got = ranks.groupBy(*keys).agg(F.collect_list(twice).alias("_all"), F.sum(F.when(F.col(diff) > 0, twice).otherwise(0)).alias("_w"))
    exact = got.select(*keys, _signed_p("_all", "_w").alias("_p"))
    return base.join(exact, keys, "left").withColumns({
        "p": F.coalesce("_p", "p_normal"), "method": F.when(F.col("_p").isNotNull(), "exact").otherwise("normal")}).drop("_p", "p_normal")


def kendall_test(df: DataFrame, keys: Sequence[str], x: str, y: str, limit: int = KENDALL_LIMIT, slice_by="auto") -> DataFrame:
    """``kendall`` with ``p`` and ``method``: exact up to ``limit`` pairs without ties, else normal with tie and continuity corrections."""
    keys = list(keys)
    rows = settle(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    tau = kendall(rows, keys, x, y, slice_by)

    def ties(c: str, tag: str) -> DataFrame:
        t = F.col("_t").cast("double")
        return rows.groupBy(*keys, c).agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(
            F.sum(t * (t - 1)).alias(f"_{tag}1"), F.sum(t * (t - 1) * (t - 2)).alias(f"_{tag}2"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_{tag}3"))

    out = settle(tau.join(ties(x, "x"), keys).join(ties(y, "y"), keys))
    n = F.col("n").cast("double")
    pairs = n * (n - 1)
    s = F.coalesce(F.col("tau_b"), F.lit(0.0)) * F.sqrt((pairs - F.col("_x1")) * (pairs - F.col("_y1"))) / 2
    variance = ((pairs * (2 * n + 5) - F.col("_x3") - F.col("_y3")) / 18 + F.try_divide(F.col("_x1") * F.col("_y1"), 2 * pairs)
                + F.coalesce(F.try_divide(F.col("_x2") * F.col("_y2"), 9 * pairs * (n - 2)), F.lit(0.0)))
    z = F.try_divide(F.greatest(F.abs(s) - 1, F.lit(0.0)), F.sqrt(variance))
    small = (F.col("n") <= limit) & (F.col("_x1") == 0) & (F.col("_y1") == 0)
    # only the rows without ties within the limit reach the dynamic program
    exact = out.where(small).select(*keys, _kendall_p("n", F.round((pairs / 2 - s) / 2).cast("int")).alias("_p"))
    return out.join(exact, keys, "left").select(*keys, "n", "tau_b", F.coalesce("_p", two_sided_normal(z)).alias("p"),
                                                F.when(F.col("_p").isNotNull(), "exact").otherwise("normal").alias("method"))


def correlation_tests(df: DataFrame, keys: Sequence[str], x: str, y: str, slice_by="auto") -> DataFrame:
    """Long table ``keys, method, n, estimate, p``: rank, order and log-linear correlation of every key."""
    keys, rows = list(keys), settle(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    part = lambda d, name, c: d.select(*keys, F.lit(name).alias("method"), "n", F.col(c).alias("estimate"))
    student = part(spearman(rows, keys, x, y, slice_by), "spearman", "rho").unionByName(part(log_pearson(rows, keys, x, y), "pearson log10", "r"))
    k = kendall_test(rows, keys, x, y, slice_by=slice_by)
    return student.withColumn("p", student_p("estimate", "n")).unionByName(part(k.drop("method"), "kendall tau-b", "tau_b").join(k.select(*keys, "p"), keys).select(*keys, "method", "n", "estimate", "p"))
