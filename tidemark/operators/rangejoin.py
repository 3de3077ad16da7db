"""Interval overlap join through time buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_width(df: DataFrame, lo: str, hi: str, floor: float = 1.0) -> float:
    """Twice the mean length: at this width all intervals together fill at most ~1.5 buckets each,
    whatever the spread of their lengths."""
    mean = df.agg(F.avg((F.col(hi) - F.col(lo)).cast("double"))).first()[0]
    return max(float(mean or 0) * 2, floor)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, l_lo: str, l_hi: str,
                 r_lo: str, r_hi: str, tol=0, width: float | None = None,
                 strict: bool = False) -> DataFrame:
    """Pairs with equal keys whose closed intervals meet within ``tol`` (``strict``: open).

    Both sides are cut into time buckets and joined on (keys, bucket), so a hot key spreads over its
    buckets.  A pair sharing several buckets is kept in the first common one only - no distinct.
    """
    if width is None:
        width = max(bucket_width(left, l_lo, l_hi), bucket_width(right, r_lo, r_hi))
    w, t = F.lit(float(width)), F.lit(tol)
    slot = lambda c: F.floor(c / w).cast("long")
    l = left.withColumn("_l0", slot(F.col(l_lo) - t)).withColumn("_l1", slot(F.col(l_hi) + t))
    r = right.withColumn("_r0", slot(F.col(r_lo))).withColumn("_r1", slot(F.col(r_hi)))
    l = l.where("_l1 >= _l0").withColumn("_b", F.explode(F.sequence("_l0", "_l1")))
    r = r.where("_r1 >= _r0").withColumn("_b", F.explode(F.sequence("_r0", "_r1")))
    meet = ((F.col(l_lo) - t < F.col(r_hi)) & (F.col(l_hi) + t > F.col(r_lo))) if strict else (
        (F.col(l_lo) - t <= F.col(r_hi)) & (F.col(l_hi) + t >= F.col(r_lo)))
    return (l.join(r, [*keys, "_b"])
             .where(meet & (F.col("_b") == F.greatest("_l0", "_r0")))
             .drop("_b", "_l0", "_l1", "_r0", "_r1"))
