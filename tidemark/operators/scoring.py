"""Detections against ground truth: claims, scores, threshold sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rangejoin import overlap_join
from tidemark.session import settle


def ratio_or_zero(a: Column, b: Column) -> Column:
    """Scoring tables count a ratio of nothing as zero (performance tables leave it NULL)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def reportable(det: DataFrame) -> DataFrame:
    """Reconciled rows that no detector produced cannot be scored."""
    if "detection_status" not in det.columns:
        return det
    return det.where(~F.col("detection_status").isin("rescued", "imputed"))


def _pairs(det: DataFrame, gt: DataFrame, keys: list[str], tol, extra: Sequence[str] = ()) -> DataFrame:
    g = gt.select(*keys, "gt_id", F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi"))
    return overlap_join(det.select(*keys, "det_id", "lo", "hi", *extra), g, keys, l_lo="lo", l_hi="hi",
                        r_lo="g_lo", r_hi="g_hi", tol=tol)


def claim(det: DataFrame, gt: DataFrame, keys: Sequence[str], tol) -> DataFrame:
    """Each ground-truth row, in id order, claims the unclaimed detections within ``tol``.

    A detection therefore belongs to its smallest overlapping ``gt_id``; the earliest of a claim is the
    hit, the rest are fragments.  Both reductions are map-side combined.
    """
    keys = list(keys)
    det = reportable(det)
    owner = _pairs(det, gt, keys, tol).groupBy("det_id").agg(F.min("gt_id").alias("gt_id"))
    out = settle(det.join(owner, "det_id", "left"))
    first = (out.where("gt_id IS NOT NULL").groupBy(*keys, "gt_id")
                .agg(F.min(F.struct("lo", "det_id")).alias("_first")))
    out = out.join(first, [*keys, "gt_id"], "left")
    status = (F.when(F.col("gt_id").isNull(), "fp").when(F.col("_first.det_id") == F.col("det_id"), "tp")
               .otherwise("fragment"))
    return out.withColumn("match_status", status).drop("_first")


def scores(claimed: DataFrame, gt: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    n = gt.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    is_ = lambda s: F.count_if(F.col("match_status") == s)
    d = claimed.groupBy(*keys).agg(is_("tp").alias("tp"), is_("fp").alias("fp"), is_("fragment").alias("fragments"))
    out = n.join(d, keys, "left").na.fill(0, ["tp", "fp", "fragments"]).withColumn("fn", F.col("n_gt") - F.col("tp"))
    p, r = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp")), ratio_or_zero(F.col("tp"), F.col("n_gt"))
    out = out.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def missed(claimed: DataFrame, gt: DataFrame, keys: Sequence[str]) -> DataFrame:
    hit = claimed.where("match_status = 'tp'").select(*keys, "gt_id")
    return gt.join(hit, [*keys, "gt_id"], "left_anti")


def threshold_sweep(det: DataFrame, gt: DataFrame, keys: Sequence[str], tol, thresholds: Sequence[float]) -> DataFrame:
    """Hits, false detections and misses when only detections scoring at least each threshold are kept.

    A ground-truth row is found up to the best score near it and a detection is kept up to its own, so
    one overlap join and one pass over per-threshold counters replace a join per threshold.
    """
    keys = list(keys)
    pairs = settle(_pairs(det, gt, keys, tol, ["score"]))
    best = pairs.groupBy(*keys, "gt_id").agg(F.max("score").alias("score"))
    hits = pairs.select("det_id", "score").distinct()
    at = lambda: F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.select("score", at()).groupBy("threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias(name))

    kept = count(det, "kept")
    out = kept.join(count(best, "tp"), "threshold", "left").join(count(hits, "hit"), "threshold", "left").na.fill(0)
    n = gt.agg(F.count(F.lit(1)).alias("n_gt")).withColumn("_one", F.lit(1))
    out = out.withColumn("_one", F.lit(1)).join(n, "_one").select(
        "threshold", "tp", (F.col("kept") - F.col("hit")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"))
    p = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fp"))
    r = ratio_or_zero(F.col("tp"), F.col("tp") + F.col("fn"))
    out = out.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", ratio_or_zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
