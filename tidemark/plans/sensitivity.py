"""How the transient counts depend on the least peak height: variants per channel, subject and group.

Variants are the channel's own height, fixed heights, and percentiles of the rectified band.  Channels are filtered once, peaks are searched
once at the lowest height of a channel, and variants of equal height share their events.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import TransientConfig
from tidemark.operators import signal as sg
from tidemark.operators import stats as st
from tidemark.operators.quantiles import exact_percentiles
from tidemark.plans import detect
from tidemark.session import durable

COUNTS = ("n_complexes", "n_single", "n_polyspike", "n_bursts")
RATES = ("complexes_per_min", "single_per_min", "polyspikes_per_min", "bursts_per_h")


def variant_heights(actual: DataFrame, included: DataFrame, fixed: Sequence[float], percentiles: Sequence[float]) -> DataFrame:
    """``channel_id, variant, height`` of the channel's own height (``actual``), fixed ones, and percentiles of the ``included`` rectified samples."""
    pct = exact_percentiles(included, ["channel_id"], "x", {f"p{p:g}".replace(".", "_"): p for p in percentiles})
    names = [c for c in pct.columns if c != "channel_id"]
    own = actual.select("channel_id", F.lit("actual").alias("variant"), F.col("height").cast("double").alias("height"))
    each = F.explode(F.array(*[F.struct(F.lit(f"fixed_{v:g}".replace(".", "_")).alias("variant"), F.lit(float(v)).alias("height")) for v in fixed])).alias("v")
    told = actual.select("channel_id", each).select("channel_id", "v.*")
    return own.unionByName(told).unionByName(pct.unpivot(["channel_id"], names, "variant", "height"))


def counts_by_height(cx: DataFrame, bs: DataFrame, variants: DataFrame) -> DataFrame:
    """``variants`` with the numbers of complexes, singles, polyspikes and bursts at their height (0 without events)."""
    by = ["channel_id", "height"]
    poly = F.col("classification") == "polyspike"
    c = cx.groupBy(*by).agg(F.count(F.lit(1)).alias("n_complexes"), F.count_if(~poly).alias("n_single"), F.count_if(poly).alias("n_polyspike"))
    b = bs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_bursts"))
    return variants.join(c, by, "left").join(b, by, "left").na.fill(0, list(COUNTS))


def channel_variants(chunks: DataFrame, zones: DataFrame, fs: float, fixed: Sequence[float], percentiles: Sequence[float],
                     cfg: TransientConfig = TransientConfig()) -> DataFrame:
    """Long table: ``channel_id, variant, height``, the counts and the analysed ``minutes``."""
    inside = sg.outside_zones(chunks, zones, detect.BLOCK, detect.CHANNEL)
    minutes = inside.groupBy("channel_id").agg((F.count(F.lit(1)) / F.lit(fs * 60)).alias("minutes"))
    rect = durable(detect.rectified(chunks, fs, cfg))
    variants = durable(variant_heights(detect.baseline_heights(inside, cfg), sg.outside_zones(rect, zones, detect.BLOCK, detect.CHANNEL), fixed, percentiles))
    heights = variants.select("channel_id", "height").distinct()
    pk = durable(detect.peaks_by_height(rect, zones, heights, fs, cfg))
    cx, bs = detect.grouped_peaks(pk, [*detect.BLOCK, "height"], fs, cfg)
    return counts_by_height(cx, bs, variants).join(minutes, "channel_id")


def wide(long: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per channel: height and complexes per minute of every variant."""
    rate = F.first(F.try_divide("n_complexes", "minutes"))
    out = long.groupBy(*keys).pivot("variant", list(names)).agg(F.first("height").alias("height"), rate.alias("cx_min"))
    return out.select(*keys, *[F.col(f"{n}_{c}").alias(f"{c}_{n}") for n in names for c in ("height", "cx_min")])


def by_subject(long: DataFrame, subject: Sequence[str], slice_by="auto") -> DataFrame:
    """Pooled counts and rates of a subject's channels per variant, with the median height."""
    from tidemark.operators.quantiles import exact_median
    key = [*subject, "variant"]
    total = long.groupBy(*key).agg(*[F.sum(c).alias(c) for c in COUNTS], F.sum("minutes").alias("minutes"))
    rates = {r: F.try_divide(F.col(c), "minutes") * (60 if r.endswith("_h") else 1) for c, r in zip(COUNTS, RATES, strict=True)}
    return total.join(exact_median(long, key, "height", "median_height", slice_by), key).withColumns(rates)


def by_group(subjects: DataFrame, subject: str, group: str, first: str, second: str, outcome: str, replicates: int, seed: int, slice_by="auto") -> DataFrame:
    """Every variant and rate compared between two groups, with its rank correlation to ``outcome`` in the first one: back to long by unpivot."""
    key = ["variant", "metric"]
    long = durable(subjects.unpivot(["variant", subject, group, outcome], list(RATES), "metric", "rate"))
    out = st.tenfold(st.group_compare(long, group, first, second, "rate", [subject], replicates, seed, slice_by, key, st.fast_draw), "fold", "ci_lo")
    rho = st.spearman(long.where(F.col(group) == first), key, "rate", outcome, slice_by).select(*key, F.col("rho").alias("spearman"))
    return out.join(rho, key, "left")
