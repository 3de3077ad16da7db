"""Signal quality, case and gain decisions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import signal as sg
from tidemark.config import QualityConfig
from tidemark.operators.quantiles import exact_median, exact_percentiles


def array_band_power(fs: float, lo: float, hi: float):
    """Pandas UDF: band power of an array signal from its Hamming periodogram."""
    @F.pandas_udf("double")
    def power(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: sg.band_power(*sg.psd(np.asarray(a, dtype=float), fs), lo, hi))
    return power


def source_ratio(df: DataFrame, keys: Sequence[str], source: str, a: str, b: str, value: str, band: tuple[float, float]) -> DataFrame:
    """Median of two sources side by side and whether their ratio lies in the allowed band."""
    med = exact_median(df, [*keys, source], value, "_m")
    wide = med.groupBy(*keys).pivot(source, [a, b]).agg(F.first("_m"))
    return wide.withColumn("compatible", F.try_divide(F.col(a), F.col(b)).between(*band))


def spectral_quality(windows: DataFrame, channel: Sequence[str], threshold_db: float, slice_by="auto") -> DataFrame:
    """sigma (root of the median scale-band power) and mains statistics of a channel's windows."""
    channel = list(channel)
    p = exact_median(windows, channel, "p_scale", "_p", slice_by)
    r = exact_percentiles(windows, channel, "ratio_db", {"line_ratio_db": 50, "line_ratio_p95_db": 95}, slice_by)
    m = windows.groupBy(*channel).agg(F.max("ratio_db").alias("line_ratio_max_db"),
                                      (100 * F.avg((F.col("ratio_db") > threshold_db).cast("double"))).alias("pct_time_line_high"))
    return p.join(r, channel, "left").join(m, channel).withColumn("sigma_band", F.sqrt("_p")).drop("_p")


def quantisation(physical_min: Column, physical_max: Column, digital_min: Column, digital_max: Column) -> Column:
    """Step of the converter; NULL when the digital span is not positive."""
    span = digital_max - digital_min
    return F.when(span > 0, F.abs(physical_max - physical_min) / span)


def snr_db(sigma: Column, step: Column) -> Column:
    return F.when((sigma > 0) & (step > 0), 20 * F.log10(sigma / step))


def quality_class(snr: Column, line_db: Column, pct_line: Column, flat: Column, clipped: Column, *, min_snr: float, low_snr: float,
                  line_limit: float, intermittent: float) -> Column:
    """unusable / low_amplitude(+line) / line_contaminated / ok; missing values never condemn a channel
    except a missing signal-to-quantisation ratio."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    unusable = snr.isNull() | (snr < min_snr) | yes(flat > 0.5) | yes(clipped > 5)
    low, line = snr < low_snr, yes(line_db > line_limit) | yes(pct_line > intermittent)
    return (F.when(unusable, "unusable").when(low & line, "low_amplitude+line").when(low, "low_amplitude")
             .when(line, "line_contaminated").otherwise("ok"))


def gain_decision(df: DataFrame, reference: DataFrame, region: str, pooled: float | None, *, deadband: float = 1.5, top: float = 50.0) -> DataFrame:
    """Gain per channel: off, explicit (clamped) or auto = reference / sigma with a dead band around 1.

    Needs ``gain_mode, gain, sigma_band``; the reference comes by region, else the pooled value.
    """
    ref = reference.select(region, F.col("reference").alias("_ref"))
    x = df.join(ref, region, "left")
    used = F.coalesce("_ref", F.lit(pooled).cast("double"))
    source = F.when(F.col("_ref").isNotNull(), "region").when(F.lit(pooled is not None), "fallback").otherwise("none")
    raw = (F.when(F.col("gain_mode") == "explicit", F.col("gain"))
            .when(F.col("gain_mode") == "auto", F.try_divide(used, F.col("sigma_band"))))
    usable = raw.isNotNull() & (raw > 0)
    auto = F.when(~usable, 1.0).when(raw.between(1 / deadband, deadband), 1.0).otherwise(F.least(raw, F.lit(top)))
    applied = (F.when(F.col("gain_mode") == "off", 1.0).when(F.col("gain_mode") == "explicit", F.least(raw, F.lit(top))).otherwise(auto))
    is_auto = F.col("gain_mode") == "auto"
    return x.withColumns({
        "gain_raw": raw, "gain_applied": applied, "reference_used": F.when(is_auto, used),
        "reference_source": F.when(is_auto, source).otherwise("off"),
        "gain_warning": F.when(is_auto & ~usable, "not applied").when(raw > top, "clamped").otherwise(""),
    }).drop("_ref")


def apply_gain(chunks: DataFrame, gains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale the chunks whose gain differs from 1; the others pass unchanged."""
    x = chunks.join(gains.select(*keys, "gain_applied"), list(keys))
    g = F.col("gain_applied")
    return x.withColumn("samples", F.when(g == 1, F.col("samples")).otherwise(F.transform("samples", lambda v: v * g))).drop("gain_applied")


def attenuation(text: Column, no: Sequence[str], yes: Sequence[str]) -> tuple[Column, Column]:
    """(is_attenuated, known): listed texts decide; anything else counts as attenuated and unknown."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    is_no, is_yes = t.isin(*no), t.isin(*yes)
    return ~is_no, is_no | is_yes


def notch_active(mode: Column, quality: Column) -> Column:
    return F.when(mode == "on", True).when(mode == "auto", F.coalesce(quality.isin("line_contaminated", "low_amplitude+line"), F.lit(False))).otherwise(False)


def suggested_case(df: DataFrame, region: str, value: str, snr: Column, line_db: Column, pct_line: Column, quality: Column,
                   reference: DataFrame | None = None, limits: QualityConfig = QualityConfig(), slice_by="auto") -> DataFrame:
    """Suggest a case: unusable channels first, then low amplitude (against the region's reference, or its median
    when at least two channels share the region, or by the signal-to-quantisation ratio) and mains."""
    med = exact_median(df, [region], value, "_med", slice_by)
    n = df.groupBy(region).agg(F.count(F.lit(1)).alias("_n"))
    base = med.join(n, region).withColumn("_base", F.when(F.col("_n") >= 2, F.col("_med")))
    x = df.join(base.select(region, "_base"), region, "left")
    if reference is not None:
        x = x.join(reference.select(region, F.col("reference").alias("_r")), region, "left").withColumn("_base", F.coalesce("_r", "_base")).drop("_r")
    yes = lambda c: F.coalesce(c, F.lit(False))
    low = yes(F.col(value) * limits.attenuation_ratio < F.col("_base")) | yes(snr < limits.low_snr_db)
    noisy = yes(line_db > limits.line_db) | yes(pct_line > limits.line_intermittent_pct)
    case = (F.when(quality == "unusable", "unusable").when(low & noisy, "both").when(low, "attenuated").when(noisy, "line").otherwise("normal"))
    return x.withColumn("suggested_case", case).drop("_base")


def run_reference(channels: DataFrame, region: str, sigma: str, attenuated: Column, slice_by="auto") -> DataFrame:
    """Reference amplitude: median sigma of the unattenuated channels per region, and pooled over all."""
    ok = channels.where(~attenuated & F.col(sigma).isNotNull())
    both = ok.select(F.explode(F.array(F.col(region), F.lit("pooled"))).alias(region), sigma)
    n = both.groupBy(region).agg(F.count(F.lit(1)).alias("n_channels"))
    return n.join(exact_median(both, [region], sigma, "reference", slice_by), region)


def cohort_calibration(channels: DataFrame, region: str, sigma: str, slice_by="auto") -> tuple[DataFrame, DataFrame]:
    """Per region: n, quartiles, IQR, range.  Per channel: multiple of the region median, largest
    |log2| first."""
    q = exact_percentiles(channels, [region], sigma, {"p25": 25, "median": 50, "p75": 75}, slice_by)
    g = channels.groupBy(region).agg(F.count(sigma).alias("n"), F.min(sigma).alias("min"), F.max(sigma).alias("max"))
    table = q.join(g, region).withColumn("iqr", F.col("p75") - F.col("p25"))
    dev = channels.join(q.select(region, "median"), region).withColumn("multiple", F.try_divide(F.col(sigma), F.col("median")))
    return table, dev.orderBy(F.abs(F.log2("multiple")).desc_nulls_last())


def mains_verdict(depth_db: Column) -> Column:
    """Notch verification from the drop of mains prominence."""
    return F.when(depth_db < 10, "not applied").when(depth_db <= 25, "partial").otherwise("applied")
