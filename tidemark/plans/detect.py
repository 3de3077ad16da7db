"""Detection jobs on chunked signals: sustained events, transients, and their diagnostics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CleanConfig, SustainedConfig, TransientConfig, band_limits
from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators import signal as sg
from tidemark.operators.peaks import find_peaks
from tidemark.operators.quantiles import exact_median, exact_percentiles
from tidemark.session import durable

BLOCK = ["channel_id", "block_id"]
CHANNEL = ["channel_id"]


def clean(chunks: DataFrame, cfg: CleanConfig = CleanConfig()) -> tuple[DataFrame, DataFrame]:
    """Outlier removal by channel limits, interpolated inside blocks; returns chunks and limits."""
    s = sg.to_samples(chunks, BLOCK)
    limits = durable(sg.outlier_limits(sg.robust_stats(s, CHANNEL), s, CHANNEL, cfg.k, cfg.switch_pct, cfg.fixed, use_fixed=cfg.use_fixed))
    return sg.clean_chunks(chunks, BLOCK, limits, CHANNEL), limits


def traces(chunks: DataFrame, fs: float, cfg: SustainedConfig = SustainedConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Energy and line-length traces of the trimmed blocks, their global thresholds per channel and the
    rejected blocks.  Scaling by the global range precedes the filter."""
    m = chunks.select("channel_id", F.array_min("samples").alias("a"), F.array_max("samples").alias("b")).groupBy("channel_id").agg(
        F.min("a").alias("_a"), F.max("b").alias("_b"))
    scaled = chunks.join(m, CHANNEL)
    scaled = scaled.withColumn("samples", F.transform("samples", lambda x: (x - F.col("_a")) / (F.col("_b") - F.col("_a")))).drop("_a", "_b")
    band = sg.bandpass(scaled, BLOCK, cfg.band, fs)
    trim, least = round(cfg.edge_trim_s * fs), int(np.ceil(cfg.legacy_min_s * fs))
    blocks = band.groupBy(*BLOCK).agg(F.min("n0").alias("first_n"), F.max(F.col("n0") + F.size("samples") - 1).alias("last_n"))
    kept, rejected = sg.trimmed_blocks(blocks, trim, least)
    inner = band.join(kept, BLOCK)
    a = F.greatest(F.col("first_n") - F.col("n0"), F.lit(0))
    b = F.least(F.col("last_n") - F.col("n0") + 1, F.size("samples").cast("long"))
    inner = inner.where(b > a).select(*BLOCK, "chunk_ix", (F.col("n0") + a).alias("n0"), F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")).alias("samples"))
    both = sg.line_length(sg.energy(inner, BLOCK, round(cfg.window_s * fs), cfg.power), BLOCK, round(cfg.ll_window_s * fs))
    both = durable(both)
    s = sg.to_samples(both, BLOCK, ["energy", "line_length"])
    th = sg.global_threshold(s, CHANNEL, "energy", cfg.median_factor).join(exact_median(s, CHANNEL, "line_length", "ll_median"), CHANNEL)
    return both, durable(th), rejected


def candidates(tr: DataFrame, thresholds: DataFrame, fs: float, cfg: SustainedConfig = SustainedConfig(), raw: DataFrame | None = None) -> DataFrame:
    """Runs above the threshold, bounded merge, minimum duration, metrics and keep decision.
    ``raw`` chunks give the (informative) high-frequency ratio."""
    s = sg.to_samples(tr, BLOCK, ["energy", "line_length"]).join(thresholds.select("channel_id", "threshold"), CHANNEL)
    runs = ev.threshold_runs(s, BLOCK, "n", F.col("energy") > F.col("threshold"))
    # ends are inclusive samples: the distance allowing a gap of g samples is g + 1
    merged = ev.bounded_merge(runs, BLOCK, "first_n", "last_n", round(cfg.merge_gap_s * fs) + 1, round(cfg.max_s * fs) - 1)
    duration = (F.col("last_n") - F.col("first_n") + 1) / F.lit(fs)
    merged = merged.withColumn("duration_s", duration).where(F.col("duration_s") >= cfg.min_s)
    ids = durable(ev.numbered(merged, CHANNEL, ["first_n"], "event_id"))
    m = sg.event_metrics(ids, tr, BLOCK, thresholds, CHANNEL)
    if raw is not None:
        m = m.join(sg.band_ratio_db(ids, raw, BLOCK, fs), [*BLOCK, "event_id"], "left")
    accept, reject, band = band_limits(cfg)
    ll = F.col("ll_ratio")
    out = ids.join(m, [*BLOCK, "event_id"]).withColumns({
        "start_s": F.col("first_n") / fs, "end_s": F.col("last_n") / fs, "over_max_duration": F.col("duration_s") > cfg.max_s,
        "kept": F.coalesce(ll >= reject, F.lit(False)),
        "ll_status": F.when(ll >= accept, "accepted").when(F.lit(band) & (ll >= reject), "in_band").otherwise("rejected")})
    return out


def legacy_events(tr: DataFrame, thresholds: DataFrame, fs: float, cfg: SustainedConfig = SustainedConfig()) -> DataFrame:
    """Runs above the threshold at least ``legacy_min_s`` long, without any merge."""
    s = sg.to_samples(tr, BLOCK, ["energy", "line_length"])
    s = s.join(thresholds.select("channel_id", "threshold"), CHANNEL)
    runs = ev.threshold_runs(s, BLOCK, "n", F.col("energy") > F.col("threshold"))
    long = runs.withColumn("duration_s", F.col("n_samples") / F.lit(fs)).where(F.col("duration_s") >= cfg.legacy_min_s)
    return ev.numbered(long, CHANNEL, ["first_n"], "event_id")


def rectified(chunks: DataFrame, fs: float, cfg: TransientConfig = TransientConfig()) -> DataFrame:
    """Magnitude of the band-passed signal, centred on its channel's median."""
    med = exact_median(sg.to_samples(chunks, BLOCK), CHANNEL, "x", "_m")
    centred = chunks.join(med, CHANNEL).withColumn("samples", F.transform("samples", lambda x: x - F.col("_m"))).drop("_m")
    return sg.bandpass(centred, BLOCK, cfg.band, fs).withColumn("samples", F.transform("samples", F.abs))


def baseline_heights(included: DataFrame, cfg: TransientConfig = TransientConfig()) -> DataFrame:
    """``channel_id, baseline, height``: the rung of the ladder and the least peak height it gives, from included samples."""
    steps = np.arange(cfg.baseline_start, cfg.baseline_top + cfg.baseline_step / 2, cfg.baseline_step)
    base = sg.baseline_ladder(included, CHANNEL, "x", [float(v) for v in steps], cfg.baseline_fraction, cfg.baseline_step, cfg.baseline_top)
    return base.withColumn("height", F.col("baseline") * cfg.lower_factor)


def peaks_by_height(rect: DataFrame, zones: DataFrame, heights: DataFrame, fs: float, cfg: TransientConfig = TransientConfig()) -> DataFrame:
    """Peaks outside the zones for every height of ``heights`` (channel_id, height, ...), each peak once per height it reaches.

    One search per channel, at its lowest height, serves all of them.  Prominence and width of a peak do not depend on the height.
    The distance rule keeps peaks tallest first, so whether a peak stays depends on taller ones only: those of at least a height
    are kept alike with and without the lower ones.  Limits and zones come after the distance rule, as in one run.
    """
    lowest = heights.groupBy("channel_id").agg(F.min("height").alias("height"))
    pk = find_peaks(rect.join(lowest, CHANNEL), BLOCK, prominence=cfg.prominence, width=max(1, round(cfg.width_s * fs)), distance=max(1, round(cfg.distance_s * fs)))
    pk = iv.contains(pk.where(F.col("h") <= cfg.upper), zones, CHANNEL, "n", closed=True).where("NOT inside").drop("inside")
    return pk.join(heights, CHANNEL).where(F.col("h") >= F.col("height"))


def grouped_peaks(pk: DataFrame, key: Sequence[str], fs: float, cfg: TransientConfig = TransientConfig()) -> tuple[DataFrame, DataFrame]:
    """Complexes and bursts of peaks."""
    cx = durable(ev.complexes(pk, key, "n", "h", round(cfg.spike_gap_ms / 1000 * fs)))
    return cx, ev.bursts(cx, key, cfg.burst_gap_s * fs, cfg.burst_min_n, cfg.burst_min_s * fs, cfg.burst_max_s * fs)


def transients(chunks: DataFrame, zones: DataFrame, fs: float, cfg: TransientConfig = TransientConfig()) -> dict[str, DataFrame]:
    """Peaks outside the exclusion zones, complexes and bursts.  ``zones`` = channel_id, lo, hi (sample index, inclusive)."""
    s = sg.outside_zones(chunks, zones, BLOCK, CHANNEL)
    minutes = s.groupBy("channel_id").agg((F.count(F.lit(1)) / F.lit(fs * 60)).alias("minutes"))
    base = durable(baseline_heights(s, cfg))
    pk = durable(peaks_by_height(rectified(chunks, fs, cfg), zones, base.select("channel_id", "height"), fs, cfg).drop("height"))
    cx, bs = grouped_peaks(pk, BLOCK, fs, cfg)
    return {"peaks": pk, "complexes": cx, "bursts": bs, "minutes": minutes, "baseline": base}


def walsh_detector(chunks: DataFrame, fs: float, envelope_threshold: float, k: float = 1.0, smooth_s: float = 0.010, env_s: float = 0.020,
                   dilate_s: float = 0.030, min_ms: float = 20.0, merge_ms: float = 80.0) -> tuple[DataFrame, DataFrame]:
    """Transients where the dilated step metric and the envelope are both high; event type by the number
    of peaks.  Returns events and the channel shares of envelope-only, step-only and both."""
    n = lambda s: max(1, round(s * fs))
    w = sg.moving(sg.walsh(chunks, BLOCK), BLOCK, n(smooth_s), "mean", "walsh", "walsh")
    taps = sg.hilbert_taps(64)
    w = sg.block_apply(w, BLOCK, lambda x, a, b: np.hypot(x[a:b], sg.convolve_at(x, taps, a, b)), 64, "env")
    w = durable(sg.moving(w, BLOCK, n(env_s), "mean", "env", "env"))
    s = sg.to_samples(w, BLOCK, ["samples", "walsh", "env"])
    med = exact_median(s, CHANNEL, "walsh", "_m")
    mad = exact_median(s.join(med, CHANNEL).withColumn("_d", F.abs(F.col("walsh") - F.col("_m"))), CHANNEL, "_d", "_mad")
    s = s.join(med, CHANNEL).join(mad, CHANNEL).withColumns({"step": F.col("walsh") > F.col("_m") + k * F.col("_mad"), "high": F.col("env") > envelope_threshold})
    s = sg.dilate(s, BLOCK, "step", n(dilate_s))
    share = s.groupBy("channel_id").agg(*[(100 * F.avg(c.cast("double"))).alias(a) for a, c in (
        ("pct_env_only", F.col("high") & ~F.col("dilated")), ("pct_walsh_only", F.col("dilated") & ~F.col("high")), ("pct_both", F.col("dilated") & F.col("high")))])
    runs = ev.threshold_runs(s, BLOCK, "n", F.col("dilated") & F.col("high")).where(F.col("n_samples") >= n(min_ms / 1000))
    from tidemark.operators.islands import islands
    found = islands(runs, BLOCK, "first_n", "last_n", gap=n(merge_ms / 1000) + 1)
    found = durable(ev.numbered(found, CHANNEL, ["first_n"], "event_id"))
    return count_peaks(found, w, 0.4, max(1, round(0.010 * fs))), share


def count_peaks(found: DataFrame, chunks: DataFrame, fraction: float, distance: int) -> DataFrame:
    """Peaks inside each event: rise before, no rise after, at least ``fraction`` of the event maximum,
    first-come spacing of ``distance`` samples; two or more make a polyspike."""
    from tidemark.operators.scan import lag, lead, ordered_scan
    key = [*BLOCK, "event_id"]
    x = sg.event_samples(found, chunks, BLOCK, ["samples"]).withColumn("x", F.abs("x"))
    x = ordered_scan(x, key, ["n"], [lag("_p", "x"), lead("_q", "x")])
    top = x.groupBy(*key).agg(F.max("x").alias("_top"))
    cand = x.join(top, key).where((F.col("x") > F.col("_p")) & (F.col("x") >= F.col("_q")) & (F.col("x") >= fraction * F.col("_top")))
    pts = cand.select(*key, F.col("n").alias("a"), F.col("n").alias("b"))
    # first-come spacing is the bounded merge of points with spans below the distance
    kept = ev.bounded_merge(pts, key, "a", "b", 1 << 40, distance - 1)
    n = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("num_peaks"))
    out = found.join(n, key, "left").na.fill(0, ["num_peaks"])
    return out.withColumn("type", F.when(F.col("num_peaks") >= 2, "polyspike").otherwise("single"))


def hysteresis_events(chunks: DataFrame, fs: float, enter: float = 8.0, leave: float = 0.5, window_s: float = 2.0, gap_s: float = 2.0, min_s: float = 15.0) -> DataFrame:
    """Half-wave energy with hysteresis: enter at 8 x median, leave at half of that, holes and gaps up to
    2 s closed, at least 15 s long."""
    from tidemark.operators.islands import islands
    e = sg.moving(chunks, BLOCK, max(1, round(window_s * fs)), "mean", "energy", "samples", pre=lambda x: np.maximum(x, 0) ** 4)
    s = sg.to_samples(durable(e), BLOCK, ["samples", "energy"])
    th = exact_median(s, CHANNEL, "energy", "_m")
    s = s.join(th, CHANNEL).withColumn("ratio", F.try_divide(F.col("energy"), F.col("_m")))
    on = ev.hysteresis(s, BLOCK, ["n"], "ratio", enter, enter * leave)
    runs = ev.threshold_runs(on, BLOCK, "n", F.col("active"))
    out = islands(runs, BLOCK, "first_n", "last_n", gap=round(gap_s * fs) + 1)
    return out.withColumn("duration_s", (F.col("last_n") - F.col("first_n") + 1) / F.lit(fs)).where(F.col("duration_s") >= min_s)


def threshold_diagnostic(tr: DataFrame, cand: DataFrame, off: DataFrame, fs: float, cfg: SustainedConfig = SustainedConfig()) -> DataFrame:
    """Global medians with and without the disconnected samples, the change they make, and how many saved
    candidates would flip.  ``off`` = channel_id, lo, hi in samples."""
    s = sg.to_samples(tr, BLOCK, ["energy", "line_length"])
    spans = sg.outside_zones(tr.withColumn("samples", F.col("energy")), off, BLOCK, CHANNEL).select(*BLOCK, "n")
    ok = s.join(spans, [*BLOCK, "n"])
    pair = lambda df, tag: exact_median(df, CHANNEL, "energy", f"energy_{tag}").join(exact_median(df, CHANNEL, "line_length", f"ll_{tag}"), CHANNEL)
    m = pair(s, "all").join(pair(ok, "corrected"), CHANNEL)
    change = lambda a, b: 100 * (F.try_divide(F.col(b), F.col(a)) - 1)
    m = m.withColumns({"energy_change_pct": change("energy_all", "energy_corrected"), "ll_change_pct": change("ll_all", "ll_corrected")})
    c = cand.join(m, CHANNEL).withColumns({
        "ll_new": F.col("ll_ratio") * F.col("ll_all") / F.col("ll_corrected"),
        "peak_new": F.col("peak_energy_ratio") * F.col("energy_all") / F.col("energy_corrected")})
    flips = c.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("kept") & (F.col("ll_new") < cfg.ll_threshold)).alias("n_kept_to_reject"),
        F.count_if(~F.col("kept") & (F.col("ll_new") >= cfg.ll_threshold)).alias("n_reject_to_keep"), F.count_if(F.col("peak_new") < 1).alias("n_energy_lost"))
    return m.join(flips, CHANNEL, "left").na.fill(0)


def missed_criterion(peak_ratio, run_s, ll_ratio, cfg: SustainedConfig = SustainedConfig()):
    """First criterion a missed window fails: energy, then run length, then line length."""
    return (F.when(peak_ratio < 1, "energy below threshold").when(run_s < cfg.min_s, "run too short")
             .when(ll_ratio < cfg.ll_threshold, "line length below threshold").otherwise("meets all criteria"))
