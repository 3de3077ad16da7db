"""Recordings -> event tables: EDF folder to placed chunks, cleaned signals, detections, reconciled events,
zones, transients and summaries.

The only barriers are the ones the analysis has: the reference amplitude over all channels, the global
medians of a channel, and the grouping of a session.  Stages hand over durable tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CleanConfig, QualityConfig, SustainedConfig, TransientConfig
from tidemark.operators import events as ev
from tidemark.operators import quality as ql
from tidemark.operators import signal as sg
from tidemark.operators import spectra as sp
from tidemark.operators import summaries as sm
from tidemark.plans import detect
from tidemark.session import durable
from tidemark.sources import edf

SESSION = ["source_file"]


def quality(chunks: DataFrame, manifest: DataFrame, fs: float, limits: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per channel: amplitude, mains, quantisation, flat and clipped share and the quality class."""
    ch = detect.CHANNEL
    spectra = ql.spectral_quality(sp.window_spectra(chunks, detect.BLOCK, fs, round(limits.window_s * fs), limits.scale_band, limits.line_hz), ch, limits.line_db)
    s = sg.to_samples(chunks, detect.BLOCK)
    flat = sg.chunk_flat_fraction(chunks, detect.BLOCK, round(0.5 * fs), ch)
    step = sg.quantisation_step(s, ch)
    clipped = sg.clipped_share(s, manifest.select(*ch, "phys_min", "phys_max").join(step, ch), ch)
    out = manifest.join(spectra, ch, "left").join(flat, ch, "left").join(step, ch, "left").join(clipped, ch, "left")
    snr = ql.snr_db(F.col("sigma_band"), F.col("step"))
    out = out.withColumn("snr_quantisation_db", snr)
    return out.withColumn("quality_class", ql.quality_class(
        F.col("snr_quantisation_db"), F.col("line_ratio_db"), F.col("pct_time_line_high"), F.col("flat_fraction"), F.col("pct_clipped"),
        min_snr=limits.min_snr_db, low_snr=limits.low_snr_db, line_limit=limits.line_db, intermittent=limits.line_intermittent_pct))


def run(binary: DataFrame, regions: DataFrame, fs: float, sustained: SustainedConfig = SustainedConfig(), transient: TransientConfig = TransientConfig(),
        cleaning: CleanConfig = CleanConfig(), match_tol_s: float = 5.0, records_per_chunk: int = 16) -> dict[str, DataFrame]:
    """All event tables of a folder.  ``regions`` = channel_label, region (channels to analyse).
    Channels of another sampling rate are left out and listed in ``skipped``."""
    rec = edf.records(binary)
    placed = durable(edf.placed(rec).join(regions, "channel_label"))
    skipped = placed.where(F.col("fs") != fs).select("source_file", "channel_label", F.lit("other sampling rate").alias("reason")).distinct()
    placed = placed.where(F.col("fs") == fs)
    cid = F.concat_ws("|", "source_file", "channel_label")
    manifest = edf.manifest(placed).withColumn("channel_id", cid).join(regions, "channel_label")
    raw = edf.chunks(placed, records_per_chunk).select("channel_id", "block_id", "chunk_ix", "n0", "samples")
    raw = durable(raw)
    clean, limits = detect.clean(raw, cleaning)
    clean = durable(clean.drop("n_outliers"))

    tr, th, rejected = detect.traces(clean, fs, sustained)
    cand = durable(detect.candidates(tr, th, fs, sustained, raw=clean))
    info = manifest.select("channel_id", "source_file", "region")
    rows = cand.join(info, "channel_id").select(
        *SESSION, "region", "channel_id", F.xxhash64("channel_id", "event_id").alias("event_id"), F.col("start_s").alias("lo"), F.col("end_s").alias("hi"),
        F.col("ll_ratio").alias("score"), "kept")
    spans = clean.groupBy("channel_id", "block_id").agg((F.min("n0") / F.lit(fs)).alias("b_lo"), (F.max(F.col("n0") + F.size("samples") - 1) / F.lit(fs)).alias("b_hi"))
    blocks = spans.join(info, "channel_id").select(*SESSION, "region", "block_id", "b_lo", "b_hi")
    events = durable(ev.reconcile(rows.where("kept").drop("kept", "channel_id"), rows.where("NOT kept").drop("kept", "channel_id"),
                                  info.select(*SESSION, "region"), SESSION, "region", match_tol_s, blocks))

    buffer = transient.zone_buffer_s
    zones = events.join(info, [*SESSION, "region"]).select("channel_id", ((F.col("lo") - buffer) * fs).alias("lo"), ((F.col("hi") + buffer) * fs).alias("hi"))
    t = detect.transients(clean, zones, fs, transient)
    cx, bs = durable(t["complexes"]), durable(t["bursts"])
    rates = ev.rate_summary(cx.drop("block_id"), bs.drop("block_id"), t["minutes"], detect.CHANNEL, "minutes")
    per = sm.recording_summary(manifest.select(*SESSION, "region", "valid_duration_s"), events.select(*SESSION, "region", "lo", "hi"), [*SESSION, "region"], "valid_duration_s")
    return {"manifest": manifest, "gaps": edf.gap_table(placed), "limits": limits, "rejected_blocks": rejected, "candidates": cand, "events": events,
            "complexes": cx, "bursts": bs, "iid_summary": rates, "seizure_summary": per, "status_summary": sm.status_summary(events, [*SESSION, "region"]),
            "skipped": skipped, "quality": quality(raw, manifest, fs)}
