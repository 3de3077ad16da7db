"""Analysis parameters.  Defaults are the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SustainedConfig:
    """Sustained high-energy events."""
    band: tuple[float, float] = (5.0, 75.0)
    power: float = 4.0
    window_s: float = 2.0
    edge_trim_s: float = 1.0
    median_factor: float = 10.0
    legacy_min_s: float = 15.0
    merge_gap_s: float = 2.0
    max_s: float = 60.0
    min_s: float = 10.0
    ll_window_s: float = 2.0
    ll_threshold: float = 1.75
    ll_accept: float | None = 1.90
    ll_reject: float | None = 1.60


@dataclass(frozen=True)
class TransientConfig:
    """Short transients (peaks, complexes, bursts); amplitudes in microvolts."""
    band: tuple[float, float] = (15.0, 70.0)
    baseline_start: float = 100.0
    baseline_step: float = 5.0
    baseline_top: float = 130.0
    baseline_fraction: float = 0.97
    lower_factor: float = 2.5
    upper: float = 2000.0
    prominence: float = 200.0
    distance_s: float = 0.030
    width_s: float = 0.060
    spike_gap_ms: float = 150.0
    burst_gap_s: float = 5.0
    burst_min_n: int = 3
    burst_min_s: float = 4.0
    burst_max_s: float = 40.0
    zone_buffer_s: float = 5.0


@dataclass(frozen=True)
class QualityConfig:
    """Signal quality: limits in dB, percent of time and multiples of the reference amplitude."""
    window_s: float = 4.0
    scale_band: tuple[float, float] = (15.0, 70.0)
    line_hz: float = 50.0
    line_db: float = 10.0
    line_intermittent_pct: float = 10.0
    low_snr_db: float = 26.0
    min_snr_db: float = 12.0
    attenuation_ratio: float = 3.0


@dataclass(frozen=True)
class CleanConfig:
    """Outlier limits: fixed ones, or automatic ones that give way to them when they flag too much."""
    use_fixed: bool = True
    k: float = 10.0
    switch_pct: float = 0.1
    fixed: tuple[float, float] = (-2500.0, 2500.0)
    mains_hz: float = 50.0
    harmonics: int = 1
    halfwidth_hz: float = 2.0


def band_limits(cfg: SustainedConfig) -> tuple[float, float, bool]:
    """(accept, reject, band on): the review band needs both limits and reject <= accept."""
    if cfg.ll_accept is None or cfg.ll_reject is None:
        return cfg.ll_threshold, cfg.ll_threshold, False
    if cfg.ll_reject > cfg.ll_accept:
        raise ValueError("ll_reject must not exceed ll_accept")
    return cfg.ll_accept, cfg.ll_reject, True
