"""Chunked signals: gap-aware blocks stored as array chunks, filtered with halos from their neighbours.

A chunk row is ``keys (channel, block ...), chunk_ix, n0, samples``: ``n0`` is the index of its first
sample and a block has no gaps inside.  Chunks are the unit of distribution, so a long or hot channel
spreads over its chunks; numpy works on one chunk plus a bounded halo.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import intervals as iv
from tidemark.operators.islands import islands
from tidemark.operators.quantiles import exact_median
from tidemark.operators.rangejoin import overlap_join
from tidemark.operators.scan import lag, last_known, lead, next_known, ordered_scan
from tidemark.session import settle

CHUNK = 4096


# ---------------------------------------------------------------- layout

def to_chunks(samples: DataFrame, keys: Sequence[str], n: str = "n", x: str = "x", length: int = CHUNK) -> DataFrame:
    """Rows of samples -> chunks of at most ``length`` samples (groups bounded by construction)."""
    packed = samples.groupBy(*keys, F.floor(F.col(n) / length).cast("long").alias("chunk_ix")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), F.col(x).cast("double").alias("x")))).alias("_s"))
    return packed.select(*keys, "chunk_ix", F.col("_s")[0]["n"].alias("n0"), F.transform("_s", lambda s: s["x"]).alias("samples"))


def to_samples(chunks: DataFrame, keys: Sequence[str], values: Sequence[str] = ("samples",)) -> DataFrame:
    """Chunks -> one row per sample: ``keys, n`` and one column per array."""
    zipped = F.arrays_zip(*values) if len(values) > 1 else F.transform(values[0], lambda x: F.struct(x.alias(values[0])))
    out = chunks.select(*keys, "n0", F.posexplode(zipped).alias("_i", "_v"))
    names = ["x" if v == "samples" else v for v in values]
    return out.select(*keys, (F.col("n0") + F.col("_i")).alias("n"), *[F.col("_v")[v].alias(a) for v, a in zip(values, names)])


def with_halo(chunks: DataFrame, keys: Sequence[str], before: int, after: int, value: str = "samples") -> DataFrame:
    """Add ``head`` (last samples of the previous chunk) and ``tail`` (first of the next) to every chunk.

    Each chunk sends its edges to its neighbours; one shuffle on (keys, chunk_ix), whatever the length
    of the channel.  ``head``/``tail`` are empty at block ends.
    """
    keys = list(keys)
    body = [c for c in chunks.columns if c not in (*keys, "chunk_ix")]
    none = F.filter(F.col(value), lambda x: F.lit(False))
    last = F.when(F.size(value) > before, F.slice(value, F.size(value) - before + 1, F.lit(before))).otherwise(F.col(value)) if before else none
    first = F.slice(value, 1, after) if after else none
    own = F.struct(F.col("chunk_ix").alias("c"), F.struct(*body).alias("own"), F.lit(None).cast("array<double>").alias("head"),
                   F.lit(None).cast("array<double>").alias("tail"))
    empty = F.lit(None).cast(chunks.select(F.struct(*body).alias("b")).schema["b"].dataType)
    to_next = F.struct((F.col("chunk_ix") + 1).alias("c"), empty.alias("own"), last.alias("head"), F.lit(None).cast("array<double>").alias("tail"))
    to_prev = F.struct((F.col("chunk_ix") - 1).alias("c"), empty.alias("own"), F.lit(None).cast("array<double>").alias("head"), first.alias("tail"))
    sent = chunks.select(*keys, F.inline(F.array(own, to_next, to_prev)))
    met = sent.groupBy(*keys, F.col("c").alias("chunk_ix")).agg(
        F.first("own", True).alias("own"), F.first("head", True).alias("head"), F.first("tail", True).alias("tail"))
    blank = F.array().cast("array<double>")
    return met.where("own IS NOT NULL").select(*keys, "chunk_ix", "own.*", F.coalesce("head", blank).alias("head"),
                                               F.coalesce("tail", blank).alias("tail"))


def block_apply(chunks: DataFrame, keys: Sequence[str], fn: Callable[[np.ndarray, int, int], np.ndarray], halo: int,
                out: str = "samples", value: str = "samples") -> DataFrame:
    """Apply a numpy function chunk by chunk with ``halo`` samples on both sides inside the block.

    ``fn(padded, a, b)`` gets head + samples + tail and returns the values of ``padded[a:b]``; at block
    ends the halo is short, as for a filter over the whole block.
    """
    wide = with_halo(chunks, keys, halo, halo, value)
    names = [c for c in wide.columns if c not in ("head", "tail")]
    keep = [c for c in names if c != out]
    schema = T.StructType([wide.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            done = []
            for head, body, tail in zip(pdf["head"], pdf[value], pdf["tail"]):
                head, body, tail = (np.asarray(v, dtype=float) for v in (head, body, tail))
                if len(body) < halo and len(head) and len(tail):
                    raise ValueError(f"halo of {halo} samples exceeds a chunk of {len(body)}: use longer chunks")
                done.append(fn(np.concatenate([head, body, tail]), len(head), len(head) + len(body)))
            result = pdf[keep].copy()
            result[out] = done
            yield result

    return wide.mapInPandas(run, schema)


# ---------------------------------------------------------------- filters

@lru_cache(maxsize=64)
def band_taps(lo: float, hi: float, fs: float, width: float) -> np.ndarray:
    """Linear-phase band-pass: Hamming-windowed sinc with transition ``width`` (Hz), unit gain mid-band."""
    half = int(np.ceil(1.65 * fs / width))
    k = np.arange(-half, half + 1)
    taps = (2 * hi / fs * np.sinc(2 * hi / fs * k) - 2 * lo / fs * np.sinc(2 * lo / fs * k)) * np.hamming(2 * half + 1)
    mid = (lo + hi) / 2
    return taps / abs(np.sum(taps * np.exp(-2j * np.pi * mid / fs * k)))


@lru_cache(maxsize=64)
def stop_taps(centre: float, halfwidth: float, fs: float) -> np.ndarray:
    """Linear-phase band-stop around ``centre``: all-pass minus a band-pass with unit gain at the centre."""
    taps = -band_taps(centre - halfwidth, centre + halfwidth, fs, halfwidth)
    taps = taps.copy()
    taps[len(taps) // 2] += 1.0
    return taps


@lru_cache(maxsize=16)
def hilbert_taps(half: int) -> np.ndarray:
    """Odd-length Hilbert transformer (Hamming window)."""
    k = np.arange(-half, half + 1)
    odd = k % 2 != 0
    taps = np.zeros(2 * half + 1)
    taps[odd] = 2 / (np.pi * k[odd])
    return taps * np.hamming(2 * half + 1)


def convolve_at(x: np.ndarray, taps: np.ndarray, a: int, b: int) -> np.ndarray:
    """Delay-compensated convolution of ``x`` (zeros beyond its ends) evaluated at positions a..b-1."""
    start = len(taps) // 2
    return np.convolve(x, taps)[start + a:start + b]


def fir(chunks: DataFrame, keys: Sequence[str], taps: np.ndarray, out: str = "samples", value: str = "samples") -> DataFrame:
    """FIR filter per block; equal to filtering the whole block because its support is finite."""
    return block_apply(chunks, keys, lambda x, a, b: convolve_at(x, taps, a, b), len(taps) // 2, out, value)


def bandpass(chunks: DataFrame, keys: Sequence[str], band: tuple[float, float], fs: float, width: float = 4.0, out: str = "samples") -> DataFrame:
    return fir(chunks, keys, band_taps(band[0], band[1], fs, width), out)


def notch_frequencies(base: float, harmonics: int, halfwidth: float, fs: float, top: float) -> list[float]:
    """Mains frequencies below Nyquist and inside the widest analysis band."""
    return [base * k for k in range(1, harmonics + 1) if base * k + halfwidth < min(fs / 2, top)]


def notch(chunks: DataFrame, keys: Sequence[str], freqs: Sequence[float], halfwidth: float, fs: float) -> tuple[DataFrame, DataFrame]:
    """Band-stop at every frequency; blocks shorter than three filter lengths pass unfiltered.
    Returns the chunks and ``keys, skipped`` per block."""
    keys = list(keys)
    longest = max((len(stop_taps(f, halfwidth, fs)) for f in freqs), default=0)
    lengths = chunks.groupBy(*keys).agg(F.sum(F.size("samples")).alias("_len"))
    tagged = chunks.join(lengths, keys).withColumn("_skip", F.col("_len") < 3 * longest)
    done = tagged.where("NOT _skip").drop("_len", "_skip")
    for f in freqs:
        done = fir(done, keys, stop_taps(f, halfwidth, fs))
    out = done.unionByName(tagged.where("_skip").select(*done.columns))
    return out, lengths.select(*keys, (F.col("_len") < 3 * longest).alias("skipped"))


def moving(chunks: DataFrame, keys: Sequence[str], k: int, kind: str = "mean", out: str = "samples", value: str = "samples",
           pre: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Centred moving mean or sum of ``k`` samples shrinking at block ends: k even covers
    [-k/2, k/2 - 1], k odd [-(k-1)/2, (k-1)/2]."""
    back, ahead = k // 2, (k - 1) // 2

    def run(x, a, b):
        x = pre(x) if pre else x
        total = np.concatenate([[0.0], np.cumsum(x)])
        i = np.arange(a, b)
        lo, hi = np.maximum(i - back, 0), np.minimum(i + ahead + 1, len(x))
        s = total[hi] - total[lo]
        return s / (hi - lo) if kind == "mean" else s

    return block_apply(chunks, keys, run, max(back, ahead) + (1 if pre else 0), out, value)


def hilbert_half(fs: float, lower: float) -> int:
    """Half-length of a Hilbert transformer whose transition at 0 Hz is over at half the band's lower edge."""
    return math.ceil(3.3 * fs / lower)


def energy(chunks: DataFrame, keys: Sequence[str], window: int, power: float = 4.0, hilbert_half: int | None = None) -> DataFrame:
    """Moving mean of |analytic signal|^power; the analytic signal of whole blocks, or with ``hilbert_half`` by an FIR
    Hilbert transformer of that half-length, which is an approximation but needs one shuffle only."""
    if hilbert_half is None:
        from tidemark.operators.spectra import analytic_envelope
        env = analytic_envelope(chunks, keys, "power").withColumn("power", F.transform("power", lambda x: F.pow(x, F.lit(power))))
    else:
        taps = hilbert_taps(hilbert_half)
        env = block_apply(chunks, keys, lambda x, a, b: np.hypot(x[a:b], convolve_at(x, taps, a, b)) ** power, hilbert_half, "power")
    return moving(env, keys, window, "mean", "energy", "power").drop("power")


def line_length(chunks: DataFrame, keys: Sequence[str], window: int) -> DataFrame:
    """Moving sum of |x[i] - x[i-1]| with the first difference of a block used twice."""
    def run(x, a, b):
        # one extra sample on the left tells whether the block starts inside the padded array
        d = np.abs(np.diff(x))
        d = np.concatenate([d[:1], d]) if len(d) else np.zeros(len(x))
        total = np.concatenate([[0.0], np.cumsum(d)])
        i = np.arange(a, b)
        lo, hi = np.maximum(i - window // 2, 0), np.minimum(i + (window - 1) // 2 + 1, len(x))
        return total[hi] - total[lo]
    return block_apply(chunks, keys, run, window // 2 + 1, "line_length")


def walsh(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """|sum of three step filters| of 4, 8 and 16 samples, each ahead-half minus behind-half."""
    def run(x, a, b):
        total = np.zeros(b - a)
        for m in (4, 8, 16):
            w = np.concatenate([np.ones(m // 2), -np.ones(m // 2)])
            total += np.convolve(x, w)[m // 2 + a:m // 2 + b]
        return np.abs(total)
    return block_apply(chunks, keys, run, 16, "walsh")


# ---------------------------------------------------------------- statistics of samples

def robust_stats(samples: DataFrame, keys: Sequence[str], x: str = "x", slice_by="auto") -> DataFrame:
    """Median, MAD (1 when zero), sample standard deviation, minimum and maximum per key."""
    keys = list(keys)
    samples = settle(samples)
    med = settle(exact_median(samples, keys, x, "median", slice_by))
    dev = samples.join(med, keys).withColumn("_d", F.abs(F.col(x) - F.col("median")))
    mad = exact_median(dev, keys, "_d", "mad", slice_by)
    rest = samples.groupBy(*keys).agg(F.count(x).alias("n"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return rest.join(med, keys).join(mad, keys).withColumn("mad", F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad")))


def outlier_limits(stats: DataFrame, samples: DataFrame, keys: Sequence[str], k: float, switch_pct: float, fixed: tuple[float, float],
                   x: str = "x", use_fixed: bool = False) -> DataFrame:
    """Automatic limits median +- k MAD, or the fixed ones when the automatic ones flag too much (with
    ``use_fixed`` always); ``pct_flagged`` is the share the automatic ones flag."""
    keys = list(keys)
    auto = stats.select(*keys, (F.col("median") - k * F.col("mad")).alias("_lo"), (F.col("median") + k * F.col("mad")).alias("_hi"))
    out = (F.col(x) < F.col("_lo")) | (F.col(x) > F.col("_hi"))
    share = samples.join(auto, keys).groupBy(*keys).agg((100 * F.avg(out.cast("double"))).alias("pct_flagged"))
    is_fixed = F.lit(use_fixed) | (F.col("pct_flagged") > switch_pct)
    return auto.join(share, keys).select(
        *keys, "pct_flagged", F.when(is_fixed, F.lit(fixed[0])).otherwise(F.col("_lo")).alias("lower"),
        F.when(is_fixed, F.lit(fixed[1])).otherwise(F.col("_hi")).alias("upper"),
        F.when(is_fixed, "fixed").otherwise("automatic").alias("threshold_type"))


def replace_outliers(samples: DataFrame, keys: Sequence[str], lower: Column, upper: Column, n: str = "n", x: str = "x",
                     slice_by="auto") -> DataFrame:
    """Samples outside [lower, upper] become linear inter- or extrapolations over the in-range samples of
    their block; blocks with fewer than two in-range samples stay unchanged."""
    keys = list(keys)
    good = (F.col(x) >= lower) & (F.col(x) <= upper)
    s = samples.withColumn("_g", F.when(good, F.struct(F.col(n).alias("n"), F.col(x).cast("double").alias("x"))))
    s = ordered_scan(s, keys, [n], [last_known("_p", "_g", inclusive=False), next_known("_q", "_g", inclusive=False)], slice_by)
    # a good sample also remembers the good samples around it, for extrapolation at block ends
    pair = F.when(F.col("_g").isNotNull(), F.struct(F.col("_g"), F.col("_p"), F.col("_q")))
    s = ordered_scan(s.withColumn("_pair", pair), keys, [n], [last_known("_pp", "_pair", inclusive=False), next_known("_qq", "_pair", inclusive=False)], slice_by)
    line = lambda a, b: a["x"] + (F.col(n) - a["n"]) / (b["n"] - a["n"]) * (b["x"] - a["x"])
    p, q = F.col("_p"), F.col("_q")
    new = (F.when(F.col("_g").isNotNull(), F.col(x))
            .when(p.isNotNull() & q.isNotNull(), line(p, q))
            .when(p.isNotNull() & F.col("_pp._p").isNotNull(), line(F.col("_pp._p"), p))
            .when(q.isNotNull() & F.col("_qq._q").isNotNull(), line(q, F.col("_qq._q")))
            .otherwise(F.col(x)))
    return s.select(*samples.columns, new.alias("clean"), F.col("_g").isNull().alias("is_outlier"))


def normalise(samples: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Global min-max scaling per channel (not per block)."""
    m = samples.groupBy(*keys).agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    return (samples.join(m, list(keys)).withColumn("norm", F.try_divide(F.col(x) - F.col("_a"), F.col("_b") - F.col("_a")))
                   .drop("_a", "_b"))


def trimmed_blocks(blocks: DataFrame, trim: int, min_len: int) -> tuple[DataFrame, DataFrame]:
    """Blocks cut by ``trim`` samples at both ends; those shorter than 2 trim + min_len are rejected."""
    ok = F.col("last_n") - F.col("first_n") + 1 >= 2 * trim + min_len
    kept = blocks.where(ok).withColumns({"first_n": F.col("first_n") + trim, "last_n": F.col("last_n") - trim})
    return kept, blocks.where(~ok).withColumn("reason", F.lit("too_short_after_trim"))


def global_threshold(samples: DataFrame, channel: Sequence[str], value: str, factor: float, slice_by="auto") -> DataFrame:
    """Threshold = factor x median over all blocks of a channel, and the share of samples above it."""
    med = exact_median(samples, channel, value, "median", slice_by).withColumn("threshold", F.col("median") * factor)
    pct = samples.join(med, list(channel)).groupBy(*channel).agg((100 * F.avg((F.col(value) > F.col("threshold")).cast("double"))).alias("pct_above"))
    return med.join(pct, list(channel))


def baseline_ladder(samples: DataFrame, keys: Sequence[str], x: str, steps: Sequence[float], fraction: float, step: float, cap: float) -> DataFrame:
    """Smallest ladder value with at least ``fraction`` of |x| below it, minus one step; ``cap - step``
    when none qualifies.  One pass: a conditional mean per rung."""
    share = [F.avg((F.abs(x) < v).cast("double")).alias(f"_f{i}") for i, v in enumerate(steps)]
    rung = F.coalesce(*[F.when(F.col(f"_f{i}") >= fraction, F.lit(float(v))) for i, v in enumerate(steps)])
    return samples.groupBy(*keys).agg(*share).select(*keys, F.coalesce(rung - step, F.lit(float(cap - step))).alias("baseline"))


def flat_runs(samples: DataFrame, keys: Sequence[str], n: str = "n", x: str = "x", slice_by="auto") -> DataFrame:
    """Runs of equal consecutive samples: equal values at adjacent indices are islands keyed by value."""
    pts = samples.select(*keys, F.col(x).alias("_v"), F.col(n).alias("first_n"), F.col(n).alias("last_n"))
    return islands(pts, [*keys, "_v"], "first_n", "last_n", gap=1, slice_by=slice_by, measures={"length": ("count", "first_n")})


def flat_fraction(samples: DataFrame, keys: Sequence[str], min_run: int, by: Sequence[str], slice_by="auto") -> DataFrame:
    """Share of samples lying in runs of at least ``min_run`` equal values, per ``by`` (subset of keys)."""
    runs = flat_runs(samples, keys, slice_by=slice_by)
    return runs.groupBy(*by).agg((F.sum(F.when(F.col("length") >= min_run, F.col("length")).otherwise(0)) / F.sum("length")).alias("flat_fraction"))


def chunk_flat_runs(chunks: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """``flat_runs`` from chunks: each chunk reports its runs of two or more equal samples and its edge
    runs; only those meet, so single samples are never shuffled."""
    keys = list(keys)
    schema = T.StructType([chunks.schema[k] for k in keys] + [T.StructField("_v", T.DoubleType()), T.StructField("first_n", T.LongType()), T.StructField("last_n", T.LongType())])

    def run(batches):
        import pandas as pd
        for pdf in batches:
            rows = []
            for key, n0, x in zip(pdf[keys].itertuples(index=False, name=None), pdf["n0"], pdf["samples"]):
                x = np.asarray(x, dtype=float)
                a = np.concatenate([[0], np.flatnonzero(np.diff(x) != 0) + 1])
                b = np.concatenate([a[1:], [len(x)]]) - 1
                keep = (b > a) | (a == 0) | (b == len(x) - 1)
                rows += [(*key, float(x[i]), int(n0) + int(i), int(n0) + int(j)) for i, j in zip(a[keep], b[keep])]
            yield pd.DataFrame(rows, columns=schema.names)

    runs = chunks.select(*keys, "n0", "samples").mapInPandas(run, schema)
    out = islands(runs, [*keys, "_v"], "first_n", "last_n", gap=1, slice_by=slice_by)
    return out.withColumn("length", F.col("last_n") - F.col("first_n") + 1)


def chunk_flat_fraction(chunks: DataFrame, keys: Sequence[str], min_run: int, by: Sequence[str], slice_by="auto") -> DataFrame:
    flat = chunk_flat_runs(chunks, keys, slice_by).where(F.col("length") >= min_run).groupBy(*by).agg(F.sum("length").alias("_f"))
    total = chunks.groupBy(*by).agg(F.sum(F.size("samples")).alias("_t"))
    return total.join(flat, list(by), "left").select(*by, (F.coalesce("_f", F.lit(0)) / F.col("_t")).alias("flat_fraction"))


def low_segments(samples: DataFrame, keys: Sequence[str], limit: float, min_len: int, n: str = "n", x: str = "x", slice_by="auto") -> DataFrame:
    """Segments with |x| below ``limit`` for more than ``min_len`` samples."""
    pts = samples.where(F.abs(x) < limit).select(*keys, F.col(n).alias("first_n"), F.col(n).alias("last_n"))
    out = islands(pts, keys, "first_n", "last_n", gap=1, slice_by=slice_by)
    return out.where(F.col("last_n") - F.col("first_n") + 1 > min_len)


def quantisation_step(samples: DataFrame, keys: Sequence[str], x: str = "x", slice_by="auto") -> DataFrame:
    """Smallest positive difference of distinct values, and how many there are."""
    d = samples.select(*keys, x).distinct()
    d = ordered_scan(d, keys, [x], [lag("_p", x)], slice_by)
    return d.groupBy(*keys).agg(F.min(F.col(x) - F.col("_p")).alias("step"), F.count(F.lit(1)).alias("n_distinct"))


def clipped_share(samples: DataFrame, dims: DataFrame, keys: Sequence[str], x: str = "x") -> DataFrame:
    """Percentage of samples within half a step of a physical limit (``phys_min, phys_max, step``)."""
    near = lambda c: F.abs(F.col(x) - F.col(c)) <= F.col("step") / 2
    return samples.join(dims, list(keys)).groupBy(*keys).agg((100 * F.avg((near("phys_min") | near("phys_max")).cast("double"))).alias("pct_clipped"))


def dilate(samples: DataFrame, keys: Sequence[str], flag: str, d: int, n: str = "n", slice_by="auto") -> DataFrame:
    """Flag samples within ``d`` of a flagged one: nearest flagged neighbour on either side."""
    at = F.when(F.col(flag), F.col(n))
    near = ordered_scan(samples, keys, [n], [last_known("_p", at), next_known("_q", at)], slice_by)
    hit = (F.col(n) - F.col("_p") <= d) | (F.col("_q") - F.col(n) <= d)
    return near.withColumn("dilated", F.coalesce(hit, F.lit(False))).drop("_p", "_q")


def decimate(samples: DataFrame, keys: Sequence[str], points: int, n: str = "n", x: str = "x") -> DataFrame:
    """Min and max of every bucket in time order (display series); short channels pass unchanged."""
    keys = list(keys)
    size = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("_t"), F.min(n).alias("_n0"))
    s = samples.join(size, keys)
    block = F.ceil(F.col("_t") / points)
    short = s.where(F.col("_t") <= 2 * points).select(*keys, n, x)
    b = s.where(F.col("_t") > 2 * points).withColumn("_b", F.floor((F.col(n) - F.col("_n0")) / block))
    g = b.groupBy(*keys, "_b").agg(F.min(F.struct(F.col(x), F.col(n))).alias("lo"),
                                   F.max(F.struct(F.col(x).alias("x"), (-F.col(n)).alias("m"))).alias("hi"))
    two = g.select(*keys, F.inline(F.array(F.struct(F.col(f"lo.{n}").alias(n), F.col(f"lo.{x}").alias(x)),
                                           F.struct((-F.col("hi.m")).alias(n), F.col("hi.x").alias(x)))))
    return two.unionByName(short)


def histogram(samples: DataFrame, keys: Sequence[str], x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; the last bin includes its right edge."""
    b = F.least(F.floor((F.col(x) - lo) / F.lit((hi - lo) / bins)), F.lit(bins - 1)).cast("int")
    return samples.where(F.col(x).between(lo, hi)).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- spectra

def psd(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Hamming periodogram of a window (density), zero-padded to a power of two >= 256."""
    w = np.hamming(len(x))
    nfft = max(256, 1 << (len(x) - 1).bit_length())
    p = np.abs(np.fft.rfft(x * w, nfft)) ** 2 / (fs * np.sum(w ** 2))
    p[1:-1] *= 2
    return np.arange(len(p)) * fs / nfft, p


def band_power(f: np.ndarray, p: np.ndarray, lo: float, hi: float) -> float:
    m = (f >= lo) & (f <= hi)
    return float(np.trapezoid(p[m], f[m])) if m.sum() > 1 else 0.0


# ---------------------------------------------------------------- metrics of events over traces

def event_samples(events: DataFrame, chunks: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Samples of each event window (``event_id, first_n, last_n``): events meet chunks, not samples."""
    keys = list(keys)
    c = chunks.withColumn("_c1", F.col("n0") + F.size(values[0]) - 1)
    met = overlap_join(events.select(*keys, "event_id", "first_n", "last_n"), c, keys, l_lo="first_n", l_hi="last_n", r_lo="n0", r_hi="_c1")
    a = F.greatest(F.col("first_n") - F.col("n0"), F.lit(0)).cast("int")
    k = (F.least("last_n", "_c1") - F.greatest("first_n", "n0") + 1).cast("int")
    cut = met.select(*keys, "event_id", (F.col("n0") + a).alias("n0"), *[F.slice(v, a + 1, k).alias(v) for v in values])
    return to_samples(cut, [*keys, "event_id"], values)


def event_metrics(events: DataFrame, chunks: DataFrame, keys: Sequence[str], thresholds: DataFrame, channel: Sequence[str],
                  slice_by="auto") -> DataFrame:
    """ll_ratio (median line length / global median), peak and mean energy, area over the threshold and
    envelope variation of each event.  ``thresholds`` = channel, threshold, ll_median."""
    s = event_samples(events, chunks, keys, ["energy", "line_length"])
    key = [*keys, "event_id"]
    ll = exact_median(s, key, "line_length", "_ll", slice_by)
    e = s.groupBy(*key).agg(F.max("energy").alias("_max"), F.avg("energy").alias("_avg"), F.stddev_samp("energy").alias("_sd"),
                            F.sum("energy").alias("_sum"), F.count(F.lit(1)).alias("n_samples"))
    out = e.join(ll, key).join(thresholds, list(channel))
    div = lambda a, b: F.try_divide(F.col(a), F.col(b))
    return out.select(*key, "n_samples", div("_ll", "ll_median").alias("ll_ratio"), div("_max", "threshold").alias("peak_energy_ratio"),
                      div("_avg", "threshold").alias("mean_energy_ratio"), div("_sum", "threshold").alias("auc_ratio"),
                      div("_sd", "_avg").alias("envelope_cv"))


def band_ratio_db(events: DataFrame, chunks: DataFrame, keys: Sequence[str], fs: float, high=(80.0, 250.0), low=(5.0, 40.0)) -> DataFrame:
    """10 log10 of mean high-band over mean low-band power inside each event (NULL when the band does not
    fit below Nyquist).  Power is taken from FIR-filtered chunks, so a long event is never gathered."""
    key = [*keys, "event_id"]
    if high[1] >= fs / 2:
        return events.select(*key, F.lit(None).cast("double").alias("hf_ratio_db"))
    wide = bandpass(bandpass(chunks, keys, high, fs, out="_h"), keys, low, fs, out="_l")
    s = event_samples(events, wide, keys, ["_h", "_l"])
    p = s.groupBy(*key).agg(F.avg(F.col("_h") ** 2).alias("_a"), F.avg(F.col("_l") ** 2).alias("_b"))
    return p.select(*key, F.when((F.col("_a") > 0) & (F.col("_b") > 0), 10 * F.log10(F.col("_a") / F.col("_b"))).alias("hf_ratio_db"))


def longest_run(events: DataFrame, samples: DataFrame, keys: Sequence[str], above: Column, slice_by="auto") -> DataFrame:
    """Longest run of samples above the threshold inside each event window (``samples`` per event)."""
    key = [*keys, "event_id"]
    pts = samples.where(above).select(*key, F.col("n").alias("a"), F.col("n").alias("b"))
    runs = islands(pts, key, "a", "b", gap=1, slice_by=slice_by)
    best = runs.groupBy(*key).agg(F.max(F.col("b") - F.col("a") + 1).alias("longest_run"))
    return events.join(best, key, "left").na.fill(0, ["longest_run"])


# ---------------------------------------------------------------- record timing, positions

def record_gaps(records: DataFrame, keys: Sequence[str], duration: str, tol: float = 1e-3, min_gap: float = 0.5, slice_by="auto") -> DataFrame:
    """Deviation of each record's successor from its expected onset: gap (>= min_gap), anomaly
    (<= -min_gap), jitter (between, above tol) or none."""
    nxt = ordered_scan(records, keys, ["record_ix"], [lead("_next", "onset_s")], slice_by)
    dev = F.col("_next") - F.col("onset_s") - F.col(duration)
    kind = (F.when(dev.isNull() | (F.abs(dev) <= tol), "none").when(dev >= min_gap, "gap")
             .when(dev <= -min_gap, "anomaly").otherwise("jitter"))
    return nxt.withColumns({"deviation_s": dev, "kind": kind}).drop("_next")


def place_records(records: DataFrame, keys: Sequence[str], fs: Column, per_record: Column, slice_by="auto") -> DataFrame:
    """First sample index and block of each record: the cursor jumps by round(gap fs) at real gaps only."""
    from tidemark.operators.scan import running_sum
    is_gap = F.col("kind") == "gap"
    jump = F.when(is_gap, F.round(F.col("deviation_s") * fs)).otherwise(0).cast("long")
    s = records.withColumns({"_jump": jump, "_gap": is_gap.cast("long"), "_len": per_record.cast("long")})
    s = ordered_scan(s, keys, ["record_ix"], [running_sum("_before", F.col("_len") + F.col("_jump"), inclusive=False),
                                              running_sum("block_id", "_gap", inclusive=False)], slice_by)
    return s.withColumn("n0", F.col("_before")).drop("_jump", "_gap", "_len", "_before")


def path_length(track: DataFrame, queries: DataFrame, keys: Sequence[str], fs: float, slice_by="auto") -> DataFrame:
    """Displacement and path length between two times of an (x, y) track sampled at ``fs``.

    Cumulative path length makes every query two lookups; ``queries`` = keys, query_id, a, b (seconds).
    """
    keys = list(keys)
    from tidemark.operators.scan import running_sum
    step = ordered_scan(track, keys, ["n"], [lag("_px", "pos_x"), lag("_py", "pos_y")], slice_by)
    step = step.withColumn("_d", F.coalesce(F.hypot(F.col("pos_x") - F.col("_px"), F.col("pos_y") - F.col("_py")), F.lit(0.0)))
    cum = ordered_scan(step, keys, ["n"], [running_sum("_cum", "_d")], slice_by).select(*keys, "n", "pos_x", "pos_y", "_cum")
    at = lambda c: F.round(F.col(c) * fs).cast("long")
    a = cum.select(*keys, F.col("n").alias("_na"), F.col("pos_x").alias("_ax"), F.col("pos_y").alias("_ay"), F.col("_cum").alias("_ca"))
    b = cum.select(*keys, F.col("n").alias("_nb"), F.col("pos_x").alias("_bx"), F.col("pos_y").alias("_by"), F.col("_cum").alias("_cb"))
    q = queries.withColumns({"_na": at("a"), "_nb": at("b")}).join(a, [*keys, "_na"]).join(b, [*keys, "_nb"])
    return q.select(*keys, "query_id", F.hypot(F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")).alias("displacement"),
                    (F.col("_cb") - F.col("_ca")).alias("path_length"))


def outside_zones(chunks: DataFrame, zones: DataFrame, keys: Sequence[str], channel: Sequence[str], slice_by="auto") -> DataFrame:
    """Samples of a channel outside every zone (``lo, hi`` in sample indices, both inclusive).

    Zones are subtracted from the block spans first and the chunks are cut by what is left, so samples
    are never sorted or joined one by one.
    """
    keys = list(keys)
    spans = chunks.groupBy(*keys).agg(F.min("n0").alias("lo"), F.max(F.col("n0") + F.size("samples")).alias("hi"))
    cut = zones.select(*channel, F.ceil("lo").cast("long").alias("lo"), (F.floor("hi") + 1).cast("long").alias("hi"))
    per_block = cut.join(spans.select(*keys), list(channel)).select(*keys, "lo", "hi") if list(channel) != keys else cut
    left = iv.subtract(spans, per_block, keys, slice_by)
    parts = left.select(*keys, F.col("lo").alias("event_id"), F.col("lo").alias("first_n"), (F.col("hi") - 1).alias("last_n"))
    return event_samples(parts, chunks, keys, ["samples"]).drop("event_id")


def clean_chunks(chunks: DataFrame, keys: Sequence[str], limits: DataFrame, channel: Sequence[str], slice_by="auto") -> DataFrame:
    """``replace_outliers`` on chunks: each chunk meets the two nearest in-range samples on either side.

    Only the first and last two in-range samples of every chunk take part in the scan over the block;
    the interpolation itself is local.  Adds ``n_outliers`` per chunk.
    """
    keys = list(keys)
    c = chunks.join(limits.select(*channel, "lower", "upper"), list(channel))
    point = lambda x, i: F.struct((F.col("n0") + i).alias("n"), x.alias("x"))
    good = F.filter(F.transform("samples", point), lambda s: (s["x"] >= F.col("lower")) & (s["x"] <= F.col("upper")))
    c = c.withColumn("_good", good)
    ends = F.array_distinct(F.concat(F.slice("_good", 1, 2), F.slice("_good", F.greatest(F.size("_good") - 1, F.lit(1)), F.lit(2))))
    known = c.select(*keys, F.inline(ends)).withColumnRenamed("n", "_t")
    boxed = F.struct(F.col("_t").cast("double").alias("n"), F.col("x").alias("x"))
    known = ordered_scan(known, keys, ["_t"], [lag("_p", boxed), lead("_q", boxed)], slice_by)
    known = known.select(*keys, F.col("_t").cast("double").alias("_t"), F.struct(F.struct(F.col("_t").cast("double").alias("n"), "x").alias("g"), "_p", "_q").alias("_k"))
    asks = c.select(*keys, "chunk_ix", F.inline(F.array(
        F.struct((F.col("n0") - 0.5).cast("double").alias("_t"), F.lit(True).alias("_start")),
        F.struct((F.col("n0") + F.size("samples") - 0.5).cast("double").alias("_t"), F.lit(False).alias("_start")))))
    met = ordered_scan(known.unionByName(asks, allowMissingColumns=True), keys, ["_t"], [last_known("_a", "_k"), next_known("_z", "_k")], slice_by)
    near = met.where("chunk_ix IS NOT NULL").groupBy(*keys, "chunk_ix").agg(
        F.max(F.when(F.col("_start"), F.struct("_a._p", "_a.g"))).alias("_left"), F.max(F.when(~F.col("_start"), F.struct("_z.g", "_z._q"))).alias("_right"))
    has = lambda s: F.array_compact(F.array(s[0], s[1]))
    around = c.join(near, [*keys, "chunk_ix"]).select(
        *[x for x in c.columns if x != "_good"],
        has([F.col("_left._p"), F.col("_left.g")]).alias("_before"), has([F.col("_right.g"), F.col("_right._q")]).alias("_after"))
    keep = [x for x in chunks.columns if x != "samples"]
    schema = T.StructType([chunks.schema[x] for x in keep] + [T.StructField("samples", T.ArrayType(T.DoubleType())), T.StructField("n_outliers", T.LongType())])

    def run(batches):
        for pdf in batches:
            done, count = [], []
            for n0, x, lo, hi, before, after in zip(pdf["n0"], pdf["samples"], pdf["lower"], pdf["upper"], pdf["_before"], pdf["_after"]):
                x = np.array(x, dtype=float)
                bad = (x < lo) | (x > hi)
                count.append(int(bad.sum()))
                if bad.any():
                    at = np.arange(len(x)) + float(n0)
                    side = lambda pts: (np.array([p["n"] for p in pts], float), np.array([p["x"] for p in pts], float))
                    (bn, bx), (an, ax) = side(before), side(after)
                    gn, gx = np.concatenate([bn, at[~bad], an]), np.concatenate([bx, x[~bad], ax])
                    if len(gn) >= 2:
                        j = np.clip(np.searchsorted(gn, at[bad]), 1, len(gn) - 1)
                        x[bad] = gx[j - 1] + (at[bad] - gn[j - 1]) / (gn[j] - gn[j - 1]) * (gx[j] - gx[j - 1])
                    else:
                        count[-1] = 0
                done.append(x)
            out = pdf[keep].copy()
            out["samples"], out["n_outliers"] = done, count
            yield out

    return around.mapInPandas(run, schema)
