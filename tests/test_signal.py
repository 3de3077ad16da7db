import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import SustainedConfig, TransientConfig
from tidemark.operators import signal as sg
from tidemark.operators import spectra as sp
from tidemark.operators.peaks import find_peaks, local_maxima
from tidemark.plans import detect

FS = 256.0
BLOCK = ["channel_id", "block_id"]


def chunked(spark, signals, length=512):
    """{(channel, block): (n0, array)} -> chunk rows."""
    rows = []
    for (ch, blk), (n0, x) in signals.items():
        for c in range(n0 // length, (n0 + len(x) - 1) // length + 1):
            a, b = max(n0, c * length), min(n0 + len(x), (c + 1) * length)
            rows.append((ch, blk, c, a, [float(v) for v in x[a - n0:b - n0]]))
    return spark.createDataFrame(rows, "channel_id string, block_id int, chunk_ix long, n0 long, samples array<double>")


def series(df, column="x"):
    out = {}
    for r in df.orderBy("channel_id", "n").collect():
        out.setdefault((r["channel_id"], r["block_id"]), []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


def brute_peaks(x, height, prominence, width, distance):
    rows = []
    for i in local_maxima(x):
        h = x[i]
        if h < height:
            continue
        l = i
        while l > 0 and x[l - 1] <= h:
            l -= 1
        r = i
        while r < len(x) - 1 and x[r + 1] <= h:
            r += 1
        bases = ([x[l:i].min()] if l < i else []) + ([x[i + 1:r + 1].min()] if r > i else [])
        p = h - max(bases)
        if p < prominence:
            continue
        lev = h - p / 2
        a = i
        while a > 0 and x[a] > lev:
            a -= 1
        left = a + (lev - x[a]) / (x[a + 1] - x[a]) if x[a] <= lev else 0
        b = i
        while b < len(x) - 1 and x[b] > lev:
            b += 1
        right = b - (lev - x[b]) / (x[b - 1] - x[b]) if x[b] <= lev else len(x) - 1
        if right - left <= width:
            rows.append((i, h, p))
    kept = []
    for i, h, p in sorted(rows, key=lambda q: (-q[1], q[0])):
        if all(abs(i - k[0]) > distance for k in kept):
            kept.append((i, h, p))
    return sorted(kept)


def test_chunked_filters_equal_whole_block(spark):
    rng = np.random.default_rng(0)
    sig = {("a", 1): (0, rng.normal(size=2000)), ("a", 2): (2300, rng.normal(size=1500)), ("b", 1): (100, rng.normal(size=700))}
    c = chunked(spark, sig)
    taps = sg.band_taps(5.0, 75.0, FS, 8.0)
    got = series(sg.to_samples(sg.fir(c, BLOCK, taps), BLOCK))
    for k, (_, x) in sig.items():
        assert np.allclose(got[k], np.convolve(x, taps)[len(taps) // 2:len(taps) // 2 + len(x)])
    got = series(sg.to_samples(sg.line_length(c, BLOCK, 64), BLOCK, ["line_length"]), "line_length")
    for k, (_, x) in sig.items():
        d = np.abs(np.diff(x)); d = np.concatenate([d[:1], d])
        want = [d[max(0, i - 32):i + 32].sum() for i in range(len(x))]
        assert np.allclose(got[k], want)


def test_filter_design_depth():
    fs, f = 512.0, lambda taps, hz: 20 * np.log10(abs(np.sum(taps * np.exp(-2j * np.pi * hz / fs * np.arange(len(taps))))) + 1e-12)
    taps = sg.stop_taps(50.0, 1.0, fs)
    assert f(taps, 50.0) < -50
    assert max(abs(f(taps, h)) for h in np.arange(5, 45.5, 0.5)) < 0.1
    assert sg.notch_frequencies(50.0, 4, 1.0, 512.0, 120.0) == [50.0, 100.0]


def test_halo_longer_than_a_chunk_is_refused(spark):
    c = chunked(spark, {("a", 1): (0, np.ones(100))}, length=16)
    with pytest.raises(Exception, match="exceeds a chunk"):
        sg.fir(c, BLOCK, np.ones(81) / 81).collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_peaks_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    sig = {}
    for ch in "abc":
        x = np.abs(np.convolve(rng.normal(size=3000), np.hanning(9), "same")) * 50
        x[rng.integers(0, 3000, 5)] += 400
        x[1000:1003] = 77.0                                   # a plateau
        sig[(ch, 1)] = (0, np.round(x, 1))
    c = chunked(spark, sig, 256).withColumn("height", F.lit(40.0))
    got = {}
    for r in find_peaks(c, BLOCK, prominence=30.0, width=12, distance=10).collect():
        got.setdefault((r.channel_id, r.block_id), []).append((r.n, r.h, r.prominence))
    for k, (_, x) in sig.items():
        want = brute_peaks(x, 40.0, 30.0, 12, 10)
        have = sorted(got.get(k, []))
        assert [p[0] for p in have] == [p[0] for p in want]
        assert np.allclose([p[2] for p in have], [p[2] for p in want])


def test_clean_chunks_equals_sample_scan(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=1500); x[400:950] = 99; x[:3] = -99; x[-2:] = 99; x[600] = 0.5
    sig = {("a", 1): (0, x), ("a", 2): (1700, np.array([99.0, 1.0, 99.0])), ("b", 1): (0, rng.normal(size=300))}
    c = chunked(spark, sig, 128)
    limits = spark.createDataFrame([("a", -5.0, 5.0), ("b", -5.0, 5.0)], "channel_id string, lower double, upper double")
    got = series(sg.to_samples(sg.clean_chunks(c, BLOCK, limits, ["channel_id"]), BLOCK))
    want = series(sg.replace_outliers(sg.to_samples(c, BLOCK), BLOCK, F.lit(-5.0), F.lit(5.0)), "clean")
    for k in sig:
        assert np.allclose(got[k], want[k])
    assert np.allclose(got[("a", 2)], [99, 1, 99])            # one good sample: unchanged


def planted(seconds=240, seed=5):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * FS)) / FS
    x = rng.normal(0, 10, len(t))
    on = (t > 100) & (t < 120)
    x[on] += 400 * np.sin(2 * np.pi * 20 * t[on]) * np.sign(np.sin(2 * np.pi * 3 * t[on]))
    return t, x


def test_sustained_event_is_found(spark):
    _, x = planted()
    c = chunked(spark, {("a", 1): (0, x), ("b", 1): (0, np.random.default_rng(9).normal(0, 10, len(x)))}, 4096)
    tr, th, rejected = detect.traces(c, FS)
    cand = detect.candidates(tr, th, FS, raw=c).where("kept").collect()
    assert rejected.count() == 0
    assert [r.channel_id for r in cand] == ["a"]
    assert abs(cand[0].start_s - 100) < 2 and abs(cand[0].end_s - 120) < 2
    assert cand[0].ll_ratio > 1.75 and not cand[0].over_max_duration
    assert detect.legacy_events(tr, th, FS).count() == 1
    diag = detect.threshold_diagnostic(tr, detect.candidates(tr, th, FS), spark.createDataFrame(
        [("a", 100 * FS, 121 * FS)], "channel_id string, lo double, hi double"), FS).where("channel_id = 'a'").first()
    assert diag.energy_change_pct < 0 and diag.n_candidates == 1


def test_transients_complexes_and_zones(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 8, int(120 * FS))
    spike = 900 * np.sin(2 * np.pi * 30 * np.arange(8) / FS)
    at = [20.0, 20.1, 40.0, 60.0, 80.0, 80.1, 80.2]
    for s in at:
        x[int(s * FS):int(s * FS) + 8] += spike
    c = chunked(spark, {("a", 1): (0, x)}, 2048)
    zones = spark.createDataFrame([("a", 55 * FS, 65 * FS)], "channel_id string, lo double, hi double")
    out = detect.transients(c, zones, FS, TransientConfig(prominence=100.0))
    got = sorted((round(r.start / FS), r.n_spikes >= 2) for r in out["complexes"].collect())
    assert got == [(20, True), (40, False), (80, True)]
    assert abs(out["minutes"].first().minutes - 110 / 60) < 0.01
    assert out["baseline"].first().baseline == 95.0


def test_walsh_and_hysteresis_detectors_run(spark):
    _, x = planted(120 + 60)
    c = chunked(spark, {("a", 1): (0, x)}, 4096)
    found, share = detect.walsh_detector(c, FS, 150.0)
    assert found.where(F.col("first_n").between(99 * FS, 121 * FS)).count() > 0
    assert share.first().pct_both > 0
    hy = detect.hysteresis_events(c, FS).collect()
    assert len(hy) == 1 and abs(hy[0].first_n / FS - 100) < 3


def test_window_spectra_and_notch_verdict(spark):
    t = np.arange(int(60 * FS)) / FS
    x = np.random.default_rng(1).normal(0, 5, len(t)) + 60 * np.sin(2 * np.pi * 50 * t)
    c = chunked(spark, {("a", 1): (0, x)}, 2048)
    done, skipped = sg.notch(c, BLOCK, [50.0], 1.0, FS)
    row = sp.verify_notch(c, done, BLOCK, ["channel_id"], FS).first()
    assert row.verdict == "applied" and row.raw_db > 15 and row.filtered_harmonics == [] and row.lag == 0 and row.lag_r > 0.9
    assert not skipped.first().skipped
    w = sp.window_spectra(c, BLOCK, FS, 1024)
    assert [r.n for r in w.orderBy("n").limit(3).collect()] == [0, 512, 1024]
    assert w.count() == (len(x) - 1024) // 512 + 1


def test_peaks_resolve_over_groups_of_chunks(spark, monkeypatch):
    import tidemark.operators.peaks as pk
    monkeypatch.setattr(pk, "GROUP", 3)
    x = np.round(np.abs(np.convolve(np.random.default_rng(7).normal(size=2500), np.hanning(9), "same")) * 50, 1)
    c = chunked(spark, {("a", 1): (0, x)}, 64).withColumn("height", F.lit(40.0))
    got = sorted((r.n, r.prominence) for r in pk.find_peaks(c, BLOCK, prominence=30.0, width=12, distance=10).collect())
    want = [(i, p) for i, _, p in brute_peaks(x, 40.0, 30.0, 12, 10)]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_chunk_flat_runs_equal_sample_runs(spark):
    x = np.random.default_rng(2).integers(0, 2, 900).astype(float)
    x[100:180] = 5.0
    c = chunked(spark, {("a", 1): (0, x), ("a", 2): (1000, np.zeros(70))}, 64)
    a = sg.chunk_flat_fraction(c, BLOCK, 6, ["channel_id"]).first().flat_fraction
    b = sg.flat_fraction(sg.to_samples(c, BLOCK), BLOCK, 6, ["channel_id"]).first().flat_fraction
    assert abs(a - b) < 1e-12 and a > 0.1


def test_spacing_in_slices_equals_a_walk_by_height(spark, monkeypatch):
    import tidemark.operators.peaks as pk
    monkeypatch.setattr(pk, "SLICE", 32)
    rng = np.random.default_rng(5)
    rows = [(k, int(n), float(h)) for k in (1, 2, 3) for n, h in zip(np.flatnonzero(rng.random(600) < 0.5) - 40, rng.integers(0, 6, 600))]
    rows += [(4, n, float(n)) for n in range(0, 400, 2)]  # one chain across all slices
    got = {(r.k, r.n) for r in pk.spaced(spark.createDataFrame(rows, "k int, n long, h double"), ["k"], 3).collect()}
    want = set()
    for k in (1, 2, 3, 4):
        kept = []
        for n, _ in sorted(((n, h) for c, n, h in rows if c == k), key=lambda p: (-p[1], p[0])):
            if all(abs(n - m) > 3 for m in kept):
                kept.append(n)
        want |= {(k, n) for n in kept}
    assert got == want


def test_peaks_of_many_short_blocks_take_no_call_per_block(spark, monkeypatch):
    """Blocks share the calls of a task: 300 blocks went through 600 grouped calls before."""
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda *a, **k: pytest.fail("a call per block"))
    x = np.tile([0.0, 9, 0, 50, 0, 30, 20, 40, 0], 3)
    c = chunked(spark, {(f"c{i}", 1): (0, x + i) for i in range(300)}, 8).withColumn("height", F.lit(5.0))
    got = find_peaks(c, BLOCK, prominence=5.0, width=6, distance=3).groupBy("channel_id").agg(F.array_sort(F.collect_list("n")).alias("n")).collect()
    assert len(got) == 300 and all(r.n == [p[0] for p in brute_peaks(x, 5.0, 5.0, 6, 3)] for r in got)
