import tempfile

import numpy as np
from pyspark.sql import functions as F

from tests.test_sources import edf_bytes
from tidemark.config import TransientConfig
from tidemark.plans import recordings
from tidemark.sources import edf

FS = 256


def test_folder_to_event_tables(spark):
    rng = np.random.default_rng(4)
    n = 170
    t = np.arange(n * FS) / FS
    right, left = (rng.normal(0, 15, len(t)) for _ in range(2))
    on = (t > 60) & (t < 78)
    right[on] += 420 * np.sin(2 * np.pi * 20 * t[on])
    left[on] += 380 * np.sin(2 * np.pi * 20 * t[on])
    for s in (125.0, 125.08, 140.0):
        right[int(s * FS):int(s * FS) + 8] += 800 * np.sin(2 * np.pi * 30 * np.arange(8) / FS)
    cut = lambda x, r: np.clip(np.round(x[r * FS:(r + 1) * FS]), -1000, 1000)
    onsets = [r if r < 100 else r + 2 for r in range(n)]       # a two-second gap after 100 s
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    open(f"{d}/m1.edf", "wb").write(edf_bytes(["R", "L"], [[cut(right, r), cut(left, r)] for r in range(n)], onsets, spr=FS))
    regions = spark.createDataFrame([("R", "HPCr"), ("L", "HPCl")], "channel_label string, region string")
    out = recordings.run(edf.files(spark, d), regions, float(FS), transient=TransientConfig(prominence=150.0))
    m = out["manifest"].where("region = 'HPCr'").first()
    assert m.n_gaps == 1 and m.n_samples == (n + 2) * FS and m.n_valid_samples == n * FS
    e = out["events"].collect()
    assert sorted(r.region for r in e) == ["HPCl", "HPCr"] and {r.detection_status for r in e} == {"accepted"}
    assert all(abs(r.lo - 60) < 2 and abs(r.hi - 78) < 2 and r.is_bilateral_accepted for r in e)
    cx = sorted((round(r.start / FS), r.n_spikes >= 2) for r in out["complexes"].where(F.col("channel_id").endswith("R")).collect())
    assert cx == [(127, True), (142, False)]                   # after the gap
    s = out["status_summary"].first()
    assert s.n_accepted == 1 and s.n_events == 1
    rates = {r.channel_id[-1]: r for r in out["iid_summary"].collect()}
    assert rates["R"].n_complexes == 2 and rates["L"].n_complexes == 0
    assert out["skipped"].isEmpty() and out["gaps"].first().duration_s == 2.0
    q = {r.region: r for r in out["quality"].collect()}
    assert q["HPCr"].step > 0 and q["HPCr"].quality_class in ("ok", "low_amplitude", "unusable", "line_contaminated")
