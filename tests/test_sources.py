import tempfile

import numpy as np
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.operators import signal as sg
from tidemark.sources import edf, intan, store, text


def edf_bytes(labels, records, onsets, dur=1.0, spr=4, unit="mV"):
    """Small EDF+D file: ``records[r][s]`` int16 arrays, one annotation channel with the onsets."""
    ns = len(labels) + 1
    pad = lambda v, n: str(v).encode().ljust(n)[:n]
    ann = 32
    head = pad("0", 8) + pad("x", 80) + pad("y", 80) + pad("31.03.26", 8) + pad("20.40.00", 8) + pad(256 * (ns + 1), 8) + pad("EDF+D", 44) + pad(len(records), 8) + pad(dur, 8) + pad(ns, 4)
    names = [*labels, "EDF Annotations"]
    for width, vals in ((16, names), (80, [""] * ns), (8, [unit] * ns), (8, [-1] * ns), (8, [1] * ns), (8, [-1000] * ns), (8, [1000] * ns), (80, [""] * ns),
                        (8, [spr] * (ns - 1) + [ann // 2]), (32, [""] * ns)):
        head += b"".join(pad(v, width) for v in vals)
    body = b""
    for r, rec in enumerate(records):
        for x in rec:
            body += np.asarray(x, "<i2").tobytes()
        tal = f"+{onsets[r]}".encode() + b"\x14\x14\x00"
        if r == 1:
            tal += b"+1.5\x14note\x14\x00"
        body += tal.ljust(ann, b"\x00")
    return head + body


def test_edf_gaps_blocks_and_identity(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rng = np.random.default_rng(0)
    rec = [[rng.integers(-900, 900, 4), rng.integers(-900, 900, 4)] for _ in range(6)]
    onsets = [0, 1, 2.5, 3.5 + 0.499, 3.9, 6.0]               # gap 0.5, jitter 0.499, anomaly, gap
    open(f"{d}/a.EDF", "wb").write(edf_bytes(["EEG R", "L"], rec, onsets))
    files = edf.files(spark, d)
    span = edf.header_span(files, "Europe/Paris").first()
    assert str(span.start) == "2026-03-31 18:40:00" and (span.end - span.start).total_seconds() == 6
    r = edf.records(files)
    p = edf.placed(r).cache()
    kinds = [x.kind for x in p.where("channel_label = 'L'").orderBy("record_ix").collect()]
    assert kinds == ["none", "gap", "jitter", "anomaly", "gap", "none"]
    m = edf.manifest(p).where("channel_label = 'L'").first()
    assert (m.n_valid_samples, m.n_gaps, m.n_jitter, m.n_anomaly) == (24, 2, 1, 1)
    gaps = edf.gap_table(p).orderBy("start_s").collect()
    assert [round(g.duration_s, 3) for g in gaps] == [0.5, 1.1]
    assert m.n_samples == 24 + 2 + 4                          # round(0.5*4) + round(1.1*4)
    c = edf.chunks(p, 2)
    s = sg.to_samples(c, ["channel_id", "block_id"]).where("channel_id = 'a.EDF|L'").orderBy("n").collect()
    want = np.concatenate([x[1] for x in rec]) / 1000 * 1000  # +-1 mV over +-1000 codes, in microvolts
    assert np.allclose([x.x for x in s], want)
    assert [x.n for x in s][8] == 10 and s[8].block_id == 1
    a = edf.annotations(r).collect()
    assert [(x.text, x.onset_s) for x in a] == [("note", 1.5)]
    wanted = spark.createDataFrame([("a.EDF", "r", "HPCr"), ("a.EDF", "L", "HPCl"), ("a.EDF", "Q", "x")], "source_file string, label string, region string")
    assert {x.label: x.match for x in edf.select_channels(r.where("samples IS NOT NULL"), wanted).collect()} == {"r": "loose", "L": "exact", "Q": "missing"}


def test_text_signal_keeps_file_order(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    x = np.round(np.random.default_rng(1).normal(size=5000), 4)
    with open(f"{d}/s1.txt", "w") as f:
        f.write("# subject_id = 097\n# fs = 512\n# session_start_unix = 1774982400.5\n# odd key = a = b\n")
        f.write("\n".join("NaN" if i == 7 else str(v) for i, v in enumerate(x)) + "\n")
    open(f"{d}/s2.txt", "w").write("# subject_id = 5\n1\n2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        s = text.signal_samples(spark, f"{d}/s1.txt").orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.n for r in s] == list(range(5000)) and s[7].x is None
    assert all(r.x == v for i, (r, v) in enumerate(zip(s, x)) if i != 7)
    h = text.signal_headers(spark, d)
    m = text.signal_meta(h).where("subject_id = '097'").first()
    assert m.fs == 512 and m.headers["odd key"] == "a = b" and str(m.session_start) == "2026-03-31 18:40:00.500000"
    assert [r.path.rsplit("/", 1)[1] for r in text.invalid_headers(h).collect()] == ["s2.txt"]


def test_typed_csv_markers_defaults_and_text_ids(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    open(f"{d}/b.csv", "w").write("subject_id,region,start_abs,n_complexes,detection_status\n097,HPCr,31-Mar-2026 20:40:36.250,4,rescued\n")
    sch = schemas.table("subject_id:s region:s start_abs:t n_complexes:i note:s")
    r = text.typed_csv(spark, f"{d}/b.csv", sch, "Europe/Paris", {"note": "-"}, {"detection_status": schemas.table("detection_status:s")}).first()
    assert (r.subject_id, r.n_complexes, r.note, r.detection_status, str(r.start_abs)) == ("097", 4, "-", "rescued", "2026-03-31 18:40:36.250000")
    try:
        text.typed_csv(spark, f"{d}/b.csv", schemas.table("missing:s"), "UTC")
        raise AssertionError
    except ValueError as e:
        assert "missing" in str(e)
    open(f"{d}/g.csv", "w").write('subject_id,region,start_abs,end_abs,notes\n005-s,,2026-03-31 20:40:36,2026-03-31 20:40:54,"a, b"\n005-s,HPCr,2026-04-01 02:00:58,2026-04-01 02:01:19,\n')
    g = text.ground_truth(spark, f"{d}/g.csv", "Europe/Paris").orderBy("gt_id").collect()
    assert [(x.gt_id, x.region, x.notes, str(x.start_abs)) for x in g] == [(1, "", "a, b", "2026-03-31 18:40:36"), (2, "HPCr", "", "2026-04-01 00:00:58")]
    open(f"{d}/r.csv", "w").write('user_check,,user_check\nTP,x\n\n"q,1",,FP\n,,\n')
    raw = text.raw_csv(spark, f"{d}/r.csv", 3).collect()
    assert [tuple(x) for x in raw] == [("user_check", "", "user_check"), ("TP", "x", ""), ("q,1", "", "FP")]


def test_intan_layouts(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    x = np.arange(40, dtype="<i2")
    open(f"{d}/amp-A-003.dat", "wb").write(x.tobytes())
    open(f"{d}/amp-B-009.dat", "wb").write(x.tobytes())
    animals = spark.createDataFrame([("A", "m1"), ("B", "m2")], "port string, subject_id string")
    regions = spark.createDataFrame([("003", "HPCr")], "suffix string, region string")
    got = intan.per_channel(spark, d, regions, animals, 16).orderBy("n0").collect()
    assert [(r.subject_id, r.region, r.n0) for r in got] == [("m1", "HPCr", 0), ("m1", "HPCr", 16), ("m1", "HPCr", 32)]
    assert np.allclose(np.concatenate([r.samples for r in got]), x * 0.195)
    d2 = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    open(f"{d2}/amplifier.dat", "wb").write(x.tobytes())
    lanes = [("A", "HPCr"), ("B", "HPCl")]
    a = intan.interleaved(spark, d2, lanes, animals, length=100).where("region = 'HPCl'").first()
    assert a.subject_id == "m2" and np.allclose(a.samples, x[1::2] * 0.195)
    assert intan.interleaved(spark, d2, lanes, animals, inverted=True, length=100).where("region = 'HPCl'").first().subject_id == "m1"
    cut = intan.crop(intan.decode(spark.read.format("binaryFile").load(d2), 1, 16), ["path"], 10, 20).orderBy("n0").collect()
    assert [(r.n0, len(r.samples)) for r in cut] == [(10, 6), (16, 5)]


def test_store_resume_reuse_and_slicing(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    open(f"{d}/a.csv", "w").write("x"); open(f"{d}/b.csv", "w").write("y")
    now = store.import_key(store.file_manifest(spark, d, "*.csv"), ["L", "R"], 512)
    assert store.pending_imports(now, now.where(F.col("path").endswith("a.csv"))).count() == 1
    assert store.pending_imports(now, store.import_key(store.file_manifest(spark, d, "*.csv"), ["L"], 512)).count() == 2
    assert {r.sha1 for r in store.snapshot(spark, d).collect()} == {"11f6ad8ec52a2984abaafd7c3b516503785c2072", "95cb0bfd2977c761298d9624e4b4d4c72a39974a"}
    w = spark.createDataFrame([(1, "n", "auto", 2.0, "on"), (2, "n", "auto", 2.0, "on"), (3, "n", "off", None, "off")], "k int, case string, gain_source string, gain double, notch string")
    s = spark.createDataFrame([(1, "n", "auto", 2.0 + 1e-10, "on"), (2, "n", "auto", 2.1, "on")], w.schema)
    assert [r.status for r in store.resume_status(w, s, ["k"]).orderBy("k").collect()] == ["skipped", "reprocessed", "new"]
    rec = spark.createDataFrame([(float(i), 4) for i in range(10)], "onset_s double, n int").withColumn("f", F.lit("a"))
    cut = store.cut_records(rec, [3.0, 7.0])
    assert [r["count"] for r in cut.groupBy("slice").count().orderBy("slice").collect()] == [3, 4, 3]
    assert store.slice_accounting(rec, cut, ["f"], "n").isEmpty() and not store.slice_accounting(rec, cut.where("slice > 0"), ["f"], "n").isEmpty()
    t = spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, v int")
    store.write_checkpoint(t, f"{d}/ck")
    store.write_checkpoint(t.where("v = 2").withColumn("v", F.lit(9)), f"{d}/ck")
    assert sorted((r.source_file, r.v) for r in spark.read.parquet(f"{d}/ck").collect()) == [("a", 1), ("b", 9)]
    shaped = schemas.shaped(t, schemas.table("subject_id:s v:d ok:b"), {"subject_id": "source_file"})
    assert [tuple(r) for r in shaped.orderBy("v").collect()] == [("a", 1.0, False), ("b", 2.0, False)]
