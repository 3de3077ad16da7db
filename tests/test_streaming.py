import tempfile

from pyspark.sql import functions as F

from tidemark.streaming import incremental as inc


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_ingest_is_exactly_once(spark):
    src, dst, ck = folder(), folder() + "/out", folder()
    df = spark.createDataFrame([("a", 1), ("a", 2)], "source_file string, v int")
    df.write.mode("append").parquet(src)
    inc.ingest(spark, src, df.schema, dst, ck, "source_file").awaitTermination()
    spark.createDataFrame([("b", 3)], df.schema).write.mode("append").parquet(src)
    for _ in range(2):
        inc.ingest(spark, src, df.schema, dst, ck, "source_file").awaitTermination()
    assert sorted((r.source_file, r.v) for r in spark.read.parquet(dst).collect()) == [("a", 1), ("a", 2), ("b", 3)]
    spark.createDataFrame([("a", 4)], df.schema).write.mode("append").parquet(src)  # a known key in a later batch
    inc.ingest(spark, src, df.schema, dst, ck, "source_file").awaitTermination()
    assert sorted((r.source_file, r.v) for r in spark.read.parquet(dst).collect()) == [("a", 1), ("a", 2), ("a", 4), ("b", 3)]


def test_sessions_match_batch_complexes(spark):
    from tidemark.operators.events import complexes
    src, ck = folder(), folder()
    rows = [("s", 0, 1.0), ("s", 150, 2.0), ("s", 301, 3.0), ("s", 5000, 1.0), ("s", 900000, 1.0)]
    df = spark.createDataFrame(rows, "k string, ms long, a double").withColumn("ts", F.timestamp_millis("ms"))
    df.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    inc.drain(inc.sessions(stream, ["k"], "ts", "150 milliseconds", "1 second", "a"), "sess", ck).awaitTermination()
    got = sorted((r.start, r.n_spikes, r.max_amplitude) for r in spark.table("sess").collect())
    want = complexes(df.where("ms < 900000"), ["k"], "ms", "a", 150).orderBy("start").collect()
    assert [(g[1], g[2]) for g in got] == [(w.n_spikes, w.max_amplitude) for w in want] == [(2, 2.0), (1, 3.0), (1, 1.0)]


def test_gap_detector_keeps_state_between_files(spark):
    src, ck = folder(), folder()
    schema = "f string, onset double, d double"
    spark.createDataFrame([("x", 0.0, 1.0), ("x", 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    out = folder() + "/o"
    def start():
        q = inc.gap_events(spark.readStream.schema(schema).parquet(src), "f", "string", "onset", "d", 1e-3, 0.5)
        q.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    start()
    spark.createDataFrame([("x", 2.5, 1.0), ("x", 3.6, 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    start()
    got = sorted((r.start_s, r.kind) for r in spark.read.parquet(out).collect())
    assert got == [(2.0, "gap"), (3.5, "jitter")]


def test_windows_and_repeats(spark):
    src, ck, ck2 = folder(), folder(), folder()
    df = spark.createDataFrame([("k", 86400 + i * 600, float(i), i % 3) for i in range(12)] * 2, "k string, s long, v double, e int").withColumn("ts", F.timestamp_seconds("s"))
    df.coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)
    inc.drain(inc.without_repeats(stream(), ["k", "s"], "ts", "3 hours"), "uniq", ck).awaitTermination()
    assert spark.table("uniq").count() == 12
    inc.drain(inc.windowed_counts(stream(), ["k"], "ts", "1 hour", "0 seconds", "v"), "hourly", ck2, "complete").awaitTermination()
    assert sorted(r.n for r in spark.table("hourly").collect()) == [12, 12]


def test_gap_batches_keep_state_slice_hot_recordings_and_repeat_safely(spark, monkeypatch):
    import tidemark.operators.slicing as sl
    monkeypatch.setattr(sl, "TARGET_ROWS", 20)
    src, ck, out = folder(), folder(), folder() + "/o"
    schema = "f string, onset double, d double"
    hot = [("x", float(i) + (2.5 if i >= 70 else 0) + (0.1 if i == 30 else 0), 1.0) for i in range(100)]
    spark.createDataFrame(hot + [("y", 0.0, 1.0)], schema).repartition(3).write.mode("append").parquet(src)
    run = lambda c: inc.gap_batches(spark.readStream.schema(schema).parquet(src), "f", "onset", "d", 1e-3, 0.5, out, c).awaitTermination()
    run(ck)
    spark.createDataFrame([("x", 110.0, 1.0), ("x", 111.0, 1.0), ("y", 0.2, 1.0), ("z", 5.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    run(ck)
    got = lambda: sorted((r.key, round(r.start_s, 3), round(r.end_s, 3), r.kind) for r in spark.read.parquet(out + "/gaps").collect())
    want = [("x", 30.0, 30.1, "jitter"), ("x", 31.1, 31.0, "jitter"), ("x", 70.0, 72.5, "gap"), ("x", 102.5, 110.0, "gap"), ("y", 1.0, 0.2, "anomaly")]
    assert got() == want
    run(folder())  # all files again as batch 0: that batch is replaced, the later one stays
    assert ("x", 70.0, 72.5, "gap") in got() and sum(g[2] == 72.5 for g in got()) == 1


def test_points_inside_spans_per_hour_by_a_stream_join(spark):
    a, b, ck = folder(), folder(), [folder() for _ in range(2)]
    t = lambda s: F.timestamp_seconds(F.col(s) + 864_000)
    spans = spark.createDataFrame([("k", 1800, 5400), ("k", 7000, 7300), ("j", 0, 60), ("k", 900_000, 900_001)], "k string, s long, e long").select("k", t("s").alias("start"), t("e").alias("end"))
    pts = spark.createDataFrame([("k", s) for s in (0, 1800, 3599, 3600, 5399, 5400, 7100, 7299, 7300)] + [("j", 30), ("j", 90), ("k", 900_000)], "k string, s long").select("k", t("s").alias("ts"))
    spans.coalesce(1).write.mode("append").parquet(a)
    pts.coalesce(1).write.mode("append").parquet(b)
    counts = inc.observed_counts(spark.readStream.schema(pts.schema).parquet(b), spark.readStream.schema(spans.schema).parquet(a), ["k"], "ts", "10 minutes", "2 hours")
    inc.drain(counts, "obs_n", ck[0]).awaitTermination()
    inc.drain(inc.observed_time(spark.readStream.schema(spans.schema).parquet(a), ["k"], "10 minutes"), "obs_s", ck[1]).awaitTermination()
    out = {(r.k, int(r.start.timestamp())): (r.n, r.seconds, r.per_hour) for r in inc.hourly_rates(spark.table("obs_n"), spark.table("obs_s"), ["k"]).collect()}
    base = min(s for k, s in out if k == "k")
    got = {(k, s - base): (n, sec, round(rate, 6)) for (k, s), (n, sec, rate) in out.items() if s - base < 80_000}
    assert got == {("k", 0): (2, 1800.0, 4.0), ("k", 3600): (3, 2000.0, 5.4), ("k", 7200): (1, 100.0, 36.0), ("j", 0): (1, 60.0, 60.0)}
