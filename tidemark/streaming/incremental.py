"""Structured Streaming on top of the same semantics: ingest, sessions, gaps, counts, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str,
           transform: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_trigger: int = 64):
    """Process only files that are new, once each: file source, checkpoint, and a sink partitioned by ``key``
    and batch - a repeated batch replaces its own partitions with the same rows and no others."""
    def write(batch: DataFrame, number: int) -> None:
        (transform(batch).withColumn("_batch", F.lit(number)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(key, "_batch").parquet(target))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def sessions(stream: DataFrame, keys: Sequence[str], ts: str, gap: str, late: str, amplitude: str) -> DataFrame:
    """Points at most ``gap`` apart form one group; its end is the window end minus the gap."""
    w = F.session_window(F.col(ts), gap)
    g = stream.withWatermark(ts, late).groupBy(*keys, w.alias("_w")).agg(
        F.count(F.lit(1)).alias("n_spikes"), F.max(amplitude).alias("max_amplitude"), F.max(ts).alias("end"))
    return g.select(*keys, F.col("_w.start").alias("start"), "end", "n_spikes", "max_amplitude")


def gap_events(stream: DataFrame, key: str, key_type: str, onset: str, duration: str, tol: float, min_gap: float) -> DataFrame:
    """Online gap detector: the state of a recording is the onset it expects next.  Records must arrive in
    order per recording from batch to batch; within one they are sorted."""
    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected = state.get[0] if state.exists else None
        rows = []
        whole = pd.concat([pdf[[onset, duration]] for pdf in batches]).sort_values(onset)
        for t, d in whole.itertuples(index=False):
            if expected is not None and abs(t - expected) > tol:
                kind = "gap" if t - expected >= min_gap else "anomaly" if t - expected <= -min_gap else "jitter"
                rows.append((k[0], expected, t, t - expected, kind))
            expected = t + d
        state.update((float(expected),))
        yield pd.DataFrame(rows, columns=["key", "start_s", "end_s", "deviation_s", "kind"])

    return stream.groupBy(key).applyInPandasWithState(
        step, f"key {key_type}, start_s double, end_s double, deviation_s double, kind string", "expected double", "append", GroupStateTimeout.NoTimeout)


def gap_batches(stream: DataFrame, key: str, onset: str, duration: str, tol: float, min_gap: float, target: str, checkpoint: str):
    """Online gap detector for recordings of any size: gaps of each micro-batch go to ``target/gaps``, the onset that each recording of the batch
    expects next to ``target/state``.

    Inside a batch records meet their predecessors by the sliced ``lag`` of the library, so a recording that fills a batch spreads over the cluster; only the first
    record of a recording looks up the state, its newest one from earlier batches.  A repeated batch reads the same state and replaces its own
    rows.  Records must arrive in order per recording from batch to batch.
    """
    from tidemark.operators.scan import lag, ordered_scan
    spark, kind = stream.sparkSession, dict(stream.dtypes)[key]
    gaps, state = f"{target}/gaps", f"{target}/state"
    shape = f"key {kind}, expected double, _batch long"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(key).alias("key"), F.col(onset).cast("double").alias("t"), F.col(duration).cast("double").alias("d"))
        known = spark.read.schema(shape).parquet(state) if _exists(spark, state) else spark.createDataFrame([], shape)
        latest = known.where(F.col("_batch") < number).groupBy("key").agg(F.max_by("expected", "_batch").alias("_state"))
        walked = ordered_scan(rows, ["key"], ["t"], [lag("_before", F.col("t") + F.col("d"))])
        first = walked.where("_before IS NULL").join(latest, "key", "left").withColumn("_before", F.col("_state")).drop("_state")
        met = walked.where("_before IS NOT NULL").unionByName(first).where("_before IS NOT NULL")
        dev = F.col("t") - F.col("_before")
        name = F.when(dev >= min_gap, "gap").when(dev <= -min_gap, "anomaly").otherwise("jitter")
        found = met.where(F.abs(dev) > tol).select("key", F.col("_before").alias("start_s"), F.col("t").alias("end_s"), dev.alias("deviation_s"), name.alias("kind"))
        after = rows.groupBy("key").agg(F.max_by(F.col("t") + F.col("d"), "t").alias("expected"))
        for df, path in ((found, gaps), (after, state)):
            df.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def observed_counts(points: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str, late: str, longest: str, width: str = "1 hour") -> DataFrame:
    """Points inside recorded spans (``start, end``) per window: an interval join of two streams.

    Both sides carry a watermark and a span is at most ``longest``, so the state of either side is dropped once no partner can come.
    Spans of one key must not overlap, or a point counts once for each.
    """
    p = points.withWatermark(ts, late).select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(ts).alias("_ts"))
    s = spans.withWatermark("start", late)
    same = [F.col(f"_p_{k}") == F.col(k) for k in keys]
    inside = F.expr(f"_ts >= start AND _ts < end AND start >= _ts - INTERVAL {longest}")
    met = p.join(s, on=[*same, inside])
    g = met.groupBy(*keys, F.window("_ts", width).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("_w.start").alias("start"), "n")


def observed_time(spans: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """Recorded seconds per hour: each span is cut at the hours it touches, and only there."""
    hours = F.sequence(F.date_trunc("hour", "start"), F.date_trunc("hour", "end"), F.expr("INTERVAL 1 HOUR"))
    cut = spans.select(*keys, "start", "end", F.explode(hours).alias("hour")).withWatermark("hour", late)
    seconds = lambda c: F.unix_micros(c) / F.lit(1e6)
    length = seconds(F.least("end", F.expr("hour + INTERVAL 1 HOUR"))) - seconds(F.greatest("start", "hour"))
    g = cut.groupBy(*keys, F.window("hour", "1 hour").alias("_w")).agg(F.sum(length).alias("seconds"))
    return g.select(*keys, F.col("_w.start").alias("start"), "seconds").where("seconds > 0")


def hourly_rates(counts: DataFrame, time: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts and recorded time of the two sinks side by side, with the rate per hour (hours without points count zero)."""
    out = time.join(counts, [*keys, "start"], "left").na.fill(0, ["n"])
    return out.withColumn("per_hour", F.try_divide("n", F.col("seconds") / 3600))


def windowed_counts(stream: DataFrame, keys: Sequence[str], ts: str, width: str, late: str, value: str, slide: str | None = None) -> DataFrame:
    """Counts and mean per tumbling or sliding window."""
    w = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    g = stream.withWatermark(ts, late).groupBy(*keys, w.alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return g.select(*keys, F.col("_w.start").alias("start"), "n", "mean")


def without_repeats(stream: DataFrame, keys: Sequence[str], ts: str, late: str) -> DataFrame:
    """Rows of repeated files arrive once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Run a streaming query over what is available into a memory table."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
