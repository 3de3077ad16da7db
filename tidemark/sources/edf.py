"""EDF / EDF+ ingest: headers by column expressions, records by an Arrow job, placement by ordered scans.

``binaryFile`` hands one file to one task (at most 2 GB by format); decoding streams record rows out of
it, and everything after the decode is distributed by (file, channel).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import channel_key, unit_scale
from tidemark.operators import signal as sg

RECORD = T.StructType([
    T.StructField("source_file", T.StringType()), T.StructField("channel_label", T.StringType()),
    T.StructField("record_ix", T.IntegerType()), T.StructField("onset_s", T.DoubleType()),
    T.StructField("fs", T.DoubleType()), T.StructField("record_s", T.DoubleType()), T.StructField("unit", T.StringType()),
    T.StructField("phys_min", T.DoubleType()), T.StructField("phys_max", T.DoubleType()),
    T.StructField("dig_min", T.DoubleType()), T.StructField("dig_max", T.DoubleType()),
    T.StructField("samples", T.ArrayType(T.ShortType())), T.StructField("tal", T.BinaryType())])


def files(spark: SparkSession, path: str, pattern: str = "*.[eE][dD][fF]") -> DataFrame:
    """Files below a folder, or one file; a file without the EDF extension is an error."""
    name = path.rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith(".edf"):
        raise ValueError(f"expected an .edf file, got {name}")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if "." not in name:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path)


def header_span(binary: DataFrame, tz: str) -> DataFrame:
    """Start and end of each recording from the fixed header alone; two-digit years from 85 are 19xx."""
    h = F.decode(F.substring("content", 1, 256), "ISO-8859-1")
    field = lambda a, n: F.trim(F.substring(h, a, n))
    day, clock = field(169, 8), field(177, 8)
    yy = F.substring(day, 7, 2).cast("int")
    start = F.to_utc_timestamp(F.make_timestamp(F.when(yy >= 85, 1900 + yy).otherwise(2000 + yy), F.substring(day, 4, 2).cast("int"), F.substring(day, 1, 2).cast("int"),
                                                F.substring(clock, 1, 2).cast("int"), F.substring(clock, 4, 2).cast("int"), F.substring(clock, 7, 2).cast("double")), tz)
    seconds = field(237, 8).cast("double") * field(245, 8).cast("double")
    return binary.select("path", field(193, 44).alias("source_format"), start.alias("start"),
                         F.timestamp_micros(F.unix_micros(start) + (seconds * 1e6).cast("bigint")).alias("end"))


def _decode(name: str, raw: bytes):
    text = lambda a, n: raw[a:a + n].decode("latin-1").strip()
    ns, nrec, dur, base = int(text(252, 4)), int(text(236, 8)), float(text(244, 8)), int(text(184, 8))
    widths = (16, 80, 8, 8, 8, 8, 8, 80, 8, 32)
    at = [256 + ns * sum(widths[:i]) for i in range(len(widths))]
    field = lambda f, s: text(at[f] + s * widths[f], widths[f])
    count = [int(field(8, s)) for s in range(ns)]
    label = [field(0, s) for s in range(ns)]
    size = 2 * sum(count)
    for r in range(nrec):
        block = raw[base + r * size:base + (r + 1) * size]
        if len(block) < size:
            return
        parts, pos, onset, tals = [], 0, r * dur, []
        for s in range(ns):
            piece = block[pos:pos + 2 * count[s]]
            pos += 2 * count[s]
            if label[s] == "EDF Annotations":
                tals.append(piece)
            else:
                parts.append((s, np.frombuffer(piece, "<i2")))
        if tals:
            first = tals[0].split(b"\x14", 1)[0].split(b"\x15", 1)[0].strip(b"\x00")
            onset = float(first) if first else onset
        for s, x in parts:
            yield (name, label[s], r, onset, count[s] / dur if dur else None, dur, field(2, s), float(field(3, s)), float(field(4, s)),
                   float(field(5, s)), float(field(6, s)), x, None)
        if tals:
            yield (name, "EDF Annotations", r, onset, None, dur, None, None, None, None, None, None, b"".join(tals))


def records(binary: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per record and channel (annotations as raw TAL bytes); only ``labels`` leave the task."""
    wanted = None if labels is None else {*labels, "EDF Annotations"}

    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                rows = []
                for row in _decode(path.rsplit("/", 1)[-1], raw):
                    if wanted is None or row[1] in wanted:
                        rows.append(row)
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=RECORD.names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=RECORD.names)

    return binary.select("path", "content").mapInPandas(run, RECORD)


def select_channels(have: DataFrame, wanted: DataFrame) -> DataFrame:
    """Match requested labels exactly, else ignoring case, an 'EEG ' prefix and spaces.
    ``wanted`` = source_file, label, region; adds ``match`` (exact, loose, missing, ambiguous)."""
    h = have.select("source_file", "channel_label").distinct()
    exact = wanted.join(h.withColumn("label", F.col("channel_label")), ["source_file", "label"], "left")
    loose = h.select("source_file", channel_key(F.col("channel_label")).alias("_k"), F.col("channel_label").alias("_loose"))
    loose = loose.groupBy("source_file", "_k").agg(F.min("_loose").alias("_loose"), F.count(F.lit(1)).alias("_n"))
    out = exact.withColumn("_k", channel_key(F.col("label"))).join(loose, ["source_file", "_k"], "left")
    match = (F.when(F.col("channel_label").isNotNull(), "exact").when(F.col("_n") == 1, "loose").when(F.col("_n") > 1, "ambiguous").otherwise("missing"))
    return out.select("source_file", "label", "region", F.coalesce("channel_label", F.when(F.col("_n") == 1, F.col("_loose"))).alias("channel_label"), match.alias("match"))


def physical(samples="samples"):
    """Digital -> physical: pmin + (x - dmin) * (pmax - pmin) / (dmax - dmin)."""
    k = (F.col("phys_max") - F.col("phys_min")) / (F.col("dig_max") - F.col("dig_min"))
    return F.transform(samples, lambda x: F.col("phys_min") + (x - F.col("dig_min")) * k)


def placed(rec: DataFrame, tol: float = 1e-3, min_gap: float = 0.5) -> DataFrame:
    """Records with gap kind, block and first sample index, in microvolts where the unit is known."""
    key = ["source_file", "channel_label"]
    data = rec.where("samples IS NOT NULL")
    first = data.groupBy(*key).agg(F.min_by("onset_s", "record_ix").alias("_t0"))
    data = data.join(first, key).withColumn("onset_s", F.col("onset_s") - F.col("_t0")).drop("_t0", "tal")
    x = sg.record_gaps(data, key, "record_s", tol, min_gap)
    x = sg.place_records(x, key, F.col("fs"), F.size("samples"))
    scale, known = unit_scale(F.col("unit"))
    return x.withColumn("samples", F.transform(physical(), lambda v: v * scale)).withColumn("unit_recognised", known)


def manifest(p: DataFrame) -> DataFrame:
    """Channel manifest with the exact duration identity valid + gaps = total; physical limits in microvolts."""
    scale = unit_scale(F.col("unit"))[0]
    key = ["source_file", "channel_label"]
    jump = F.when(F.col("kind") == "gap", F.round(F.col("deviation_s") * F.col("fs"))).otherwise(0).cast("long")
    g = p.groupBy(*key).agg(F.first("fs").alias("fs"), F.sum(F.size("samples")).alias("n_valid_samples"), F.sum(jump).alias("_gap"),
                            F.count_if(F.col("kind") == "gap").alias("n_gaps"), F.count_if(F.col("kind") == "jitter").alias("n_jitter"),
                            F.count_if(F.col("kind") == "anomaly").alias("n_anomaly"), F.first("unit").alias("units"), F.bool_and("unit_recognised").alias("unit_recognised"),
                            F.first(F.col("phys_min") * scale).alias("phys_min"), F.first(F.col("phys_max") * scale).alias("phys_max"))
    n = F.col("n_valid_samples") + F.col("_gap")
    return g.withColumns({"n_samples": n, "total_duration_s": n / F.col("fs"), "valid_duration_s": F.col("n_valid_samples") / F.col("fs")}).drop("_gap")


def gap_table(p: DataFrame) -> DataFrame:
    """Gaps of each file (same for all its channels): start, end, duration, neighbouring records."""
    g = p.where("kind = 'gap'").groupBy("source_file", "record_ix").agg(F.first("onset_s").alias("_o"), F.first("record_s").alias("_d"), F.first("deviation_s").alias("duration_s"))
    start = F.col("_o") + F.col("_d")
    return g.select("source_file", start.alias("start_s"), (start + F.col("duration_s")).alias("end_s"), "duration_s",
                    F.col("record_ix").alias("prev_record_ix"), (F.col("record_ix") + 1).alias("next_record_ix"))


def chunks(p: DataFrame, records_per_chunk: int = 16) -> DataFrame:
    """Whole records packed into contiguous chunks of a block (bounded groups)."""
    key = ["source_file", "channel_label", "block_id"]
    from tidemark.operators.scan import ordered_scan, position
    x = ordered_scan(p, key, ["record_ix"], [position("_i")]).withColumn("chunk_ix", F.floor((F.col("_i") - 1) / records_per_chunk).cast("long"))
    g = x.groupBy(*key, "chunk_ix").agg(F.array_sort(F.collect_list(F.struct("n0", "samples"))).alias("_r"), F.first("fs").alias("fs"))
    return g.select(F.concat_ws("|", "source_file", "channel_label").alias("channel_id"), *key, "chunk_ix", "fs", F.col("_r")[0]["n0"].alias("n0"),
                    F.flatten(F.transform("_r", lambda r: r["samples"])).alias("samples"))


def segments(p: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Segmenting layout: a new segment at every deviation beyond ``tol``; values in millivolts."""
    from tidemark.operators.scan import ordered_scan, running_sum
    key = ["source_file", "channel_label"]
    cut = (F.abs("deviation_s") > tol).cast("long")
    s = ordered_scan(p.withColumn("_cut", F.coalesce(cut, F.lit(0))), key, ["record_ix"], [running_sum("segment", "_cut", inclusive=False)])
    return s.withColumn("samples", F.transform("samples", lambda v: v / 1000)).drop("_cut")


def annotations(rec: DataFrame) -> DataFrame:
    """Annotation rows ``source_file, record_ix, onset_s, duration_s, text``: time-keeping entries are
    dropped, onsets that restarted at midnight are brought next to their record's onset."""
    tal = F.decode("tal", "UTF-8")
    t = rec.where("tal IS NOT NULL").select("source_file", "record_ix", F.col("onset_s").alias("_r"), F.explode(F.split(tal, "\u0000")).alias("_t")).where("_t <> ''")
    parts = F.split("_t", "\u0014")
    head = F.split(parts[0], "\u0015")
    text = F.array_join(F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x != ""), "|")
    onset = head[0].try_cast("double")
    x = t.select("source_file", "record_ix", "_r", onset.alias("_o"), F.get(head, 1).try_cast("double").alias("duration_s"), text.alias("text")).where("text <> ''")
    return x.select("source_file", "record_ix", (F.col("_o") + 86400 * F.round((F.col("_r") - F.col("_o")) / 86400)).alias("onset_s"), "duration_s", "text")
