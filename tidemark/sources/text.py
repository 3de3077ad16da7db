"""Text sources: header + one value per line signals, raw and typed CSV tables, dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import clock
from tidemark.operators.scan import ordered_scan, position


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and order: ``path, split, pos, value``.  ``split`` is the byte offset of the
    file split a line was read from and ``pos`` grows along it, so a large file is read in parallel."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
                      F.monotonically_increasing_id().alias("pos"), "value")


def signal_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, headers`` from the '# key = value' lines; any key is kept, the last line of a repeated one wins."""
    pat = r"^#\s*([^=]+?)\s*=\s?(.*)$"
    kv = lines(spark, path).where(F.col("value").startswith("#")).select(
        "path", F.struct("split", "pos").alias("at"), F.regexp_extract("value", pat, 1).alias("k"), F.trim(F.regexp_extract("value", pat, 2)).alias("v")).where("k <> ''")
    one = kv.groupBy("path", "k").agg(F.max_by("v", "at").alias("v"))
    return one.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("headers"))


def signal_samples(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, x`` with n from 0 in file order; NaN samples become NULL.  Files without a valid sampling
    rate are listed by ``invalid_headers``."""
    body = lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    s = ordered_scan(body, ["path"], ["split", "pos"], [position("_n")], slice_by=F.col("split"))
    return s.select("path", (F.col("_n") - 1).alias("n"), F.nanvl(F.trim("value").try_cast("double"), F.lit(None).cast("double")).alias("x"))


def invalid_headers(headers: DataFrame) -> DataFrame:
    fs = F.element_at("headers", "fs").try_cast("double")
    return headers.where(fs.isNull() | (fs <= 0)).select("path", F.lit("missing or invalid fs").alias("reason"))


def signal_meta(headers: DataFrame) -> DataFrame:
    """Typed fields; the start comes from unix seconds, else from the ISO text."""
    get = lambda k: F.element_at("headers", k)
    unix = F.timestamp_micros((get("session_start_unix").try_cast("double") * 1e6).cast("bigint"))
    return headers.select("path", "headers", get("subject_id").alias("subject_id"), get("region").alias("region"), get("fs").try_cast("double").alias("fs"),
                          get("source_file").alias("source_file"), F.coalesce(unix, F.try_to_timestamp(get("session_start_datetime"))).alias("session_start"))


def typed_csv(spark: SparkSession, path: str, schema: T.StructType, tz: str, optional: Mapping[str, object] | None = None,
              extra: Mapping[str, T.StructType] | None = None, fmt: str = clock.TABLE_FORMAT) -> DataFrame:
    """CSV under a fixed schema.  Columns are located by name; a missing required column is an error, a
    missing optional one gets its default, and the columns of an ``extra`` group are read when its marker
    column is present.  Timestamps are local wall-clock text."""
    text = spark.read.option("header", True).csv(path)              # every column as text
    have = {c.strip().lower(): c for c in reversed(text.columns)}   # first match wins
    fields = list(schema.fields)
    for marker, more in (extra or {}).items():
        if marker.lower() in have:
            fields += more.fields
    optional = optional or {}
    gone = [f.name for f in fields if f.name.lower() not in have and f.name not in optional]
    if gone:
        raise ValueError(f"{path}: missing columns {', '.join(gone)}")
    cols = []
    for f in fields:
        if f.name.lower() not in have:
            cols.append(F.lit(optional[f.name]).cast(f.dataType).alias(f.name))
            continue
        raw = F.col(f"`{have[f.name.lower()]}`")
        if isinstance(f.dataType, T.TimestampType):
            cols.append(clock.parse_local(raw, tz, fmt).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(F.coalesce(F.trim(raw), F.lit("")).alias(f.name))
        else:
            cols.append(F.nullif(F.trim(raw), F.lit("NaN")).try_cast(f.dataType).alias(f.name))
    return text.select(*cols)


def raw_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Cells as text ``c0..cn`` with the header as a row: duplicate or blank names survive, short rows are
    padded, empty rows dropped."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).csv(path)
    cells = [F.coalesce(F.col(c), F.lit("")) for c in df.columns]
    return df.select(*[c.alias(n) for c, n in zip(cells, df.columns)]).where(F.concat(*cells) != "")


def dimension(spark: SparkSession, path: str, required: Sequence[str], optional: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """Small text table: trimmed STRING columns only (ids such as 097 stay text), rows without key dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in required])
    df = typed_csv(spark, path, T.StructType(schema.fields + [T.StructField(c, T.StringType()) for c in optional]), "UTC", {c: "" for c in optional})
    return df.where(F.col(key) != "") if key else df


def ground_truth(spark: SparkSession, path: str, tz: str) -> DataFrame:
    """Ground-truth events with ids in file order; an empty region stands for any channel."""
    x = lines(spark, path).where(F.trim("value") != "")
    cells = F.from_csv(F.col("value"), F.lit("subject_id STRING, region STRING, start_abs STRING, end_abs STRING, notes STRING"))
    rows = ordered_scan(x, ["path"], ["split", "pos"], [position("_n")], slice_by=F.col("split")).where("_n > 1")
    out = rows.select((F.col("_n") - 1).alias("gt_id"), cells.alias("r")).select("gt_id", "r.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")).alias(c)
    return out.select("gt_id", blank("subject_id"), blank("region"), clock.parse_local(F.col("start_abs"), tz).alias("start_abs"),
                      clock.parse_local(F.col("end_abs"), tz).alias("end_abs"), blank("notes"))


def review_tables(off: DataFrame, spans: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Reviewed disconnections with open limits filled from the recording span; rows that have no id prefix
    or no recording are violations."""
    keyed = off.where(F.col("id").startswith(prefix))
    x = keyed.join(spans.select("mouse", "edf", F.col("start").alias("_a"), F.col("stop").alias("_b")), ["mouse", "edf"], "left")
    done = x.withColumns({"lo": F.coalesce("lo", "_a"), "hi": F.coalesce("hi", "_b")})
    bad = off.where(~F.col("id").startswith(prefix)).select("id").unionByName(done.where("_a IS NULL").select("id"))
    return done.where("_a IS NOT NULL").drop("_a", "_b"), bad
