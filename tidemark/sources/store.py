"""Sinks, manifests and incremental work: what to skip, what to redo, how to write it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import clock


def write_chunks(chunks: DataFrame, path: str, by: Sequence[str] = ("subject_id", "source_file")) -> None:
    """Signal chunks by recording, sorted by ``n0`` so that a time window prunes row groups."""
    (chunks.repartition(*by, "chunk_ix").sortWithinPartitions(*by, "n0").write.mode("overwrite")
           .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def write_checkpoint(df: DataFrame, path: str, key: str = "source_file") -> None:
    """Result rows of the files in ``df`` replace only those files' partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_tables(tables: Mapping[str, DataFrame], folder: str, tz: str, fmt: str = "parquet") -> None:
    """One directory per table; CSV gets local datetimes in the table format and no nested columns."""
    for name, df in tables.items():
        if fmt == "parquet":
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            continue
        cols = [clock.local_text(F.col(c), tz, clock.TABLE_FORMAT).alias(c) if k.startswith("timestamp") else F.col(c) for c, k in df.dtypes]
        df.select(*cols).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def export_by(df: DataFrame, path: str, key: str) -> None:
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def file_manifest(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Path, size, modification time of every file below a folder (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def snapshot(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """Manifest with the SHA-1 of the contents: the identity of label files at a run."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), F.sha1("content").alias("sha1"))


def import_key(df: DataFrame, *params) -> DataFrame:
    """Add ``import_key``: hash of size, modification time and import parameters."""
    parts = [F.col("bytes").cast("string"), F.unix_micros("mtime").cast("string"), *[F.lit(str(p)) for p in params]]
    return df.withColumn("import_key", F.sha2(F.concat_ws("|", *parts), 256))


def pending_imports(now: DataFrame, done: DataFrame) -> DataFrame:
    """Files whose import key has no stored result."""
    return now.join(done.select("path", "import_key"), ["path", "import_key"], "left_anti")


def resume_status(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """new / skipped / reprocessed: a stored clean result is kept iff case, gain source, notch and gain
    (to 1e-9 relative) agree."""
    s = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("case", "gain_source", "gain", "notch")])
    out = wanted.join(s, list(keys), "left")
    near = F.abs(F.col("gain") - F.col("_gain")) <= 1e-9 * F.greatest(F.abs("gain"), F.abs("_gain"))
    both_null = F.col("gain").isNull() & F.col("_gain").isNull()
    same = (F.col("case") == F.col("_case")) & (F.col("gain_source") == F.col("_gain_source")) & F.col("notch").eqNullSafe(F.col("_notch")) & (near | both_null)
    status = F.when(F.col("_case").isNull(), "new").when(F.coalesce(same, F.lit(False)), "skipped").otherwise("reprocessed")
    return out.select(*wanted.columns, status.alias("status"))


def discover(found: DataFrame, listed: DataFrame | None, key: str) -> tuple[DataFrame, DataFrame]:
    """Inputs to process and listed ones that do not exist; without a list everything found is taken."""
    found = found.dropDuplicates([key])
    if listed is None:
        return found, found.limit(0).select(key)
    listed = listed.select(key).distinct()
    return found.join(listed, key, "left_semi"), listed.join(found, key, "left_anti")


def time_segments(samples: DataFrame, fs, length_s: float) -> DataFrame:
    """Fixed-length segment number of every sample or chunk start (``n``)."""
    return samples.withColumn("segment", F.floor(F.col("n") / (F.lit(length_s) * fs)).cast("long"))


def cut_records(records: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Whole records into slices [.., c1) [c1, c2) [c2, ..) by onset."""
    piece = F.lit(0)
    for c in sorted(cuts):
        piece = piece + (F.col("onset_s") >= c).cast("int")
    return records.withColumn("slice", piece)


def slice_accounting(before: DataFrame, after: DataFrame, key: Sequence[str], n: str) -> DataFrame:
    """Keys whose sample count changed by slicing (empty when every sample is accounted for)."""
    a = before.groupBy(*key).agg(F.sum(n).alias("n_before"))
    b = after.groupBy(*key).agg(F.sum(n).alias("n_after"))
    return a.join(b, list(key), "full").where(~F.col("n_before").eqNullSafe(F.col("n_after")))
