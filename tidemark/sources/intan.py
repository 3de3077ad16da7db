"""Raw amplifier files: one file per channel, or one interleaved file (int16 at 0.195 microvolts)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.signal import CHUNK

MICROVOLTS = 0.195          # fixed value: amplifier step
CHANNEL_FILE = r"amp-([AB])-(\d+)\.dat$"   # fixed value: file name pattern

_OUT = T.StructType([T.StructField("path", T.StringType()), T.StructField("lane", T.IntegerType()), T.StructField("chunk_ix", T.LongType()),
                     T.StructField("n0", T.LongType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])


def _emit(path: str, lanes: np.ndarray, length: int):
    for a in range(0, lanes.shape[1], length):
        for lane in range(lanes.shape[0]):
            yield (path, lane, a // length, a, lanes[lane, a:a + length] * MICROVOLTS)


def decode(binary: DataFrame, lanes: int = 1, length: int = CHUNK) -> DataFrame:
    """int16 files with ``lanes`` interleaved channels -> chunks per file and lane, streamed in batches."""
    def run(batches):
        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                x = np.frombuffer(raw, "<i2")
                x = x[:len(x) // lanes * lanes].reshape(-1, lanes).T
                rows = []
                for row in _emit(path, x, length):
                    rows.append(row)
                    if len(rows) >= 256:
                        yield pd.DataFrame(rows, columns=_OUT.names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_OUT.names)
    return binary.select("path", "content").mapInPandas(run, _OUT)


def per_channel(spark: SparkSession, folder: str, regions: DataFrame, animals: DataFrame, length: int = CHUNK) -> DataFrame:
    """One file per channel: port and suffix from the name, region by suffix (unmapped ones skipped),
    animal by port.  ``regions`` = suffix, region; ``animals`` = port, subject_id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "amp-*.dat").load(folder)
    x = decode(files, 1, length).withColumns({"port": F.regexp_extract("path", CHANNEL_FILE, 1), "suffix": F.regexp_extract("path", CHANNEL_FILE, 2)})
    return x.join(regions, "suffix").join(animals, "port").drop("lane")


def interleaved(spark: SparkSession, path: str, lanes: Sequence[tuple[str, str]], animals: DataFrame, inverted: bool = False, length: int = CHUNK) -> DataFrame:
    """One interleaved file; ``lanes`` gives (port, region) per position.  ``inverted`` swaps ports A and B."""
    swap = {"A": "B", "B": "A"}
    table = spark.createDataFrame([(i, swap.get(p, p) if inverted else p, r) for i, (p, r) in enumerate(lanes)], "lane int, port string, region string")
    files = spark.read.format("binaryFile").load(path)
    return decode(files, len(lanes), length).join(table, "lane").join(animals, "port")


def time_axis(spark: SparkSession, path: str, fs: float) -> DataFrame:
    """First and last instant of a time file (int32 sample counter)."""
    schema = "path string, first_s double, last_s double, n long"

    def run(batches):
        for pdf in batches:
            rows = []
            for p, raw in zip(pdf["path"], pdf["content"]):
                t = np.frombuffer(raw, "<i4")
                rows.append((p, t[0] / fs, t[-1] / fs, len(t)) if len(t) else (p, None, None, 0))
            yield pd.DataFrame(rows, columns=["path", "first_s", "last_s", "n"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def crop(chunks: DataFrame, keys: Sequence[str], first: int, last: int) -> DataFrame:
    """Chunks cut to samples first..last (inclusive), still numbered from the start of the file."""
    a = F.greatest(F.lit(first) - F.col("n0"), F.lit(0))
    b = F.least(F.lit(last) - F.col("n0") + 1, F.size("samples").cast("long"))
    return chunks.where(b > a).withColumns({"samples": F.slice("samples", (a + 1).cast("int"), (b - a).cast("int")), "n0": F.col("n0") + a})
