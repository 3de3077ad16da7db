"""Session defaults and the helpers that keep intermediate results."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects (UTC clock, AQE, skew join)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",   # rows are array chunks
        "spark.python.sql.dataFrameDebugging.enabled": "false",  # no call-site capture per column
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_WORK = re.compile(r"^[\s:+|-]*(Join|Aggregate|Window|Sort|Repartition\w*|MapIn\w+|FlatMap\w+|ArrowEvalPython|Intersect|Except)\b", re.M)


def settle(df: DataFrame) -> DataFrame:
    """Input an operator is going to read more than once: results of joins, aggregates, windows or Python
    are written once (see ``durable``), so that nested operators do not multiply their inputs' work; a
    plain scan with filters and projections is left to be read again with its columns pruned."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return durable(df) if _WORK.search(plan) else df


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Files of a checkpoint stay until the session ends, or are removed with their DataFrame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that checkpoints go to shared storage; only a local session may fall back to a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(folder)
