"""Registered queries: a Spark callable, the equivalent SQL and the operators it shows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    covers: tuple[str, ...]


ENTRIES: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None):
    """Register ``fn(tables)`` under its own name; ``tables`` reads one input table per attribute."""
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        ENTRIES[fn.__name__] = Entry(fn.__name__, run, sql, tuple(covers.split()))
        return fn
    return wrap


class Tables:
    """Input tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    @cached_property
    def points(self) -> DataFrame:
        """Events as points: ``t`` and ``hi`` in microseconds, ``hi`` = t + value minutes."""
        t = F.unix_micros(F.col("ts").cast("timestamp"))
        span = F.round(F.col("value") * 100).cast("bigint") * 600000
        return self.events.select("event_id", "user_id", "event_type", "value", t.alias("t"),
                                  (t + span).alias("hi"), "ts", "props")

    def spans(self, *kinds: str) -> DataFrame:
        """Intervals ``user_id, lo, hi`` of the named event types."""
        p = self.points.where(F.col("event_type").isin(*kinds))
        return p.select("event_id", "user_id", F.col("t").alias("lo"), "hi")


# Shared SQL prefix matching Tables.points.
POINTS = """ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t,
 epoch_us(ts) + CAST(round(value * 100) AS BIGINT) * 600000 AS hi, ts, props FROM events)"""


def merged(name: str, where: str = "true", keys: str = "user_id", source: str = "ev", lo: str = "t",
           hi: str = "hi", gap: str = "0", op: str = ">", aggs: str = "", positive: bool = True) -> str:
    """SQL: islands of the intervals of ``source`` selected by ``where`` (lo, hi and extra aggregates)."""
    aggs = f", {aggs}" if aggs else ""
    keep = f"{hi} > {lo} AND " if positive else ""
    return f"""{name}_0 AS (SELECT *, max({hi}) OVER (PARTITION BY {keys} ORDER BY {lo}, {hi}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach_ FROM {source} WHERE {keep}({where})),
{name}_1 AS (SELECT *, sum(CASE WHEN reach_ IS NULL OR {lo} {op} reach_ + {gap} THEN 1 ELSE 0 END)
  OVER (PARTITION BY {keys} ORDER BY {lo}, {hi} ROWS UNBOUNDED PRECEDING) AS g_ FROM {name}_0),
{name} AS (SELECT {keys}, min({lo}) AS lo, max({hi}) AS hi{aggs} FROM {name}_1 GROUP BY {keys}, g_)"""
