"""Before / after a treatment: windows, delays, events at the window edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv


def treatment_windows(subjects: DataFrame, before, after) -> DataFrame:
    """``w0, w1`` from ``before`` the injection to ``after`` it or the end of the evidence."""
    return subjects.withColumns({"w0": F.col("inj") - F.lit(before),
                                 "w1": F.least(F.col("inj") + F.lit(after), F.col("rec_end"))})


def events_in_window(windows: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events that meet each subject's window, those crossing an edge and those starting inside."""
    x = events.join(windows.select(*keys, "w0", "w1"), list(keys)).where((F.col("lo") < F.col("w1")) & (F.col("hi") > F.col("w0")))
    n = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_in_window"),
        F.count_if((F.col("lo") < F.col("w0")) | (F.col("hi") > F.col("w1"))).alias("n_straddling"),
        F.count_if((F.col("lo") >= F.col("w0")) & (F.col("lo") < F.col("w1"))).alias("n_started"))
    return (windows.select(*keys, "w0", "w1").join(n, list(keys), "left")
                   .na.fill(0, ["n_in_window", "n_straddling", "n_started"]))


def window_sets(sets: dict[str, DataFrame], windows: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Every interval set restricted to the window; an unbounded window gives the sets back."""
    w = windows.select(*keys, F.col("w0").alias("lo"), F.col("w1").alias("hi"))
    return {name: iv.intersect(df, w, keys) for name, df in sets.items()}


def delay_cohort(delays: DataFrame, keys: Sequence[str], delay: str, tie: str, low: float, high: float,
                 inside: str = "SAN", outside: str = "IAN") -> DataFrame:
    """Cohort by whether any delay lies in [low, high], and the delay closest to zero."""
    near = F.col(delay).between(low, high)
    return delays.groupBy(*keys).agg(
        F.when(F.bool_or(near), inside).otherwise(outside).alias("cohort"),
        F.min_by(delay, F.struct(F.abs(delay), tie)).alias(f"closest_{delay}"))
