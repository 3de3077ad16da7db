"""Recording catalogue and prior results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalogue(channels: DataFrame, keys: Sequence[str], region: str, regions: Sequence[str], start: str, end: str, value: str) -> DataFrame:
    """One row per recording: span, channel count, one ``value`` column per region, all regions present."""
    wide = [F.max(F.when(F.col(region) == r, F.col(value))).alias(r) for r in regions]
    has = [F.bool_or(F.col(region) == r) for r in regions]
    both = has[0]
    for h in has[1:]:
        both = both & h
    return channels.groupBy(*keys).agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count_distinct(region).alias("n_regions"),
                                       F.count_distinct(start).alias("n_starts"), both.alias("analysed"), *wide)
