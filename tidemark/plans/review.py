"""Review sheets: everything to look at, in time order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import review_priority
from tidemark.operators.events import numbered


def review_sheet(parts: Mapping[str, DataFrame], keys: Sequence[str], t: str, tie: str, slice_by="auto") -> DataFrame:
    """Union of event tables with their kind, numbered chronologically per key, with a blank verdict."""
    out = None
    for kind, df in parts.items():
        part = df.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return numbered(out, keys, [t, tie], "position", slice_by).withColumn("verdict", F.lit(""))


def event_review_sheet(rows: DataFrame, keys: Sequence[str], region: str) -> DataFrame:
    """Rows grouped by event: reference time, subject, event, region, start; unclear categories first."""
    out = rows.withColumn("priority", review_priority(F.col("category"))).withColumn("verdict", F.lit(""))
    return out.orderBy("ref_lo", *keys, "group_id", region, "lo")
