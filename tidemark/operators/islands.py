"""Gaps and islands: merge rows whose ranges touch, overlap or lie within a gap.

One operator covers interval union, spike -> complex -> burst grouping, run merging, sessions and
clusters.  In the sliced form only slice totals and the rows at slice edges meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.slicing import SLICE, sliced, spread

# name -> (first aggregation, how partial results merge)
_KINDS = {
    "sum": (F.sum, F.sum),
    "count": (F.count, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "any": (F.bool_or, F.bool_or),
    "set": (F.collect_set, lambda c: F.array_distinct(F.flatten(F.collect_list(c)))),
}


def islands(df: DataFrame, keys: Sequence[str], lo: str, hi: str, *, gap=0, strict: bool = False,
            measures: Mapping[str, tuple[str, Column | str]] | None = None,
            slice_by: Column | str | None = "auto") -> DataFrame:
    """Merge rows of one key into islands; returns ``keys, lo, hi`` and the measures.

    A row opens a new island when its ``lo`` is more than ``gap`` past the largest ``hi`` before it
    (``strict=True``: at ``gap`` already).  ``measures`` maps an output name to ``(kind, value)``,
    kind in sum, count, min, max, any, set (use set only for small domains); use min/max of a struct
    for the first/last value.
    """
    keys = list(keys)
    measures = dict(measures or {})
    n = 0
    if isinstance(slice_by, str):
        df, slice_by, n = sliced(df, lo, keys)
    past = (lambda a, b: a >= b + F.lit(gap)) if strict else (lambda a, b: a > b + F.lit(gap))

    def opens(reach: Column) -> Column:
        return F.coalesce(past(F.col(lo), reach), F.lit(True))

    first = [F.min(lo).alias("_lo"), F.max(hi).alias("_hi")] + [
        _KINDS[kind][0](value).alias(name) for name, (kind, value) in measures.items()]
    merge = [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")] + [
        _KINDS[kind][1](F.col(name)).alias(name) for name, (kind, _) in measures.items()]
    result = keys + [F.col("_lo").alias(lo), F.col("_hi").alias(hi)] + list(measures)

    group = keys if slice_by is None else keys + [SLICE]
    rows = df if slice_by is None else df.withColumn(SLICE, slice_by)
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(lo, hi)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    numbered = (spread(rows, group, n).withColumn("_reach", F.max(hi).over(before))
                    .withColumn("_island", F.sum(opens(F.col("_reach")).cast("long")).over(upto)))
    local = numbered.groupBy(*group, "_island").agg(*first)
    if slice_by is None:
        return local.select(*result)

    # What earlier slices reach decides which leading islands continue an older one.
    outer = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE)
    reach = (rows.groupBy(*group).agg(F.max(hi).alias("_top"))
                 .select(*group, F.max("_top").over(outer.rowsBetween(Window.unboundedPreceding, -1))
                         .alias("_carry")))
    continues = F.col("_carry").isNotNull() & ~past(F.col("_lo"), F.col("_carry"))
    settled = (local.join(reach, group)
                    .withColumn("_no", F.when(continues, F.lit(0)).otherwise(F.col("_island")))
                    .groupBy(*group, "_no").agg(*merge)
                    .withColumn("_last", F.max("_no").over(Window.partitionBy(*group))))
    at_edge = (F.col("_no") == 0) | (F.col("_no") == F.col("_last"))
    chain = (Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SLICE, "_no")
                   .rowsBetween(Window.unboundedPreceding, 0))
    edges = (settled.where(at_edge)
                    .withColumn("_chain", F.sum((F.col("_no") > 0).cast("long")).over(chain))
                    .groupBy(*keys, "_chain").agg(*merge))
    return settled.where(~at_edge).select(*result).unionByName(edges.select(*result))
