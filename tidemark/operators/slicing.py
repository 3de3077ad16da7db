"""Equi-depth slices of an ordered column.

An ordered operator (running sum, lag, interval merge ...) over one key needs that key's rows in
order.  A plain ``Window.partitionBy(key)`` puts a hot key - a third of all rows, say - in one task.
The library instead cuts the axis into slices, works inside ``(key, slice)`` and passes one summary
row per slice to a second, small window.  ``slice_of`` supplies the slice number: a monotone
expression of the ordering column whose cuts are quantiles of the data, so outliers and bursts in time
do not make heavy slices.  Only rows at one and the same instant of one key stay together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import settle

SLICE = "_slice"
TARGET_ROWS = 2_000_000
TASK_ROWS = 250_000  # rows that a task sorts
_FAN = 32
_PROBES = 1023  # quantiles that the first look at a column takes


def sliced(df: DataFrame, column: str, keys: Sequence[str] = ()) -> tuple[DataFrame, Column | None, int]:
    """The input ready to be read several times, its slice expression (None if the rows of every key fit one slice) and its number of rows.

    A key's rows are cut only where a key has more than ``TARGET_ROWS`` of them, counted: the others need no second window and no
    carries, however many keys there are."""
    df = settle(df)
    n, most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return df, _measured(df, column, TARGET_ROWS)[1] if most > TARGET_ROWS else None, n


def spread(df: DataFrame, group: Sequence[str], rows: int) -> DataFrame:
    """Deal groups to as many tasks as leave each about ``TASK_ROWS`` of the ``rows``, where the session's number of
    partitions is smaller: the memory of a task does not grow with the input."""
    parts = math.ceil(rows / TASK_ROWS)
    return df.repartition(parts, *group) if group and parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def slice_of(df: DataFrame, column: str, target_rows: int | None = None) -> Column | None:
    """Slice expression over ``column`` with about ``target_rows`` rows a slice; None if there are no more
    rows than that, counted, so that no key can have more.

    Costs one pass over that column for its count and quantile sketch, a second one beyond
    ``_PROBES * target_rows`` rows.  The driver holds the cuts only, one per ``target_rows`` rows.
    """
    return _measured(df, column, target_rows or TARGET_ROWS)[1]


def _measured(df: DataFrame, column: str, target_rows: int) -> tuple[int, Column | None]:
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    probes = [i / (_PROBES + 1) for i in range(1, _PROBES + 1)]
    n, sketch = values.agg(F.count(F.lit(1)), F.percentile_approx("v", probes, 4 * (_PROBES + 1))).first()
    parts = math.ceil(n / target_rows)
    if parts < 2:
        return n, None
    if parts <= _PROBES + 1:
        cuts = [sketch[i * (_PROBES + 1) // parts - 1] for i in range(1, parts)]
    else:
        cuts = values.approxQuantile("v", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return n, locate(F.col(column).cast("double"), sorted(set(cuts)))


def locate(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cuts at or below ``value``: a search tree of literal arrays, 32 comparisons per level."""
    if not cuts:
        return F.lit(0).cast("long")
    if len(cuts) <= _FAN:
        return F.size(F.filter(_array(cuts), lambda c: c <= value)).cast("long")
    groups = [cuts[i:i + _FAN] for i in range(0, len(cuts), _FAN)]
    at = locate(value, [g[0] for g in groups[1:]])
    inside = F.element_at(F.expr("array(" + ",".join(_text(g) for g in groups) + ")"), (at + 1).cast("int"))
    return at * _FAN + F.size(F.filter(inside, lambda c: c <= value))


def _text(cuts: Sequence[float]) -> str:
    return "array(" + ",".join(f"{c!r}D" for c in cuts) + ")"


def _array(cuts: Sequence[float]) -> Column:
    return F.expr(_text(cuts))


def fixed_slice(column: str, width: float) -> Column:
    """Slices of constant width (for regular signals, where the rate bounds the rows per slice)."""
    return F.floor(F.col(column) / F.lit(width)).cast("long")
