"""Ordered scans: lag, lead, running aggregates and fills that survive a hot key.

``ordered_scan(df, keys, order, steps)`` adds one column per step.  With a slice expression the work
is done in ``(keys, slice)`` windows plus one carry row per slice; without one it is a plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.slicing import SLICE, sliced, spread

_ALL = Window.unboundedPreceding


@dataclass(frozen=True)
class Step:
    """One output column: how to compute it in a window, and how slices hand it over."""

    out: str
    local: Callable          # window -> Column
    summary: Callable        # order struct -> aggregate Column of a slice
    carry: Callable          # (window, summary column) -> Column seen by a slice
    combine: Callable        # (local, carry) -> Column
    backward: bool = False   # windows get the reversed order


def lag(out: str, value) -> Step:
    boxed = F.struct(_c(value).alias("v"))
    return Step(out, lambda w: F.lag(boxed).over(w), lambda o: F.max_by(boxed, o),
                lambda w, s: F.lag(s).over(w), lambda a, b: F.coalesce(a, b)["v"])


def lead(out: str, value) -> Step:
    boxed = F.struct(_c(value).alias("v"))
    return Step(out, lambda w: F.lead(boxed).over(w), lambda o: F.min_by(boxed, o),
                lambda w, s: F.lead(s).over(w), lambda a, b: F.coalesce(a, b)["v"])


def running_sum(out: str, value, inclusive: bool = True) -> Step:
    v = F.coalesce(_c(value), F.lit(0))
    end = 0 if inclusive else -1
    zero = F.lit(0)
    return Step(out, lambda w: F.coalesce(F.sum(v).over(w.rowsBetween(_ALL, end)), zero),
                lambda o: F.sum(v),
                lambda w, s: F.coalesce(F.sum(s).over(w.rowsBetween(_ALL, -1)), zero),
                lambda a, b: a + F.coalesce(b, zero))


def position(out: str) -> Step:
    """1-based row number in order."""
    return running_sum(out, F.lit(1))


def running_max(out: str, value, inclusive: bool = False) -> Step:
    v, end = _c(value), (0 if inclusive else -1)
    return Step(out, lambda w: F.max(v).over(w.rowsBetween(_ALL, end)), lambda o: F.max(v),
                lambda w, s: F.max(s).over(w.rowsBetween(_ALL, -1)), lambda a, b: F.greatest(a, b))


def last_known(out: str, value, inclusive: bool = True) -> Step:
    """Latest non-null value at or before the row (forward fill, as-of, state hold)."""
    v, end = _c(value), (0 if inclusive else -1)
    return Step(out, lambda w: F.last(v, True).over(w.rowsBetween(_ALL, end)),
                lambda o: F.max_by(v, F.when(v.isNotNull(), o)),
                lambda w, s: F.last(s, True).over(w.rowsBetween(_ALL, -1)), F.coalesce)


def next_known(out: str, value, inclusive: bool = True) -> Step:
    """Earliest non-null value at or after the row (backward fill).

    Runs over the reversed order: a frame growing from the far end is linear, one reaching to
    "unbounded following" would be evaluated anew for every row.
    """
    v, end = _c(value), (0 if inclusive else -1)
    return Step(out, lambda w: F.last(v, True).over(w.rowsBetween(_ALL, end)),
                lambda o: F.min_by(v, F.when(v.isNotNull(), o)),
                lambda w, s: F.last(s, True).over(w.rowsBetween(_ALL, -1)), F.coalesce, backward=True)


def ordered_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], steps: Sequence[Step],
                 slice_by: Column | str | None = "auto") -> DataFrame:
    """Add one column per step, following ``order`` (a total order) within ``keys``.

    ``slice_by`` must be monotone in the first order column: a Column, ``"auto"`` (measured, see
    ``slice_of``) or None for groups known to be bounded.
    """
    keys, order = list(keys), list(order)
    rows = 0
    if isinstance(slice_by, str):
        df, slice_by, rows = sliced(df, order[0], keys)
    down = [F.col(c).desc() for c in order]

    def ordered(by: list[str], up: list, reverse: list):
        part = Window.partitionBy(*(by or [F.lit(0)]))
        ahead, back = part.orderBy(*up), part.orderBy(*reverse)
        return lambda step: back if step.backward else ahead

    if slice_by is None:
        w = ordered(keys, order, down)
        return spread(df, keys, rows).select("*", *[s.combine(s.local(w(s)), F.lit(None)).alias(s.out) for s in steps])

    cut = df.withColumn(SLICE, slice_by)
    group = keys + [SLICE]
    inner, outer = ordered(group, order, down), ordered(keys, [SLICE], [F.col(SLICE).desc()])
    at = F.struct(*order)
    locals_ = spread(cut, group, rows).select("*", *[s.local(inner(s)).alias(f"_l{i}") for i, s in enumerate(steps)])
    totals = cut.groupBy(*group).agg(*[s.summary(at).alias(f"_s{i}") for i, s in enumerate(steps)])
    carries = totals.select(*group, *[s.carry(outer(s), F.col(f"_s{i}")).alias(f"_c{i}")
                                      for i, s in enumerate(steps)])
    joined = locals_.join(carries, group)
    return joined.select(*df.columns, *[
        s.combine(F.col(f"_l{i}"), F.col(f"_c{i}")).alias(s.out) for i, s in enumerate(steps)])


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value
