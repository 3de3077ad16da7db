"""Exact order statistics by key without sorting a whole key in one task.

Values are first counted per (key, value) - map-side combined, so ties collapse - and the cumulative
count is an ordered scan over value slices.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import ordered_scan, running_sum
from tidemark.session import durable, settle

_ACCURACY = 10_000  # of the bracketing sketch


def value_counts(df: DataFrame, keys: Sequence[str], value: str, slice_by="auto") -> DataFrame:
    """Distinct values per key with count ``n``, rows below ``below`` and group size ``total``."""
    keys = list(keys)
    ok = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if not keys:
        return value_counts(ok.withColumn("_all", F.lit(0)), ["_all"], value, slice_by).drop("_all")
    ok = settle(ok)
    counted = ok.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    walked = ordered_scan(counted, keys, [value], [running_sum("below", "n", inclusive=False)], slice_by)
    sizes = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return walked.join(sizes, keys)


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, outs: Mapping[str, float],
                      slice_by="auto", bracket: bool = False) -> DataFrame:
    """Percentiles (0-100) with rank ``p/100*n + 0.5``, clamped to [1, n], linear in between.

    With ``bracket`` the input is not shuffled by value, which pays where values hardly repeat: a mergeable
    sketch brackets each rank, and only the values inside the brackets (a few per mille) are counted and
    ranked, on top of the exact number below.
    """
    keys = list(keys)
    if not keys:
        return exact_percentiles(df.withColumn("_all", F.lit(0)), ["_all"], value, outs, slice_by, bracket).drop("_all")
    if not bracket:
        vc = value_counts(df, keys, value, slice_by)
        return _pick(vc, keys, value, outs, lambda i: F.lit(True))
    ok = settle(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, value))
    return _bracketed(ok, keys, value, outs, slice_by)


def _rank(pct: float) -> Column:
    return F.least(F.greatest(F.lit(pct / 100.0) * F.col("total") + 0.5, F.lit(1.0)), F.col("total").cast("double"))


def _pick(vc: DataFrame, keys: list[str], value: str, outs: Mapping[str, float], lane) -> DataFrame:
    """Interpolate the wanted ranks from counted values (``n, below, total``); ``lane(i)`` says which rows
    serve the i-th percentile."""
    aggs: list[Column] = []
    for i, (out, pct) in enumerate(outs.items()):
        rank = _rank(pct)
        low, high = F.floor(rank), F.ceil(rank)
        holds = lambda r: lane(i) & (F.col("below") < r) & (r <= F.col("below") + F.col("n"))
        aggs += [F.max(F.when(holds(low), F.col(value))).alias(f"_a_{out}"),
                 F.max(F.when(holds(high), F.col(value))).alias(f"_b_{out}"),
                 F.max(rank - low).alias(f"_f_{out}")]
    agg = vc.groupBy(*keys).agg(*aggs)
    return agg.select(*keys, *[
        (F.col(f"_a_{o}") + F.col(f"_f_{o}") * (F.col(f"_b_{o}") - F.col(f"_a_{o}"))).alias(o) for o in outs])


def _bracketed(ok: DataFrame, keys: list[str], value: str, outs: Mapping[str, float], slice_by) -> DataFrame:
    margin = 5 / _ACCURACY
    probs = [min(1.0, max(0.0, p / 100 + d)) for p in outs.values() for d in (-margin, margin)]
    sketch = ok.groupBy(*keys).agg(F.percentile_approx(value, probs, _ACCURACY).alias("_q"), F.count(F.lit(1)).alias("total"),
                                   F.min(value).alias("_min"), F.max(value).alias("_max"))
    cuts = []
    for i, p in enumerate(outs.values()):
        lo = F.col("_min") if p / 100 <= margin else F.col("_q")[2 * i]
        hi = F.col("_max") if p / 100 >= 1 - margin else F.col("_q")[2 * i + 1]
        cuts.append(F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi")))
    brackets = durable(sketch.select(*keys, "total", F.array(*cuts).alias("_cuts")))
    x = ok.join(brackets, keys)
    v = F.col(value)
    under = x.groupBy(*keys).agg(*[F.count_if(v < F.col("_cuts")[i]["lo"]).alias(f"_u{i}") for i in range(len(outs))])
    inside = (x.where(F.exists("_cuts", lambda c: (v >= c["lo"]) & (v <= c["hi"])))
               .select(*keys, value, F.explode(F.filter("_cuts", lambda c: (v >= c["lo"]) & (v <= c["hi"]))).alias("_c"))
               .select(*keys, value, F.col("_c.i").alias("_i")))
    counted = durable(inside.groupBy(*keys, "_i", value).agg(F.count(F.lit(1)).alias("n")))
    walked = ordered_scan(counted, [*keys, "_i"], [value], [running_sum("_in", "n", inclusive=False)], slice_by)
    base = F.element_at(F.array(*[F.col(f"_u{i}") for i in range(len(outs))]), F.col("_i") + 1)
    vc = walked.join(under, keys).join(brackets.select(*keys, "total"), keys).withColumn("below", F.col("_in") + base)
    out = durable(_pick(vc, keys, value, outs, lambda i: F.col("_i") == i))
    empty = F.lit(False)
    for o in outs:
        empty = empty | F.col(o).isNull()
    missed = out.where(empty).select(*keys)
    if missed.isEmpty():
        return out
    # a bracket that misses its rank (the sketch promises none does) falls back to counting all values
    full = _pick(value_counts(ok.join(missed, keys, "left_semi"), keys, value, slice_by), keys, value, outs, lambda i: F.lit(True))
    return out.where(~empty).unionByName(full)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", slice_by="auto") -> DataFrame:
    return exact_percentiles(df, keys, value, {out: 50.0}, slice_by)


def tied_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", slice_by="auto") -> DataFrame:
    """Average rank of every distinct value: ``keys, value, n, out`` (join back on keys + value)."""
    vc = value_counts(df, keys, value, slice_by)
    return vc.select(*keys, value, "n", "total", (F.col("below") + (F.col("n") + 1) / 2).alias(out))


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "rank", slice_by="auto") -> DataFrame:
    ranks = tied_ranks(df, keys, value, out, slice_by).select(*keys, value, out)
    return df.join(ranks, [*keys, value])
