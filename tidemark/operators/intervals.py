"""Interval algebra on ``(keys, lo, hi)`` relations; times are BIGINT microseconds or DOUBLE seconds.

Binary operations are sweeps over the interval edges (one shuffle, no pairs): cost and memory do not
depend on how many intervals overlap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.islands import islands
from tidemark.operators.scan import last_known, lead, ordered_scan, running_sum
from tidemark.session import settle


def positive(df: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Drop unusable intervals: missing or non-finite bounds, or no positive length."""
    ok = F.col(hi) > F.col(lo)
    for c in (lo, hi):
        ok = ok & F.col(c).isNotNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            ok = ok & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))
    return df.where(ok)


def union(df: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """Disjoint, sorted cover of all intervals of a key; touching intervals join."""
    return islands(positive(df).select(*keys, "lo", "hi"), keys, "lo", "hi", slice_by=slice_by)


def total_length(df: DataFrame, keys: Sequence[str], out: str = "length", slice_by="auto") -> DataFrame:
    return union(df, keys, slice_by).groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias(out))


def _edges(df: DataFrame, keys, a: int, b: int) -> DataFrame:
    edge = lambda t, s: F.struct(F.col(t).alias("t"), F.lit(a * s).alias("da"), F.lit(b * s).alias("db"))
    return df.select(*keys, F.inline(F.array(edge("lo", 1), edge("hi", -1))))


def sweep(a: DataFrame, b: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """Elementary segments ``(keys, lo, hi, in_a, in_b)`` of two normalised sets."""
    edges = _edges(a, keys, 1, 0).unionByName(_edges(b, keys, 0, 1))
    walked = ordered_scan(edges, keys, ["t", "da", "db"],
                          [running_sum("na", "da"), running_sum("nb", "db"), lead("t2", "t")], slice_by)
    return (walked.where(F.col("t2") > F.col("t"))
                  .select(*keys, F.col("t").alias("lo"), F.col("t2").alias("hi"),
                          (F.col("na") > 0).alias("in_a"), (F.col("nb") > 0).alias("in_b")))


def intersect(a: DataFrame, b: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    both = sweep(union(a, keys, slice_by), union(b, keys, slice_by), keys, slice_by)
    return both.where("in_a AND in_b").select(*keys, "lo", "hi")


def subtract(a: DataFrame, b: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    both = sweep(union(a, keys, slice_by), union(b, keys, slice_by), keys, slice_by)
    return both.where("in_a AND NOT in_b").select(*keys, "lo", "hi")


def overlap_length(rows: DataFrame, cover: DataFrame, keys: Sequence[str], out: str = "overlap",
                   lo: str = "lo", hi: str = "hi", slice_by="auto") -> DataFrame:
    """Add to every row the length of its own interval lying inside union(cover); equal rows stay apart.

    The two ends of an interval meet again by a row number."""
    cover = union(cover, keys, slice_by)
    marks = cover.select(*keys, F.inline(F.array(
        F.struct(F.col("lo").alias("_t"), (-F.col("lo")).alias("_d"), F.lit(1).alias("_s")),
        F.struct(F.col("hi").alias("_t"), F.col("hi").alias("_d"), F.lit(-1).alias("_s")))),
        F.lit(0).alias("_o"))
    tagged = settle(rows.select("*", F.struct(*rows.columns).alias("_row")).withColumn("_rid", F.monotonically_increasing_id()))
    asks = tagged.select(*keys, F.inline(F.array(
        F.struct(F.col(lo).alias("_t"), F.lit(-1).alias("_o")),
        F.struct(F.col(hi).alias("_t"), F.lit(1).alias("_o")))), "_rid", "_row")
    walked = ordered_scan(marks.unionByName(asks, allowMissingColumns=True), keys, ["_t", "_o"],
                          [running_sum("_sum", "_d"), running_sum("_deep", "_s")], slice_by)
    at = F.col("_sum") + F.col("_deep") * F.col("_t")
    part = walked.where("_rid IS NOT NULL").groupBy("_rid").agg(F.first("_row").alias("_row"), F.sum(F.col("_o") * at).alias(out))
    usable = F.col(f"_row.{hi}") > F.col(f"_row.{lo}")
    return part.select("_row.*", F.when(usable, F.col(out)).otherwise(F.lit(0)).alias(out))


def contains(points: DataFrame, cover: DataFrame, keys: Sequence[str], t: str, out: str = "inside",
             closed: bool = False, slice_by="auto", normalised: bool = False) -> DataFrame:
    """Flag points lying in union(cover): half-open ``[lo, hi)`` except the right edge of the last
    interval, or both ends inclusive with ``closed=True``."""
    cover = cover if normalised else union(cover, keys, slice_by)
    if closed:
        ends = cover.withColumn("_eo", F.lit(2))
    else:
        # right edge of a key's final interval is part of the last bin
        walked = ordered_scan(cover, keys, ["lo"], [lead("_n", "lo")], slice_by)
        ends = walked.withColumn("_eo", F.when(F.col("_n").isNull(), 2).otherwise(0)).drop("_n")
    marks = ends.select(*keys, F.inline(F.array(
        F.struct(F.col("lo").alias("_t"), F.lit(0).alias("_o"), F.lit(1).alias("_s")),
        F.struct(F.col("hi").alias("_t"), F.col("_eo").alias("_o"), F.lit(-1).alias("_s")))))
    asks = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_o"), F.struct(*points.columns).alias("_p"))
    walked = ordered_scan(marks.unionByName(asks, allowMissingColumns=True), keys, ["_t", "_o"],
                          [running_sum("_deep", "_s")], slice_by)
    return walked.where("_o = 1").select("_p.*", (F.col("_deep") > 0).alias(out))


def holder_of(points: DataFrame, spans: DataFrame, keys: Sequence[str], t: str, value: str,
              out: str, slice_by="auto") -> DataFrame:
    """Value of the disjoint span (inclusive ends) that contains each point, else NULL."""
    marks = spans.select(*keys, F.col("lo").alias("_t"), F.lit(0).alias("_o"),
                         F.struct(F.col("hi").alias("h"), F.col(value).alias("v")).alias("_m"))
    asks = points.select(*keys, F.col(t).alias("_t"), F.lit(1).alias("_o"), F.struct(*points.columns).alias("_p"))
    walked = ordered_scan(marks.unionByName(asks, allowMissingColumns=True), keys, ["_t", "_o"],
                          [last_known("_in", "_m")], slice_by)
    return walked.where("_o = 1").select(
        "_p.*", F.when(F.col("_in.h") >= F.col("_t"), F.col("_in.v")).alias(out))


def local_bins(df: DataFrame, keys: Sequence[str], tz: str, edges_min: Sequence[int]) -> DataFrame:
    """Cut intervals by local calendar day and wall-clock bins, DST-safe.

    Returns ``keys, day, bin, length`` per piece, in the unit of the input (BIGINT microseconds or
    DOUBLE seconds).  Bin edges are minutes after local midnight placed on the wall clock of each day,
    so a 23- or 25-hour day keeps its own length.
    """
    micros = dict(df.dtypes)["lo"] == "bigint"
    us = (lambda c: F.col(c)) if micros else (lambda c: (F.col(c) * 1e6).cast("long"))
    day_of = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_micros(us(c)), tz))
    days = df.withColumn("day", F.explode(F.sequence(day_of("lo"), day_of("hi"))))
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(a).alias("m0"), F.lit(b).alias("m1"))
                     for i, (a, b) in enumerate(zip(edges_min, edges_min[1:]))])

    def wall(m: str):
        at = F.unix_micros(F.to_utc_timestamp(F.col("day").cast("timestamp") + F.make_dt_interval(mins=F.col(m)), tz))
        return at if micros else at / F.lit(1e6)

    cut = days.select(*df.columns, "day", F.inline(bins))
    length = F.least(F.col("hi"), wall("m1")) - F.greatest(F.col("lo"), wall("m0"))
    return cut.withColumn("length", length).where("length > 0").select(*keys, "day", "bin", "length")


def clock_split(df: DataFrame, keys: Sequence[str], tz: str, edges_min: Sequence[int],
                slice_by="auto", normalised: bool = False) -> DataFrame:
    """Length of union(df) per local day and wall-clock bin."""
    return (local_bins(df if normalised else union(df, keys, slice_by), keys, tz, edges_min)
            .groupBy(*keys, "day", "bin").agg(F.sum("length").alias("length")))


def cumulative_at(asks: DataFrame, keys: Sequence[str], t: str, covers: Mapping[str, DataFrame] | None = None,
                  counts: Mapping[str, tuple[DataFrame, str, bool]] | None = None, slice_by="auto") -> DataFrame:
    """Several cumulative lookups in one sweep; rows of ``asks`` are kept one to one.

    ``covers`` (normalised sets): length of the set before ``t``.  ``counts`` = (points, column,
    inclusive): number of points with column < ``t`` (or <=).  The exposure of a window, the points in
    it and the intervals meeting it ("started before its end" minus "ended by its start") are all
    differences of such values, so no pairs are formed however long or dense the window is.
    """
    rows = asks.select(*keys, F.col(t).alias("_t"), F.lit(0).alias("_o"), F.struct(*asks.columns).alias("_p"))
    steps, outs = [], []
    for name, cover in (covers or {}).items():
        rows = rows.unionByName(cover.select(*keys, F.inline(F.array(
            F.struct(F.col("lo").alias("_t"), F.lit(-1).alias("_o"), (-F.col("lo")).alias(f"_d_{name}"), F.lit(1).alias(f"_s_{name}")),
            F.struct(F.col("hi").alias("_t"), F.lit(-1).alias("_o"), F.col("hi").alias(f"_d_{name}"), F.lit(-1).alias(f"_s_{name}"))))),
            allowMissingColumns=True)
        steps += [running_sum(f"_sum_{name}", f"_d_{name}"), running_sum(f"_deep_{name}", f"_s_{name}")]
        outs.append((F.col(f"_sum_{name}") + F.col(f"_deep_{name}") * F.col("_t")).alias(name))
    for name, (points, column, inclusive) in (counts or {}).items():
        rows = rows.unionByName(points.select(*keys, F.col(column).alias("_t"), F.lit(-1 if inclusive else 1).alias("_o"),
                                              F.lit(1).alias(f"_s_{name}")), allowMissingColumns=True)
        steps.append(running_sum(f"_n_{name}", f"_s_{name}"))
        outs.append(F.col(f"_n_{name}").alias(name))
    walked = ordered_scan(rows, keys, ["_t", "_o"], steps, slice_by)
    return walked.where("_p IS NOT NULL").select("_p.*", *outs)


def covered_before(points: DataFrame, cover: DataFrame, keys: Sequence[str], t: str, out: str,
                   slice_by="auto", normalised: bool = False) -> DataFrame:
    """Add ``out`` = length of union(cover) before time ``t``."""
    cover = cover if normalised else union(cover, keys, slice_by)
    return cumulative_at(points, keys, t, covers={out: cover}, slice_by=slice_by)
