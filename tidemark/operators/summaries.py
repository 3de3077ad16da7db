"""Summary tables: per recording, per subject and scope, per clock hour, per day, around events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv

HOURS = list(range(0, 1441, 60))


def _clock(df: DataFrame, t: str):
    """(units per second, instant) of a time column in BIGINT microseconds or DOUBLE seconds."""
    if dict(df.dtypes)[t] == "bigint":
        return F.lit(1e6), F.timestamp_micros(F.col(t))
    return F.lit(1.0), F.timestamp_micros((F.col(t) * 1e6).cast("long"))


def length_of(df: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("hi") - F.col("lo")).alias(out))


def recording_summary(manifest: DataFrame, events: DataFrame, keys: Sequence[str], valid: str) -> DataFrame:
    """Per recording: number, total / mean / min / max duration and share of valid time.  A recording
    without events has total 0 and no mean, min or max."""
    d = F.col("hi") - F.col("lo")
    agg = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.sum(d).alias("total"), F.avg(d).alias("mean"),
                                    F.min(d).alias("shortest"), F.max(d).alias("longest"))
    out = manifest.join(agg, list(keys), "left").na.fill(0, ["n_events", "total"])
    return out.withColumn("pct_time", 100 * F.try_divide(F.col("total"), F.col(valid)))


def status_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by detection status, distinct events, and reported time with and without imputed rows."""
    is_ = lambda s: F.count_if(F.col("detection_status") == s)
    d = F.col("hi") - F.col("lo")
    return rows.groupBy(*keys).agg(
        is_("accepted").alias("n_accepted"), is_("rescued").alias("n_rescued"), is_("imputed").alias("n_imputed"),
        F.count(F.lit(1)).alias("n_reported"), F.count_distinct("group_id").alias("n_events"),
        F.sum(d).alias("time_reported"),
        F.sum(F.when(F.col("detection_status") == "accepted", d).otherwise(0)).alias("time_accepted"))


def category_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct events per category and time in Crisis, and in Crisis or Candidates."""
    cat, d = F.col("category"), F.col("hi") - F.col("lo")
    n = lambda c: F.count_distinct(F.when(cat == c, F.col("group_id"))).alias(f"n_{c.lower()}")
    t = lambda ok, name: F.sum(F.when(ok, d).otherwise(0)).alias(name)
    return rows.groupBy(*keys).agg(n("Crisis"), n("Candidates"), n("Candidates_in_band"),
                                   t(cat == "Crisis", "time_crisis"),
                                   t(cat.isin("Crisis", "Candidates"), "time_crisis_candidates"))


def scope_rows(df: DataFrame, campaign: str, merged: str = "merged") -> DataFrame:
    """Every row once under its own campaign and once under the merged scope."""
    return df.withColumn("scope", F.explode(F.array(F.col(campaign), F.lit(merged))))


def performance(units: DataFrame, by: Sequence[str], totals: Mapping[str, str], hours: str) -> DataFrame:
    """Sensitivity, PPV and false detections per 24 h over every combination of ``by`` including totals.
    ``units`` carries tp, fp, missed; ratios are taken after the sums and are NULL for nothing."""
    cube = units.cube(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("missed").alias("missed"),
                               F.sum(hours).alias(hours), *[F.grouping(c).alias(f"_g_{c}") for c in by])
    named = [F.when(F.col(f"_g_{c}") == 1, F.lit(totals[c])).otherwise(F.col(c)).alias(c) for c in by]
    tp = F.col("tp")
    return cube.select(*named, "tp", "fp", "missed", hours,
                       F.try_divide(tp, tp + F.col("missed")).alias("sensitivity"),
                       F.try_divide(tp, tp + F.col("fp")).alias("ppv"),
                       (24 * F.try_divide(F.col("fp"), F.col(hours))).alias("fp_per_24h"))


def hourly_rates(points: DataFrame, observed: DataFrame, keys: Sequence[str], tz: str, t: str = "t",
                 slice_by="auto") -> DataFrame:
    """24 clock hours per key: points, observed seconds, rate per hour."""
    keys = list(keys)
    per_second, instant = _clock(points, t)
    hour = F.hour(F.from_utc_timestamp(instant, tz))
    n = points.groupBy(*keys, hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    s = (iv.clock_split(observed, keys, tz, HOURS, slice_by).groupBy(*keys, F.col("bin").alias("hour"))
           .agg((F.sum("length") / per_second).alias("seconds")))
    every = (observed.select(*keys).union(points.select(*keys)).distinct()
             .withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))))
    out = every.join(n, [*keys, "hour"], "left").join(s, [*keys, "hour"], "left").na.fill(0, ["n", "seconds"])
    return out.withColumn("per_hour", F.try_divide(F.col("n"), F.col("seconds") / 3600))


def light_phase(instant: Column, tz: str, lights_on: int, lights_off: int) -> Column:
    """'dark' before lights-on or from lights-off (minutes of the local day), else 'light'."""
    local = F.from_utc_timestamp(instant, tz)
    minute = F.hour(local) * 60 + F.minute(local) + F.second(local) / 60
    return F.when((minute < lights_on) | (minute >= lights_off), "dark").otherwise("light")


def elapsed_days(recording: DataFrame, sets: Mapping[str, DataFrame], points: Mapping[str, DataFrame],
                 keys: Sequence[str], day, slice_by="auto") -> DataFrame:
    """24-hour days counted from each key's first recorded instant.

    Adds the length of every interval set and the number of points of every point set per day; days
    without recording are left out.  Exposure comes from two cumulative lookups per day edge.
    """
    keys = list(keys)
    rec = iv.union(recording, keys, slice_by)
    span = rec.groupBy(*keys).agg(F.min("lo").alias("t0"), F.max("hi").alias("t1"))
    n_days = F.ceil((F.col("t1") - F.col("t0")) / F.lit(day)).cast("int")
    days = (span.withColumn("day", F.explode(F.sequence(F.lit(1), n_days)))
                .withColumn("w0", F.col("t0") + (F.col("day") - 1) * F.lit(day))
                .withColumn("w1", F.col("t0") + F.col("day") * F.lit(day)).drop("t0", "t1"))
    covers = {"rec": rec, **{n: iv.union(df, keys, slice_by) for n, df in sets.items()}}
    edges = days.select(*keys, "day", "w0", "w1", F.inline(F.array(
        F.struct(F.col("w0").alias("_e"), F.lit(-1).alias("_f")), F.struct(F.col("w1").alias("_e"), F.lit(1).alias("_f")))))
    at = iv.cumulative_at(edges, keys, "_e", covers, {n: (df, "t", False) for n, df in points.items()}, slice_by)
    names = [*covers, *points]
    out = at.groupBy(*keys, "day", "w0", "w1").agg(*[F.sum(F.col("_f") * F.col(n)).alias(n) for n in names])
    return out.where("rec > 0")


def calendar_days(recording: DataFrame, points: DataFrame, keys: Sequence[str], tz: str, slice_by="auto") -> DataFrame:
    """Observed seconds and points per local calendar day."""
    keys = list(keys)
    per_second, instant = _clock(points, "t")
    s = (iv.clock_split(recording, keys, tz, [0, 1440], slice_by).groupBy(*keys, "day")
           .agg((F.sum("length") / per_second).alias("seconds")))
    local = F.from_utc_timestamp(instant, tz)
    n = points.groupBy(*keys, F.to_date(local).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, [*keys, "day"], "full").na.fill(0, ["n", "seconds"])


def around_events(events: DataFrame, windows: Sequence[tuple[str, bool, int, int]], included: DataFrame,
                  points: DataFrame, keys: Sequence[str], coverage: float, baseline_distance, unit=1,
                  slice_by="auto") -> DataFrame:
    """Point rate in windows around events against the rate far from any event.

    ``windows`` = (name, after_end, from, to).  A window counts when no other event meets it and at
    least ``coverage`` of it was included.  Overlaps and coverage come from cumulative lookups, so the
    cost is one row per event and window whatever the density.
    """
    keys = list(keys)
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(post).alias("post"), F.lit(a * unit).alias("a"),
                                        F.lit(b * unit).alias("b")) for n, post, a, b in windows]))
    x = events.select(*keys, "event_id", "lo", "hi", spec.alias("s"))
    ref = F.when(F.col("s.post"), F.col("hi")).otherwise(F.col("lo"))
    x = x.select(*keys, "event_id", "lo", "hi", "s.window", (ref + F.col("s.a")).alias("w0"), (ref + F.col("s.b")).alias("w1"))
    inc = iv.union(included, keys, slice_by)
    own = ((F.col("lo") < F.col("w1")) & (F.col("hi") > F.col("w0"))).cast("int")
    edges = x.withColumn("_own", own).select(*keys, "event_id", "window", "w0", "w1", "_own", F.inline(F.array(
        F.struct(F.col("w0").alias("_t"), F.lit(False).alias("_end")), F.struct(F.col("w1").alias("_t"), F.lit(True).alias("_end")))))
    at = iv.cumulative_at(edges, keys, "_t", {"_cov": inc}, {"_started": (events, "lo", False), "_ended": (events, "hi", True),
                                                           "_pts": (points, "t", False)}, slice_by)
    diff = lambda c: F.sum(F.when(F.col("_end"), F.col(c)).otherwise(-F.col(c)))
    x = at.groupBy(*keys, "event_id", "window", "w0", "w1", "_own").agg(
        diff("_cov").alias("_e"), diff("_pts").alias("_n"),
        F.sum(F.when(F.col("_end"), F.col("_started")).otherwise(-F.col("_ended"))).alias("_meet"))
    x = x.withColumn("_others", F.col("_meet") - F.col("_own"))
    state = (F.when(F.col("_others") > 0, "meets_other")
              .when(F.col("_e") < F.lit(coverage) * (F.col("w1") - F.col("w0")), "low_coverage").otherwise("valid"))
    x = x.withColumn("_state", state)
    ok = F.col("_state") == "valid"
    per = x.groupBy(*keys, "window").agg(
        F.count_if(ok).alias("n_valid"), F.count_if(F.col("_state") == "meets_other").alias("n_meets_other"),
        F.count_if(F.col("_state") == "low_coverage").alias("n_low_coverage"),
        F.sum(F.when(ok, F.col("_n")).otherwise(0)).alias("n_points"), F.sum(F.when(ok, F.col("_e")).otherwise(0)).alias("exposure"))
    far = events.select(*keys, (F.col("lo") - F.lit(baseline_distance)).alias("lo"), (F.col("hi") + F.lit(baseline_distance)).alias("hi"))
    base_e = length_of(iv.subtract(inc, far, keys, slice_by), keys, "base_exposure")
    base_n = (iv.contains(points, far, keys, "t", slice_by=slice_by).where("NOT inside").groupBy(*keys)
                .agg(F.count(F.lit(1)).alias("base_points")))
    out = per.join(base_e, keys, "left").join(base_n, keys, "left").na.fill(0, ["base_exposure", "base_points"])
    rate, base = F.try_divide(F.col("n_points"), F.col("exposure")), F.try_divide(F.col("base_points"), F.col("base_exposure"))
    return out.withColumns({"rate": rate, "base_rate": base, "ratio": F.try_divide(rate, base)})


def asymmetry(rates: DataFrame, keys: Sequence[str], region: str, right: str, left: str, value: str) -> DataFrame:
    """Both sides as columns and (R - L) / (R + L)."""
    wide = rates.groupBy(*keys).pivot(region, [right, left]).agg(F.first(value))
    r, l = F.col(right), F.col(left)
    return wide.withColumn("asymmetry", F.try_divide(r - l, r + l))


def pooled_and_median(subjects: DataFrame, by: Sequence[str], n: str, exposure: str, rate: str, slice_by="auto") -> DataFrame:
    """Group totals with the pooled rate and the median of the subjects' own rates."""
    from tidemark.operators.quantiles import exact_median
    sums = subjects.groupBy(*by).agg(F.sum(n).alias(n), F.sum(exposure).alias(exposure), F.count(F.lit(1)).alias("n_subjects"))
    med = exact_median(subjects, by, rate, f"median_{rate}", slice_by)
    return sums.join(med, list(by), "left").withColumn(f"pooled_{rate}", F.try_divide(F.col(n), F.col(exposure)))


def raster(layers: Mapping[str, DataFrame], t0: DataFrame, keys: Sequence[str], day, hour) -> DataFrame:
    """Rows ``(keys, day, layer, h0, h1)``: every interval cut at the key's own 24-hour day edges."""
    out = None
    for name, df in layers.items():
        x = df.join(t0, list(keys)).where("hi > lo")
        first = F.floor((F.col("lo") - F.col("t0")) / F.lit(day))
        last = F.ceil((F.col("hi") - F.col("t0")) / F.lit(day)) - 1
        x = x.withColumn("day", F.explode(F.sequence(first, last)))
        edge = F.col("t0") + F.col("day") * F.lit(day)
        part = x.select(*keys, (F.col("day") + 1).alias("day"), F.lit(name).alias("layer"),
                        ((F.greatest("lo", edge) - edge) / F.lit(hour)).alias("h0"),
                        ((F.least(F.col("hi"), edge + F.lit(day)) - edge) / F.lit(hour)).alias("h1"))
        out = part if out is None else out.unionByName(part)
    return out.where("h1 > h0")


def gap_bands(events: DataFrame, keys: Sequence[str], limits: Sequence[tuple[str, int]], slice_by="auto") -> DataFrame:
    """How far apart consecutive events of a key are: counts up to each limit, beyond the last, maximum."""
    from tidemark.operators.scan import lag, ordered_scan
    x = ordered_scan(events, keys, ["lo", "event_id"], [lag("_p", "hi")], slice_by)
    gap = F.col("lo") - F.col("_p")
    aggs, low = [], None
    for name, limit in limits:
        ok = gap <= F.lit(limit) if low is None else (gap <= F.lit(limit)) & (gap > F.lit(low))
        aggs.append(F.count_if(ok).alias(name))
        low = limit
    return x.where("_p IS NOT NULL").groupBy(*keys).agg(*aggs, F.count_if(gap > F.lit(low)).alias("beyond"), F.max(gap).alias("longest"))
