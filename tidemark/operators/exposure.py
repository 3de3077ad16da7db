"""Observation time and exposure-normalised rates from interval sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators.events import peri_zones
from tidemark.session import settle


def observation_sets(files: DataFrame, gaps: DataFrame, off: DataFrame, reviewed_off: DataFrame,
                     keys: Sequence[str], slice_by="auto") -> dict[str, DataFrame]:
    """Interval sets per key: ``rec`` (union of files), ``eeg`` (rec - gaps - off) and ``observed``
    (eeg plus the reviewed off-time inside rec).  Each set is written once; no set that is disjoint already is merged again."""
    keys = list(keys)
    cols = [*keys, "lo", "hi"]
    rec = settle(iv.union(files.select(*cols), keys, slice_by))
    lost = iv.union(gaps.select(*cols).unionByName(off.select(*cols)), keys, slice_by)
    eeg = settle(iv.sweep(rec, lost, keys, slice_by).where("in_a AND NOT in_b").select(*cols))
    back = iv.sweep(iv.union(reviewed_off.select(*cols), keys, slice_by), rec, keys, slice_by).where("in_a AND in_b").select(*cols)
    return {"rec": rec, "eeg": eeg, "observed": iv.union(eeg.unionByName(back), keys, slice_by)}


def exclusion_grid(events: DataFrame, recording: DataFrame, points: DataFrame, keys: Sequence[str],
                   configs: Sequence[tuple[str, int]], unit, slice_by="auto") -> DataFrame:
    """Exposure and point counts outside zones around events, for every (side, W) configuration.

    Zones of all configurations are one relation keyed by (keys, side, w); exposure is
    recording - zones and points are counted outside them (both zone ends excluded).
    """
    keys = list(keys)
    grid = [*keys, "side", "w"]
    zones = settle(iv.union(peri_zones(events, keys, configs, unit), grid, slice_by))
    left = iv.sweep(each_configuration(iv.union(recording.select(*keys, "lo", "hi"), keys, slice_by), configs), zones, grid, slice_by)
    return outside_grid(left, zones, points, keys, configs, slice_by)


def each_configuration(df: DataFrame, configs: Sequence[tuple[str, int]]) -> DataFrame:
    """Every row once for each (side, W)."""
    conf = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(w).alias("w")) for s, w in configs]))
    return df.withColumn("_c", conf).select(*df.columns, "_c.*")


def outside_grid(swept: DataFrame, zones: DataFrame, points: DataFrame, keys: Sequence[str], configs: Sequence[tuple[str, int]], slice_by="auto") -> DataFrame:
    """``n_events, exposure`` of every key and configuration outside disjoint ``zones``; ``swept``: the sweep of the recording with them."""
    grid = [*keys, "side", "w"]
    exposure = swept.where("in_a AND NOT in_b").groupBy(*grid).agg(F.sum(F.col("hi") - F.col("lo")).alias("exposure"))
    out = iv.contains(each_configuration(points, configs), zones, grid, "t", closed=True, slice_by=slice_by, normalised=True)
    counts = out.groupBy(*grid).agg(F.count_if(~F.col("inside")).alias("n_events"))
    return counts.join(exposure, grid, "left").na.fill(0, ["exposure"])


def after_event_variants(points: DataFrame, events: DataFrame, keys: Sequence[str], spans: Sequence[int], unit,
                         slice_by="auto") -> DataFrame:
    """Points left when the time after every event is excluded, once per exclusion length (``version``)."""
    keys = list(keys)
    each = F.explode(F.array(*[F.lit(s) for s in spans])).alias("version")
    zones = events.select(*keys, F.col("hi").alias("_e"), each)
    zones = zones.select(*keys, "version", F.col("_e").alias("lo"), (F.col("_e") + F.col("version") * F.lit(unit)).alias("hi"))
    out = iv.contains(points.select("*", each), zones, [*keys, "version"], "t", slice_by=slice_by)
    return out.where("NOT inside").drop("inside")
