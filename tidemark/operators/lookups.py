"""Dimension lookups with contracts: uniqueness, priority, fallback, position, absence reasons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import ordered_scan, position


def unique_lookup(df: DataFrame, dim: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left lookup that reports its contract in ``lookup_status``: ok, missing or ambiguous.

    The dimension is reduced to one row per key first, so duplicates never multiply the facts.
    """
    values = [c for c in dim.columns if c not in on]
    one = dim.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in values])
    out = df.join(one, list(on), "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("ok")
    out = out.withColumn("lookup_status", status)
    keep = F.col("lookup_status") == "ok"
    return out.select(*df.columns, *[F.when(keep, F.col(c)).alias(c) for c in values], "lookup_status")


def priority_lookup(df: DataFrame, rules: DataFrame, on: str, region: str, row: str, values: Sequence[str],
                    defaults: Mapping[str, object]) -> DataFrame:
    """Case rule by file name (case-insensitive): a rule for the region beats a wildcard rule (NULL or ''
    region), among equals the last row wins; no rule gives the defaults with ``rule_source='default'``."""
    r = rules.select(F.lower(on).alias("_file"), F.lower(F.coalesce(region, F.lit(""))).alias("_reg"), row, *values)
    last = r.groupBy("_file", "_reg").agg(F.max_by(F.struct(*values), row).alias("_v"))
    specific = last.where("_reg <> ''").withColumnRenamed("_v", "_specific")
    wildcard = last.where("_reg = ''").select("_file", F.col("_v").alias("_wildcard"))
    out = (df.withColumn("_file", F.lower(on)).withColumn("_reg", F.lower(region))
             .join(specific, ["_file", "_reg"], "left").join(wildcard, "_file", "left"))
    hit = F.coalesce("_specific", "_wildcard")
    source = (F.when(F.col("_specific").isNotNull(), "region").when(F.col("_wildcard").isNotNull(), "wildcard")
               .otherwise("default"))
    return out.select(*df.columns, *[F.coalesce(hit[v], F.lit(defaults.get(v))).alias(v) for v in values],
                      source.alias("rule_source"))


def fallback_lookup(df: DataFrame, specific: DataFrame, general: DataFrame, on: Sequence[str], on_general: Sequence[str],
                    value: str) -> DataFrame:
    """Value from the specific dimension, else the general one, else NULL, with its provenance."""
    a = specific.select(*on, F.col(value).alias("_a"))
    b = general.select(*on_general, F.col(value).alias("_b"))
    out = df.join(a, list(on), "left").join(b, list(on_general), "left")
    source = F.when(F.col("_a").isNotNull(), "specific").when(F.col("_b").isNotNull(), "general").otherwise("none")
    return out.select(*df.columns, F.coalesce("_a", "_b").alias(value), source.alias(f"{value}_source"))


def positional_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], check: str, tol,
                    slice_by="auto") -> DataFrame:
    """Join the i-th row of both tables per key and say where they disagree: ``row_status`` is ok,
    moved (|difference of check| >= tol), left_only or right_only."""
    l = ordered_scan(left, keys, order, [position("ordinal")], slice_by)
    r = ordered_scan(right, keys, order, [position("ordinal")], slice_by)
    r = r.select(*keys, "ordinal", *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys])
    out = l.withColumn("_l", F.lit(True)).join(r.withColumn("_r", F.lit(True)), [*keys, "ordinal"], "full")
    diff = F.abs(F.col(check) - F.col(f"{check}_r")) >= F.lit(tol)
    status = (F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only")
               .when(diff, "moved").otherwise("ok"))
    return out.withColumn("row_status", status).drop("_l", "_r")


def single_source(rows: DataFrame, session: Sequence[str], source: str) -> tuple[DataFrame, DataFrame]:
    """Sessions with exactly one source file, and the ambiguous rest (none or several)."""
    agg = rows.groupBy(*session).agg(F.count_distinct(source).alias("n_sources"), F.min(source).alias(source))
    return (agg.where("n_sources = 1").drop("n_sources"), agg.where("n_sources <> 1").select(*session, "n_sources"))


def absence_reasons(requested: DataFrame, present: DataFrame, skipped: DataFrame, on: Sequence[str], default: str) -> DataFrame:
    """Requested rows that are not present, with the recorded skip reason or the default one."""
    gone = requested.join(present, list(on), "left_anti")
    why = skipped.groupBy(*on).agg(F.max("reason").alias("reason"))
    return gone.join(why, list(on), "left").withColumn("reason", F.coalesce("reason", F.lit(default)))


def next_day_join(days: DataFrame, outcomes: DataFrame, keys: Sequence[str], day: str, valid: Column, step: int = 1) -> DataFrame:
    """Features of day k with outcomes of day k + step, both valid; missing days break the pair."""
    nxt = outcomes.where(valid).withColumn(day, F.col(day) - step)
    nxt = nxt.select(*keys, day, *[F.col(c).alias(f"{c}_next") for c in outcomes.columns if c not in (*keys, day)])
    return days.where(valid).join(nxt, [*keys, day])


def first_store(stores: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """First store that holds a key wins (columns must match), with its position as ``store``."""
    every = None
    for i, df in enumerate(stores):
        part = df.withColumn("store", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    body = [c for c in every.columns if c not in keys]
    best = every.groupBy(*keys).agg(F.min_by(F.struct(*body), "store").alias("_b"))
    return best.select(*keys, "_b.*")


def last_wins(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last duplicate of every key by ``order`` (aggregated, not sorted)."""
    body = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*body), order).alias("_b")).select(*keys, "_b.*")
