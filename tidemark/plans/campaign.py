"""Labels and zones of a campaign: unit status, excluded files, exclusion zones, channel plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import exclusion_rule
from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators.rangejoin import overlap_join


def unit_status(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Review status from the labels of a unit's events (``is_event, label``)."""
    agg = rows.groupBy(*keys).agg(F.count_if("is_event").alias("n_events"), F.count_if(F.col("is_event") & (F.col("label") == "")).alias("n_unlabelled"))
    n, open_ = F.col("n_events"), F.col("n_unlabelled")
    status = (F.when(n == 0, "no_detections").when(open_ == 0, "reviewed").when(open_ == n, "not_reviewed").otherwise("partial"))
    return agg.withColumn("status", status).withColumn("included", F.col("status").isin("reviewed", "no_detections"))


def assign_group(units: DataFrame, subject: str, controls: Sequence[str], cases: Sequence[str]) -> DataFrame:
    """control / epileptic / unassigned; with an empty case list every other subject is a case."""
    s = F.col(subject)
    is_case = s.isin(*cases) if cases else F.lit(True)
    group = F.when(s.isin(*controls), "control").when(is_case, "epileptic").otherwise("unassigned")
    return units.withColumn("group", group).withColumn("included", F.col("included") & (F.col("group") != "unassigned"))


def excluded_files(parts: Sequence[DataFrame], keys: Sequence[str], spans: DataFrame) -> DataFrame:
    """Files left out, one row each: reasons joined, recorded span attached (``id, kind`` per part)."""
    every = None
    for p in parts:
        p = p.select(*keys, "id", "kind")
        every = p if every is None else every.unionByName(p)
    one = every.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("id")), "/").alias("id"), F.min("kind").alias("kind"))
    return one.join(spans, list(keys), "left")


def zone_table(final: DataFrame, minor: DataFrame, labelled: DataFrame, off_runs: DataFrame, reviewed_off: DataFrame, subject: str,
               slice_by="auto") -> DataFrame:
    """Exclusion zones by rule, numbered by subject, start and rule.

    R1 final events (R7 when their rows carry a comment), minor events, R3-R6 by the comments of false
    positives (R2, transients, is not excluded), R5 runs of disconnections, R8 reviewed disconnections.
    ``labelled`` needs ``event_id, lo, hi, label, comments, in_scope``; it is restricted by the caller to
    usable rows.
    """
    cols = [subject, "rule", "origin", "lo", "hi", "pass_as"]
    as_rows = lambda df, rule, how: df.select(subject, rule.alias("rule"), F.col("event_id").cast("string").alias("origin"), "lo", "hi", F.lit(how).alias("pass_as"))
    named = lambda r: F.lit(r)
    parts = [as_rows(final, F.when(F.col("has_comment"), "R7").otherwise("R1"), "seizures"), as_rows(minor, named("crisette"), "seizures")]
    rule, _ = exclusion_rule(F.col("comments"))
    out_of_scope_tp = ~F.col("in_scope") & F.col("label").isin("TP", "CONFLICT")
    choose = (F.when(out_of_scope_tp, "R1").when(F.col("label") == "", "R6").when(F.col("label") == "FP", rule))
    fp = labelled.where(~F.col("in_scope") | (F.col("label") == "FP")).withColumn("_rule", choose).where("_rule NOT IN ('R2', 'R5')")
    parts += [as_rows(fp, F.col("_rule"), "manual"), as_rows(off_runs, named("R5"), "manual"), as_rows(reviewed_off, named("R8"), "manual")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ev.numbered(every.select(*cols), [subject], ["lo", "rule", "origin", "pass_as"], "zone_id", slice_by)


def transients_kept(labelled: DataFrame) -> DataFrame:
    """False positives that are transients (R2): counted, never excluded."""
    return labelled.where((F.col("label") == "FP") & (exclusion_rule(F.col("comments"))[0] == "R2"))


def channel_zones(zones: DataFrame, channels: DataFrame, subject: str, buffer) -> DataFrame:
    """Zones that meet a channel's span once seizure zones are widened, in time from the channel's start."""
    pad = F.when(F.col("pass_as") == "seizures", F.lit(buffer)).otherwise(F.lit(buffer) * 0)
    z = zones.select(subject, "zone_id", "rule", "pass_as", (F.col("lo") - pad).alias("z_lo"), (F.col("hi") + pad).alias("z_hi"))
    met = overlap_join(z, channels.select(subject, "channel_id", "start", "stop"), [subject], l_lo="z_lo", l_hi="z_hi", r_lo="start", r_hi="stop", strict=True)
    return met.select(subject, "channel_id", "zone_id", "rule", "pass_as", (F.col("z_lo") - F.col("start")).alias("lo"), (F.col("z_hi") - F.col("start")).alias("hi"))


def channel_plan(channels: DataFrame, zones: DataFrame, gaps: DataFrame, excluded: DataFrame, subject: str, file: str, in_scope: Column,
                 slice_by="auto") -> DataFrame:
    """Per channel: run or why not, number of zones, excluded and expected analysed time."""
    key = ["channel_id"]
    inside = zones.join(channels.select("channel_id", (F.col("stop") - F.col("start")).alias("_dur")), key).select(
        *key, F.greatest("lo", F.col("lo") * 0).alias("lo"), F.least("hi", "_dur").alias("hi"))
    off = iv.total_length(inside, key, "excluded", slice_by)
    lost = iv.total_length(inside.unionByName(gaps.select(*key, "lo", "hi")), key, "_lost", slice_by)
    n = zones.groupBy(*key).agg(F.count_if(F.col("pass_as") == "seizures").alias("n_zones_seizures"), F.count_if(F.col("pass_as") == "manual").alias("n_zones_manual"))
    out = channels.join(off, key, "left").join(lost, key, "left").join(n, key, "left").na.fill(0, ["excluded", "_lost", "n_zones_seizures", "n_zones_manual"])
    out = out.join(excluded.select(subject, file, F.col("id").alias("_x")), [subject, file], "left")
    reason = F.when(F.col("_x").isNotNull(), F.concat(F.lit("file excluded: "), F.col("_x"))).when(~in_scope, "unit out of scope").otherwise("")
    return out.withColumns({"not_run_reason": reason, "run": reason == "", "expected": F.col("stop") - F.col("start") - F.col("_lost")}).drop("_x", "_lost")


def rule_summary(zones: DataFrame, channels: DataFrame, slice_by="auto") -> DataFrame:
    """Zones and excluded time per rule, and TOTAL over the union of all rules."""
    z = zones.withColumn("rule", F.explode(F.array("rule", F.lit("TOTAL"))))
    span = channels.select("channel_id", (F.col("stop") - F.col("start")).alias("_dur"))
    inside = z.join(span, "channel_id").select("rule", "channel_id", F.greatest("lo", F.col("lo") * 0).alias("lo"), F.least("hi", "_dur").alias("hi"))
    length = iv.total_length(inside, ["rule", "channel_id"], "len", slice_by).groupBy("rule").agg(F.sum("len").alias("excluded"))
    return z.groupBy("rule").agg(F.count(F.lit(1)).alias("n_zones")).join(length, "rule", "left").na.fill(0, ["excluded"])


def scenarios(rows: DataFrame, names: Sequence[str], label_of) -> DataFrame:
    """Alternative labels side by side: every row once per scenario, its comment chosen by
    ``label_of(scenario name) -> Column``; all planning then keys on ``scenario``."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), label_of(n).alias("comments")) for n in names])).alias("_s")
    body = [c for c in rows.columns if c != "comments"]
    return rows.select(*body, each).select(*body, "_s.*")


def reclassify_video(events: DataFrame, off: DataFrame, recording: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """Source of events seen on video: inside the recording, or beyond it but in a reviewed off-time;
    anything else is a violation."""
    x = iv.overlap_length(events, recording, keys, "_rec", slice_by=slice_by)
    x = iv.overlap_length(x, off, keys, "_off", slice_by=slice_by)
    full = F.col("_off") >= F.col("hi") - F.col("lo")
    source = (F.when(F.col("_rec") > 0, "video_in_eeg").when(full, "video_beyond_eeg").otherwise("violation"))
    is_video = F.col("source") == "video"
    return x.withColumn("source", F.when(is_video, source).otherwise(F.col("source"))).drop("_rec", "_off")
