"""Event construction on point and interval tables.

Times may be seconds (DOUBLE) or microseconds (BIGINT); limits are given in the same unit.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals as iv
from tidemark.operators.components import connected_components
from tidemark.operators.islands import islands
from tidemark.operators.rangejoin import overlap_join
from tidemark.operators.scan import (lag, last_known, lead, next_known, ordered_scan, position,
                                     running_max, running_sum)
from tidemark.session import durable, settle


# ---------------------------------------------------------------- spikes, complexes, bursts

def complexes(peaks: DataFrame, keys: Sequence[str], t: str, amplitude: str, gap, slice_by="auto") -> DataFrame:
    """Spikes closer than or exactly ``gap`` apart form one complex; two or more spikes make it poly."""
    pts = peaks.select(*keys, F.col(t).alias("start"), F.col(t).alias("end"), F.col(amplitude).alias("_a"))
    out = islands(pts, keys, "start", "end", gap=gap, slice_by=slice_by, measures={
        "n_spikes": ("count", "start"), "max_amplitude": ("max", "_a"), "_sum": ("sum", "_a")})
    return (out.withColumn("mean_amplitude", F.col("_sum") / F.col("n_spikes")).drop("_sum")
               .withColumn("classification", F.when(F.col("n_spikes") >= 2, "polyspike").otherwise("single")))


def bursts(cx: DataFrame, keys: Sequence[str], gap, min_n: int, min_len, max_len, slice_by="auto") -> DataFrame:
    """Complexes whose starts are at most ``gap`` apart; a burst ends at its last complex START and is
    kept when n > min_n and min_len < duration < max_len (all strict)."""
    pts = cx.select(*keys, F.col("start").alias("lo"), F.col("start").alias("hi"))
    out = islands(pts, keys, "lo", "hi", gap=gap, measures={"n_complexes": ("count", "lo")}, slice_by=slice_by)
    length = F.col("hi") - F.col("lo")
    return out.where((F.col("n_complexes") > min_n) & (length > F.lit(min_len)) & (length < F.lit(max_len)))


def burst_membership(cx: DataFrame, bs: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """Start of the burst holding each complex start (inclusive), NULL outside bursts."""
    spans = bs.withColumn("_b", F.col("lo"))
    return iv.holder_of(cx, spans, keys, "start", "_b", "burst_start", slice_by)


def rate_summary(cx: DataFrame, bs: DataFrame, exposure: DataFrame, keys: Sequence[str], minutes: str) -> DataFrame:
    """Counts and rates per analysed minute, for every key that has exposure."""
    keys = list(keys)
    poly = F.col("classification") == "polyspike"
    c = cx.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_complexes"), F.count_if(poly).alias("n_poly"),
        F.sum("n_spikes").alias("n_spikes"), F.avg(F.when(poly, F.col("n_spikes"))).alias("spikes_per_poly"))
    b = bs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bursts"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    out = exposure.join(c, keys, "left").join(b, keys, "left").select(
        *keys, minutes, zero("n_complexes"), zero("n_poly"), zero("n_spikes"), zero("n_bursts"), "spikes_per_poly")
    per_min = lambda n: F.try_divide(F.col(n), F.col(minutes))
    return out.withColumns({
        "complexes_per_min": per_min("n_complexes"), "spikes_per_min": per_min("n_spikes"),
        "bursts_per_h": per_min("n_bursts") * 60,
        "pct_poly": 100 * F.col("n_poly") / F.greatest(F.col("n_complexes"), F.lit(1))})


# ---------------------------------------------------------------- runs

def threshold_runs(samples: DataFrame, keys: Sequence[str], n: str, above: Column, slice_by="auto") -> DataFrame:
    """Runs of consecutive samples with ``above`` true: ``keys, first_n, last_n, n_samples``."""
    pts = samples.where(above).select(*keys, F.col(n).alias("first_n"), F.col(n).alias("last_n"))
    return islands(pts, keys, "first_n", "last_n", gap=1, slice_by=slice_by,
                   measures={"n_samples": ("count", "first_n")})


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, slice_by="auto") -> DataFrame:
    """Chronological ids 1..n per key."""
    return ordered_scan(df, keys, order, [position(out)], slice_by)


def bounded_merge(runs: DataFrame, keys: Sequence[str], lo: str, hi: str, gap, max_span,
                  slice_by="auto") -> DataFrame:
    """Greedy left-to-right merge: the next run joins while it starts within ``gap`` of the current end
    and the merged span stays within ``max_span``; one long run is never cut.

    Runs must be disjoint and ordered.  Chains (runs linked by ``gap``) are found first; a chain that fits ``max_span``
    altogether, or is a single run, is one piece.  In the others "first run that does not fit" pointers are followed from
    the first run, doubled each round, so no chain - however long - is walked by one task.
    """
    keys = list(keys)
    base = runs.select(*keys, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    chained = ordered_scan(base, keys, ["_lo", "_hi"], [running_max("_reach", "_hi")], slice_by)
    opens = F.coalesce(F.col("_lo") - F.col("_reach") > F.lit(gap), F.lit(True))
    chained = settle(ordered_scan(chained.withColumn("_open", opens), keys, ["_lo", "_hi"],
                                 [last_known("_chain", F.when(F.col("_open"), F.col("_lo")))], slice_by))
    group = keys + ["_chain"]
    spans = chained.groupBy(*group).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    spans = durable(spans.withColumn("_whole", (F.col("_n") == 1) | (F.col("_hi") - F.col("_lo") <= F.lit(max_span))))
    done = spans.where("_whole").select(*keys, F.col("_lo").alias(lo), F.col("_hi").alias(hi))
    left = spans.where("NOT _whole").select(*group)
    if left.isEmpty():
        return done
    rest = durable(chained.drop("_reach").join(left, group, "left_semi"))
    return done.unionByName(_merge_by_pointers(rest, keys, lo, hi, max_span, slice_by))


def _merge_by_pointers(rows: DataFrame, keys: list[str], lo: str, hi: str, max_span, slice_by) -> DataFrame:
    group = keys + ["_chain"]
    runs = rows.select(*group, F.col("_lo").alias("_t"), F.lit(1).alias("_o"), "_lo", "_hi", F.lit(False).alias("_ask"))
    # the first later run whose end lies past start + max_span opens the next piece
    by_end = runs.withColumn("_t", F.col("_hi"))
    asks = runs.select(*group, (F.col("_lo") + F.lit(max_span)).alias("_t"), F.lit(2).alias("_o"), "_lo", "_hi",
                       F.lit(True).alias("_ask"))
    walked = ordered_scan(by_end.unionByName(asks), group, ["_t", "_o", "_lo"],
                          [next_known("_next", F.when(~F.col("_ask"), F.col("_lo")))], slice_by)
    walked = walked.where("_ask")
    # a single run longer than the limit would point at itself: take the run after it
    after = ordered_scan(rows.select(*group, "_lo", "_hi"), group, ["_lo"], [lead("_after", "_lo")], slice_by)
    jump = (walked.select(*group, "_lo", "_next").join(after, [*group, "_lo"])
                  .select(*group, "_lo", F.when(F.col("_next") > F.col("_lo"), F.col("_next"))
                          .when(F.col("_next") == F.col("_lo"), F.col("_after")).alias("_to")))
    heads = durable(rows.where("_open").select(*group, "_lo"))
    jump = durable(jump)
    seen = -1
    while True:
        hop = heads.join(jump.where("_to IS NOT NULL"), [*group, "_lo"]).select(*group, F.col("_to").alias("_lo"))
        heads = durable(heads.union(hop).distinct())
        now = heads.count()
        if now == seen:
            break
        seen = now
        further = jump.select(*group, F.col("_lo").alias("_to"), F.col("_to").alias("_to2"))
        jump = durable(jump.where("_to IS NOT NULL").join(further, [*group, "_to"], "left")
                           .select(*group, "_lo", F.col("_to2").alias("_to")))
    starts = heads.withColumn("_head", F.lit(True))
    owned = ordered_scan(rows.select(*group, "_lo", "_hi").join(starts, [*group, "_lo"], "left"), group, ["_lo"],
                         [last_known("_piece", F.when(F.col("_head"), F.col("_lo")))], slice_by)
    return (owned.groupBy(*group, "_piece").agg(F.min("_lo").alias(lo), F.max("_hi").alias(hi)).select(*keys, lo, hi))


def disconnect_runs(events: DataFrame, keys: Sequence[str], is_off: Column, gap, slice_by="auto") -> DataFrame:
    """Spans of consecutive off-events (no other event between) within ``gap`` of the running end."""
    keys = list(keys)
    flagged = events.withColumn("_off", is_off)
    seen = ordered_scan(flagged, keys, ["lo", "event_id"],
                        [running_sum("_others", (~F.col("_off")).cast("long"))], slice_by)
    return islands(seen.where("_off"), [*keys, "_others"], "lo", "hi", gap=gap, slice_by=slice_by,
                   measures={"n_events": ("count", "lo")}).drop("_others")


def hysteresis(samples: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, enter, leave,
               out: str = "active", slice_by="auto") -> DataFrame:
    """State hold: on above ``enter``, off at or below ``leave``, otherwise the last decisive state."""
    v = F.col(value)
    decisive = F.when(v > enter, F.lit(True)).when(v <= leave, F.lit(False))
    held = ordered_scan(samples, keys, order, [last_known(out, decisive)], slice_by)
    return held.withColumn(out, F.coalesce(F.col(out), F.lit(False)))


# ---------------------------------------------------------------- zones

def exclusion_zones(parts: Sequence[tuple[str, DataFrame, object]], keys: Sequence[str],
                    recording: DataFrame) -> DataFrame:
    """Union of zone sources, each widened by its buffer, clamped to the recording span
    (``keys, rec_lo, rec_hi``); zones left without length are dropped."""
    rows = None
    for reason, df, buffer in parts:
        part = df.select(*keys, F.lit(reason).alias("reason"), (F.col("lo") - F.lit(buffer)).alias("lo"),
                         (F.col("hi") + F.lit(buffer)).alias("hi"))
        rows = part if rows is None else rows.unionByName(part)
    clamped = rows.join(recording, list(keys)).select(
        *keys, "reason", F.greatest("lo", "rec_lo").alias("lo"), F.least("hi", "rec_hi").alias("hi"))
    return clamped.where("hi > lo")


def peri_zones(events: DataFrame, keys: Sequence[str], configs: Sequence[tuple[str, int]], unit) -> DataFrame:
    """One zone per event and configuration (side, W): none, both, pre or post by W units."""
    conf = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(w).alias("w")) for s, w in configs]))
    x = events.select(*keys, "lo", "hi", conf.alias("c")).select(*keys, "lo", "hi", "c.side", "c.w")
    before = F.when(F.col("side").isin("both", "pre"), F.col("w") * F.lit(unit)).otherwise(F.lit(0))
    after = F.when(F.col("side").isin("both", "post"), F.col("w") * F.lit(unit)).otherwise(F.lit(0))
    return x.select(*keys, "side", "w", (F.col("lo") - before).alias("lo"), (F.col("hi") + after).alias("hi"))


def near_gap(events: DataFrame, gap_rows: DataFrame, keys: Sequence[str], tol, slice_by="auto") -> DataFrame:
    """Flag events whose start or end lies within ``tol`` of any gap start or end: each end looks up the
    nearest gap edges before and after it."""
    edges = gap_rows.select(*keys, F.explode(F.array("lo", "hi")).alias("_t"), F.lit(0).alias("_o")).withColumn("_e", F.col("_t"))
    asks = events.select(*keys, "event_id", F.explode(F.array("lo", "hi")).alias("_t"), F.lit(1).alias("_o"))
    near = ordered_scan(edges.unionByName(asks, allowMissingColumns=True), keys, ["_t", "_o"],
                        [last_known("_p", "_e"), next_known("_n", "_e")], slice_by)
    # an end at the same instant as an edge comes after it
    hit = ((F.col("_t") - F.col("_p")) <= F.lit(tol)) | ((F.col("_n") - F.col("_t")) <= F.lit(tol))
    flag = (near.where("event_id IS NOT NULL").groupBy(*keys, "event_id")
                .agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("adjacent_to_gap")))
    return events.join(flag, [*keys, "event_id"])


# ---------------------------------------------------------------- clusters, intervals between events

def cluster_counts(points: DataFrame, keys: Sequence[str], t: str, gaps: Mapping[int, int],
                   slice_by="auto") -> DataFrame:
    """Clusters (a gap over the limit opens a new one) per key and limit: count and largest size."""
    keys = list(keys)
    x = ordered_scan(points.select(*keys, t), keys, [t], [lag("_p", t)], slice_by)
    opens = lambda g: F.coalesce(F.col(t) - F.col("_p") > F.lit(g), F.lit(True)).cast("long")
    lab = ordered_scan(x, keys, [t], [running_sum(f"_c{k}", opens(g)) for k, g in gaps.items()], slice_by)
    lab = lab.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("gap_h"), F.col(f"_c{k}").alias("_c")) for k in gaps])))
    sizes = lab.groupBy(*keys, "gap_h", "_c").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("gap_h", *keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.max("n").alias("largest"))


def observed_intervals(starts: DataFrame, observed: DataFrame, keys: Sequence[str], t: str,
                       fraction: float = 0.95, slice_by="auto", normalised: bool = False) -> DataFrame:
    """Start-to-start intervals kept when at least ``fraction`` of them was observed."""
    at = iv.covered_before(starts, observed, keys, t, "_cov", slice_by, normalised)
    x = ordered_scan(at, keys, [t], [lag("_t0", t), lag("_c0", "_cov")], slice_by)
    x = x.withColumn("isi", F.col(t) - F.col("_t0"))
    return x.where((F.col("isi") > 0) & (F.col("_cov") - F.col("_c0") >= F.lit(fraction) * F.col("isi"))).drop("_cov", "_t0", "_c0")


def lead_events(events: DataFrame, observed: DataFrame, keys: Sequence[str], quiet, fraction: float,
                slice_by="auto") -> DataFrame:
    """Flag events with no other event in the ``quiet`` span before them and enough observation of it.

    Another event meets the span iff it starts before this start and ends after the span begins; that is
    a running maximum of ends over earlier starts, so no pairs are formed.
    """
    x = ordered_scan(events, keys, ["lo", "event_id"], [running_max("_reach", "hi")], slice_by)
    # an event with the same start is not "before" it
    same = ordered_scan(x, keys, ["lo", "event_id"], [lag("_plo", "lo")], slice_by)
    x = same.withColumn("_first", F.when(F.col("_plo").isNull() | (F.col("_plo") < F.col("lo")), F.struct("_reach")))
    x = ordered_scan(x, keys, ["lo", "event_id"], [last_known("_r", "_first")], slice_by)
    x = x.withColumn("_from", F.col("lo") - F.lit(quiet))
    cover = iv.union(observed, keys, slice_by)
    x = iv.covered_before(x, cover, keys, "lo", "_c1", slice_by, normalised=True)
    x = iv.covered_before(x, cover, keys, "_from", "_c0", slice_by, normalised=True)
    quiet_ok = ~F.coalesce(F.col("_r._reach") > F.col("_from"), F.lit(False))
    enough = F.col("_c1") - F.col("_c0") >= F.lit(fraction) * F.lit(quiet)
    return x.withColumn("is_lead", quiet_ok & enough).select(*events.columns, "is_lead")


# ---------------------------------------------------------------- grouping across channels

def contact_edges(rows: DataFrame, keys: Sequence[str], channel: str, tol, slice_by="auto") -> DataFrame:
    """Sparse edges whose components equal those of "different channel and gap < tol".

    Instead of every touching pair, a row links (1) at its start to the earlier row of each other channel
    that reaches furthest, and (2) to the last row of each other channel that starts before its end + tol.
    By induction over decreasing ends these 2 x (channels - 1) edges per row connect the same rows.
    Needs ``event_id, lo, hi``.
    """
    keys = list(keys)
    box = rows.select(*keys, F.col(channel).alias("_ch"), "event_id", "lo", "hi")
    others = box.select(*keys, F.col("_ch").alias("_r")).distinct()
    lane = keys + ["_r"]
    data = box.select(*keys, F.col("_ch").alias("_r"), F.col("lo").alias("_t"), F.lit(0).alias("_o"), "event_id", "lo", "hi")
    cross = box.join(others, keys).where("_ch <> _r")
    ask = lambda kind, t, o: cross.select(*lane, t.alias("_t"), F.lit(o).alias("_o"), "event_id", "lo", "hi",
                                          F.lit(kind).alias("_k"))
    asks = ask(1, F.col("lo"), 0).unionByName(ask(2, F.col("hi") + F.lit(tol), -1))
    is_row = F.col("_k").isNull()
    walked = ordered_scan(data.unionByName(asks, allowMissingColumns=True), lane, ["_t", "_o", "event_id"],
                          [running_max("_best", F.when(is_row, F.struct("hi", "event_id")), inclusive=True),
                           last_known("_last", F.when(is_row, F.struct("lo", "event_id")))], slice_by)
    holder = walked.where((F.col("_k") == 1) & (F.col("_best.hi") > F.col("lo") - F.lit(tol))).select(
        F.col("event_id").alias("u"), F.col("_best.event_id").alias("v"))
    latest = walked.where((F.col("_k") == 2) & (F.col("_last") > F.struct("lo", "event_id"))).select(
        F.col("event_id").alias("u"), F.col("_last.event_id").alias("v"))
    return holder.union(latest)


def group_across_channels(rows: DataFrame, keys: Sequence[str], channel: str, tol, slice_by="auto") -> DataFrame:
    """Add ``group_id`` (1..n per session by start, end), ``ref_lo, ref_hi`` and ``fragmented``.

    Rows of one channel share a group only through another channel.
    """
    keys = list(keys)
    roots = connected_components(contact_edges(rows, keys, channel, tol, slice_by))
    tagged = (rows.join(roots.withColumnRenamed("node", "event_id"), "event_id", "left")
                  .withColumn("_root", F.coalesce("root", "event_id")).drop("root"))
    tagged = settle(tagged)
    spans = tagged.groupBy(*keys, "_root").agg(F.min("lo").alias("ref_lo"), F.max("hi").alias("ref_hi"))
    ids = numbered(spans, keys, ["ref_lo", "ref_hi", "_root"], "group_id", slice_by)
    copies = tagged.groupBy(*keys, "_root", channel).agg((F.count(F.lit(1)) > 1).alias("fragmented"))
    return (tagged.join(ids, [*keys, "_root"]).join(copies, [*keys, "_root", channel]).drop("_root"))


def categorise(grouped: DataFrame, keys: Sequence[str], channel: str, status: str) -> DataFrame:
    """Category by the number of channels with an accepted row, plus in-band and channel counts."""
    group = [*keys, "group_id"]
    acc = F.when(F.col(status) == "accepted", F.col(channel))
    band = F.when(F.col(status) == "in_band", F.col(channel))
    agg = grouped.groupBy(*group).agg(
        F.collect_set(acc).alias("_a"), F.collect_set(band).alias("_b"),
        F.count_distinct(channel).alias("n_channels_in_group"))
    n = F.size("_a")
    out = agg.select(*group, "n_channels_in_group", n.cast("long").alias("n_accepted"),
                     F.size(F.array_except("_b", "_a")).cast("long").alias("n_in_band"),
                     F.array_join(F.array_sort("_a"), ";").alias("accepted_in_regions"),
                     F.when(n >= 2, "Crisis").when(n == 1, "Candidates").otherwise("Candidates_in_band").alias("category"))
    return grouped.join(out, group)


def reconcile(accepted: DataFrame, rejected: DataFrame, channels: DataFrame, keys: Sequence[str], channel: str,
              tol, blocks: DataFrame | None = None, failed: DataFrame | None = None, impute: bool = True,
              slice_by="auto") -> DataFrame:
    """Agree on events across the channels of a session.

    Accepted rows are grouped; a channel without an accepted row of an event takes its best rejected
    candidate near it (``rescued``), else the event's own window clipped to the valid block that overlaps
    it most (``imputed``).  Failed channels are imputed without metrics.
    Rows need ``event_id, lo, hi, score``; ``channels`` and ``failed`` are ``keys + channel``; ``blocks`` is
    ``keys + channel + block_id, b_lo, b_hi``.
    """
    keys = list(keys)
    acc = settle(group_across_channels(accepted, keys, channel, tol, slice_by))
    n_failed = F.lit(0)
    sizes = channels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if failed is not None:
        lost = failed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_f"))
        sizes, n_failed = sizes.join(lost, keys, "left"), F.coalesce("_f", F.lit(0))
    sizes = sizes.select(*keys, (F.col("_n") + n_failed).alias("n_channels_total"))
    event = [*keys, "group_id"]
    info = acc.groupBy(*event).agg(
        F.min("ref_lo").alias("ref_lo"), F.max("ref_hi").alias("ref_hi"),
        F.count_distinct(channel).alias("accepted_in_n_channels"),
        F.array_join(F.array_sort(F.collect_set(channel)), ";").alias("accepted_in_regions"))

    info = settle(info)
    taken = acc.select(*event, channel).distinct()
    open_slots = info.join(channels, keys).join(taken, [*event, channel], "left_anti")
    # candidate -> closest event (ties: earliest), then best score per open (event, channel)
    near = overlap_join(rejected.select(*keys, channel, "event_id", "lo", "hi", "score"),
                        info.select(*keys, "group_id", "ref_lo", "ref_hi"), keys, l_lo="lo", l_hi="hi",
                        r_lo="ref_lo", r_hi="ref_hi", tol=tol, strict=True)
    gap = F.greatest("lo", "ref_lo") - F.least("hi", "ref_hi")
    chosen = (near.groupBy(*keys, channel, "event_id")
                  .agg(F.min(F.struct(gap.alias("g"), F.col("group_id").alias("group_id"))).alias("_m"),
                       F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("score").alias("score"))
                  .withColumn("group_id", F.col("_m.group_id")))
    rank = F.struct(F.coalesce("score", F.lit(float("-inf"))).alias("s"), (-F.col("event_id")).alias("e"))
    best = chosen.groupBy(*event, channel).agg(F.max_by(F.struct("event_id", "lo", "hi", "score"), rank).alias("_c"))
    slots = open_slots.join(best, [*event, channel], "left")

    cols = [*event, channel, "event_id", "lo", "hi", "score", "detection_status", "rejected_by", "fragmented"]
    none = lambda t: F.lit(None).cast(t)
    parts = acc.select(*event, channel, "event_id", "lo", "hi", "score", F.lit("accepted").alias("detection_status"),
                       F.lit("").alias("rejected_by"), "fragmented")
    parts = parts.unionByName(slots.where("_c IS NOT NULL").select(
        *event, channel, "_c.*", F.lit("rescued").alias("detection_status"), F.lit("ll_ratio").alias("rejected_by"),
        F.lit(False).alias("fragmented")).select(*cols))
    if impute:
        empty = slots.where("_c IS NULL").select(*event, channel, "ref_lo", "ref_hi")
        if blocks is None:
            clipped = empty.select(*event, channel, F.col("ref_lo").alias("lo"), F.col("ref_hi").alias("hi"),
                                   F.lit("no_candidate").alias("rejected_by"))
        else:
            meets = overlap_join(empty, blocks, [*keys, channel], l_lo="ref_lo", l_hi="ref_hi", r_lo="b_lo", r_hi="b_hi")
            cover = F.least("ref_hi", "b_hi") - F.greatest("ref_lo", "b_lo")
            pick = meets.groupBy(*event, channel).agg(
                F.max(F.struct(cover.alias("c"), (-F.col("block_id")).alias("b"), F.col("b_lo"), F.col("b_hi"))).alias("_p"))
            both = empty.join(pick, [*event, channel], "left")
            ok = F.col("_p.c") > 0
            clipped = both.select(
                *event, channel,
                F.when(ok, F.greatest("ref_lo", F.col("_p.b_lo"))).otherwise(F.col("ref_lo")).alias("lo"),
                F.when(ok, F.least("ref_hi", F.col("_p.b_hi"))).otherwise(F.col("ref_hi")).alias("hi"),
                F.when(ok, "no_candidate").otherwise("no_valid_signal").alias("rejected_by"))
        if failed is not None:
            clipped = clipped.unionByName(info.join(failed, keys).select(
                *event, channel, F.col("ref_lo").alias("lo"), F.col("ref_hi").alias("hi"),
                F.lit("detection_failed").alias("rejected_by")))
        parts = parts.unionByName(clipped.select(
            *event, channel, none("bigint").alias("event_id"), "lo", "hi", none("double").alias("score"),
            F.lit("imputed").alias("detection_status"), "rejected_by", F.lit(False).alias("fragmented")))
    return (parts.join(info, event).join(sizes, keys)
                 .withColumn("is_bilateral_accepted", F.col("accepted_in_n_channels") >= 2))


# ---------------------------------------------------------------- labels and final events

def label_events(rows: DataFrame, keys: Sequence[str], event: str, region: str, right: str, left: str) -> DataFrame:
    """One row per labelled event: span, counts, label (CONFLICT when rows disagree), comments, laterality."""
    seen = F.when(F.col("detection_status").isin("accepted", "rescued"), F.col(region))
    out = rows.groupBy(*keys, event).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("n_rows"),
        F.max("score").alias("max_score"), F.collect_set(F.when(F.col("label") != "", F.col("label"))).alias("_l"),
        F.count_if(F.coalesce(F.col("label"), F.lit("")) == "").alias("n_rows_unlabeled"),
        F.collect_set(F.when(F.col("comment") != "", F.col("comment"))).alias("_c"), F.collect_set(seen).alias("_r"))
    has = lambda x: F.array_contains("_r", x)
    return out.select(
        *keys, event, "lo", "hi", "n_rows", "max_score", "n_rows_unlabeled",
        F.when(F.size("_l") == 0, "").when(F.size("_l") == 1, F.element_at("_l", 1)).otherwise("CONFLICT").alias("label"),
        F.array_join(F.array_sort("_c"), ";").alias("comments"),
        F.when(has(right) & has(left), "bilateral").when((F.size("_r") == 1) & has(right), f"{right}_only")
         .when((F.size("_r") == 1) & has(left), f"{left}_only").otherwise("unknown").alias("laterality"))


def manual_merges(events: DataFrame, merges: DataFrame, event: str) -> DataFrame:
    """Listed events become one: the first keeps the joint span, the others point to it.
    ``merges`` is ``(merge_id, event)``."""
    m = events.join(merges, event)
    span = m.groupBy("merge_id").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"),
                                     F.min_by(event, F.struct("lo", event)).alias("_head"))
    out = events.join(merges, event, "left").join(span, "merge_id", "left")
    head = F.col("_head") == F.col(event)
    return out.select(*[c for c in events.columns if c not in ("lo", "hi")],
                      F.when(head, F.col("_lo")).otherwise(F.col("lo")).alias("lo"),
                      F.when(head, F.col("_hi")).otherwise(F.col("hi")).alias("hi"),
                      F.when(~head, F.col("_head")).alias("merged_into"))


def dedupe_overlaps(events: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """Events of one subject that strictly overlap become one; touching ones stay apart."""
    return islands(events, keys, "lo", "hi", gap=0, strict=True, slice_by=slice_by, measures={
        "n_merged": ("count", "lo"), "first_id": ("min", F.struct("lo", "hi", "event_id"))}).withColumn("first_id", F.col("first_id.event_id"))


def origin_of(events: DataFrame, merged: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """The merged event each original belongs to: ids stay rows, however many were joined."""
    heads = merged.select(*keys, F.col("lo").alias("_t"), F.lit(0).alias("_o"), F.col("first_id").alias("_f"))
    rows = events.select(*keys, F.col("lo").alias("_t"), F.lit(1).alias("_o"), "event_id")
    walked = ordered_scan(heads.unionByName(rows, allowMissingColumns=True), keys, ["_t", "_o"], [last_known("merged_into", "_f")], slice_by)
    return walked.where("_o = 1").select(*keys, "event_id", "merged_into")


def add_missed(detected: DataFrame, missed: DataFrame, keys: Sequence[str], slice_by="auto") -> DataFrame:
    """Append missed events that meet no detected one; both need ``event_id, lo, hi, source``.

    Two events meet when each starts before the other ends, so one without length meets those it lies inside: the latest end of all detected
    events that start before a missed one ends is compared with its start."""
    marks = detected.select(*keys, F.col("lo").alias("_t"), F.lit(1).alias("_o"), F.col("hi").alias("_h"))
    asks = missed.select(*keys, F.col("hi").alias("_t"), F.lit(0).alias("_o"), F.struct(*missed.columns).alias("_p"))
    walked = ordered_scan(marks.unionByName(asks, allowMissingColumns=True), keys, ["_t", "_o"], [running_max("_reach", "_h")], slice_by)
    alone = ~F.coalesce(F.col("_reach") > F.col("_p.lo"), F.lit(False))
    return detected.unionByName(walked.where(F.col("_p").isNotNull() & alone).select("_p.*").select(*detected.columns))


def close_pairs(events: DataFrame, keys: Sequence[str], gap, slice_by="auto") -> DataFrame:
    """Neighbouring events separated by less than ``gap`` (listed, not merged)."""
    x = ordered_scan(events, keys, ["lo", "event_id"], [lag("prev_id", "event_id"), lag("_ph", "hi")], slice_by)
    return (x.where(F.col("lo") - F.col("_ph") < F.lit(gap))
             .select(*keys, "prev_id", "event_id", (F.col("lo") - F.col("_ph")).alias("gap")))
