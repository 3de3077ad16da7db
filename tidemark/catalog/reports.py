"""Report tables on event intervals per subject: scopes, sides, decompositions, checks, quality rows, reconciliation with blocks."""

from pyspark.sql import functions as F

from tidemark.catalog.events import RECON, channel_rows
from tidemark.catalog.registry import POINTS, merged, query
from tidemark.catalog.stats import pct
from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.plans import reports as rp
from tidemark.session import durable

USER, H = ["user_id"], 3_600_000_000
US = 1e6


def scoped(t):
    """Points with a campaign and a side."""
    return t.points.withColumns({"campaign": F.concat(F.lit("C"), (F.col("event_id") % 2 + 1).cast("string")), "lo": F.col("t"),
                                 "side": F.element_at(F.array(F.lit("right"), F.lit("left"), F.lit("bilateral")), (F.col("event_id") % 3 + 1).cast("int"))})


BY = "user_id, scope"
SCOPES = f"""sc AS (SELECT *, 'C' || (event_id % 2 + 1) AS campaign, ['right', 'left', 'bilateral'][event_id % 3 + 1] AS side,
 CASE WHEN value <= 20 THEN 'detected' WHEN value <= 30 THEN 'missed' ELSE 'video' END AS source FROM ev),
xx AS (SELECT *, campaign AS scope FROM sc UNION ALL SELECT *, 'merged' FROM sc), x AS (SELECT *, t AS lo FROM xx WHERE event_type = 'purchase'), o0 AS (SELECT * FROM xx WHERE event_type IN ('click', 'view')),
{merged('o', keys=BY, source='o0')}, top AS (SELECT {BY}, max(hi) AS top, sum(hi - lo) / 3.6e9 AS h FROM o GROUP BY {BY}),
s AS (SELECT x.*, EXISTS (SELECT 1 FROM o WHERE o.user_id = x.user_id AND o.scope = x.scope AND x.lo >= o.lo AND x.lo < o.hi) OR coalesce(x.lo = top, false) AS seen FROM x LEFT JOIN top USING ({BY})),
n AS (SELECT {BY}, count(*) FILTER (source = 'detected') AS n_detected, count(*) FILTER (source = 'missed') AS n_missed, count(*) FILTER (source = 'video') AS n_video, count(*) AS n_total, count(*) FILTER (NOT seen) AS n_outside,
 count(*) AS n_sided, round(100 * avg((side = 'bilateral')::INT), 6) AS pct_bilateral, round(100 * avg((side = 'right')::INT), 6) AS pct_right, round(100 * avg((side = 'left')::INT), 6) AS pct_left FROM s GROUP BY {BY}),
d0 AS (SELECT {BY}, (hi - lo) / 1e6 AS v, row_number() OVER (PARTITION BY {BY} ORDER BY hi - lo) AS k, count(*) OVER (PARTITION BY {BY}) AS total FROM x WHERE source <> 'video'),
d AS (SELECT {BY}, min(v) AS duration_s_min, max(v) AS duration_s_max, {pct(50, 'v', 'duration_s_median')}, {pct(25, 'v', 'duration_s_q25')}, {pct(75, 'v', 'duration_s_q75')} FROM d0 GROUP BY {BY}),
cv AS (SELECT {BY}, lo, (SELECT coalesce(sum(greatest(0, least(o.hi, x.lo) - o.lo)), 0) FROM o WHERE o.user_id = x.user_id AND o.scope = x.scope) AS c FROM x),
i0 AS (SELECT {BY}, lo - lag(lo) OVER w AS d, c - lag(c) OVER w AS c FROM cv WINDOW w AS (PARTITION BY {BY} ORDER BY lo)), i1 AS (SELECT {BY}, d / 3.6e9 AS v FROM i0 WHERE d > 0 AND c >= 0.002 * d),
i2 AS (SELECT *, row_number() OVER (PARTITION BY {BY} ORDER BY v) AS k, count(*) OVER (PARTITION BY {BY}) AS total FROM i1),
i AS (SELECT {BY}, count(*) AS n_isi_h, round(stddev_samp(v) / avg(v), 6) AS isi_h_cv, {pct(50, 'v', 'isi_h_median')}, {pct(25, 'v', 'isi_h_q25')}, {pct(75, 'v', 'isi_h_q75')} FROM i2 GROUP BY {BY}),
g0 AS (SELECT {BY}, lo, g, CASE WHEN coalesce(lo - lag(lo) OVER (PARTITION BY {BY}, g ORDER BY lo) > g * {H}, true) THEN 1 ELSE 0 END AS z FROM x, (SELECT unnest([6, 12, 24]) AS g)),
g1 AS (SELECT {BY}, g, sum(z) OVER (PARTITION BY {BY}, g ORDER BY lo ROWS UNBOUNDED PRECEDING) AS c FROM g0), g2 AS (SELECT {BY}, g, c, count(*) AS m FROM g1 GROUP BY ALL),
g AS (SELECT {BY}, count(*) FILTER (g = 6) AS n_clusters_6h, count(*) FILTER (g = 12) AS n_clusters_12h, count(*) FILTER (g = 24) AS n_clusters_24h, max(m) FILTER (g = 24) AS largest_24h FROM g2 GROUP BY {BY}),
y0 AS (SELECT {BY}, lo, hi, unnest(generate_series(CAST(make_timestamp(lo) AS DATE), CAST(make_timestamp(hi) AS DATE), INTERVAL 1 DAY)) AS day FROM o),
y1 AS (SELECT {BY}, CAST(day AS DATE) AS day, sum(greatest(0, least(hi, epoch_us(CAST(day AS TIMESTAMP)) + 24 * {H}) - greatest(lo, epoch_us(CAST(day AS TIMESTAMP))))) AS s FROM y0 GROUP BY ALL HAVING s >= 0.25 * {H}),
y AS (SELECT {BY}, count(*) AS n_valid_days, count(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = y1.user_id AND s.scope = y1.scope AND seen AND CAST(make_timestamp(s.lo) AS DATE) = y1.day)) AS n_free_days FROM y1 GROUP BY {BY})
SELECT {BY}, coalesce(n_detected, 0) AS n_detected, coalesce(n_missed, 0) AS n_missed, coalesce(n_video, 0) AS n_video, coalesce(n_total, 0) AS n_total, coalesce(n_outside, 0) AS n_outside, coalesce(n_sided, 0) AS n_sided,
 pct_bilateral, pct_right, pct_left, round(coalesce(h, 0), 6) AS observed_h, round(duration_s_min, 6) AS duration_s_min, round(duration_s_max, 6) AS duration_s_max, duration_s_median, duration_s_q25, duration_s_q75,
 coalesce(n_isi_h, 0) AS n_isi_h, isi_h_cv, isi_h_median, isi_h_q25, isi_h_q75, coalesce(n_clusters_6h, 0) AS n_clusters_6h, coalesce(n_clusters_12h, 0) AS n_clusters_12h, coalesce(n_clusters_24h, 0) AS n_clusters_24h, largest_24h,
 coalesce(n_valid_days, 0) AS n_valid_days, coalesce(n_free_days, 0) AS n_free_days, round(24 * (coalesce(n_total, 0) - coalesce(n_outside, 0)) / nullif(coalesce(h, 0), 0), 6) AS rate_per_24h
FROM n FULL JOIN top USING ({BY}) LEFT JOIN d USING ({BY}) LEFT JOIN i USING ({BY}) LEFT JOIN g USING ({BY}) LEFT JOIN y USING ({BY})"""


@query("AGG-09 EVT-25", f"WITH {POINTS}, {SCOPES}")
def scope_statistics(t):
    """Events of every subject in both campaigns and in all: counts, rates, durations, intervals, clusters, days and sides."""
    s = scoped(t)
    e = s.where("event_type = 'purchase'").withColumn("source", F.when(F.col("value") <= 20, "detected").when(F.col("value") <= 30, "missed").otherwise("video"))
    out = rp.scope_statistics(e, s.where("event_type IN ('click', 'view')"), USER, "campaign", unit=US, valid_h=0.25, share=0.002,
                              sides={"bilateral": "bilateral", "right": "right", "left": "left"})
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


SIDES = f"""p0 AS (SELECT *, 'C' || (event_id % 2 + 1) AS campaign, event_type AS own FROM ev WHERE event_type IN ('click', 'view')),
p1 AS (SELECT *, campaign AS scope FROM p0 UNION ALL SELECT *, 'merged' FROM p0), {merged('u', keys='user_id, scope, own', source='p1')},
c0 AS (SELECT *, unnest(generate_series(CAST(make_timestamp(lo) AS DATE), CAST(make_timestamp(hi) AS DATE), INTERVAL 1 DAY)) AS day FROM u),
c1 AS (SELECT user_id, scope, own, CASE WHEN a = 480 THEN 'light' ELSE 'dark' END AS phase, greatest(0, least(hi, epoch_us(CAST(day AS TIMESTAMP)) + b * 60000000) - greatest(lo, epoch_us(CAST(day AS TIMESTAMP)) + a * 60000000)) AS s
 FROM c0, (SELECT a::BIGINT AS a, b::BIGINT AS b FROM (VALUES (0, 480), (480, 1170), (1170, 1440)) AS v(a, b))),
tm AS (SELECT user_id, scope, side, phase, sum(s) / 6e7 AS minutes FROM (SELECT *, own AS side FROM c1 UNION ALL SELECT *, 'both' FROM c1) WHERE s > 0 GROUP BY ALL),
nn AS (SELECT user_id, scope, side, CASE WHEN m >= 480 AND m < 1170 THEN 'light' ELSE 'dark' END AS phase, count(*) AS n, count(*) FILTER (value > 15) AS n_poly, count(*) FILTER (value > 40) AS n_bursts
 FROM (SELECT *, hour(ts) * 60 + minute(ts) AS m, own AS side FROM p1 UNION ALL SELECT *, hour(ts) * 60 + minute(ts), 'both' FROM p1) GROUP BY ALL),
ph AS (SELECT user_id, scope, side, phase, coalesce(n, 0) AS n, coalesce(n_poly, 0) AS n_poly, coalesce(n_bursts, 0) AS n_bursts, coalesce(minutes, 0) AS minutes FROM nn FULL JOIN tm USING (user_id, scope, side, phase)),
ra AS (SELECT * FROM ph UNION ALL SELECT user_id, scope, side, 'all', sum(n), sum(n_poly), sum(n_bursts), sum(minutes) FROM ph GROUP BY ALL)"""


#: Equal spans of a subject once, so that no merge depends on the order they come in.
SIDES_ONCE = SIDES.replace("FROM p1 WHERE hi > t", "FROM (SELECT DISTINCT user_id, scope, own, t, hi FROM p1) WHERE hi > t")


def side_tables(t):
    s = scoped(t).where("event_type IN ('click', 'view')").withColumns({"side": F.col("event_type"), "poly": F.col("value") > 15, "burst": F.col("value") > 40})
    return rp.side_statistics(s, s, USER, "campaign", "side", lambda b: F.when(b == 1, "light").otherwise("dark"), unit=US, tz="UTC", edges_min=[0, 480, 1170, 1440], right="click", left="view")


@query("AGG-13 AGG-20", f"WITH {POINTS}, {SIDES} SELECT user_id, scope, side, phase, CAST(n AS BIGINT) AS n, CAST(n_poly AS BIGINT) AS n_poly, CAST(n_bursts AS BIGINT) AS n_bursts, round(minutes, 6) AS minutes, "
       "round(n / nullif(minutes, 0), 6) AS per_min, round(100 * n_poly / nullif(n, 0), 6) AS pct_poly, round(60 * n_bursts / nullif(minutes, 0), 6) AS bursts_per_h FROM ra")
def side_rates(t):
    """Counts, analysed time and rates for every scope, side (and both) and phase of the day from one cut of the time."""
    out = side_tables(t)[0]
    return out.withColumns({c: F.round(c, 6) for c in ("minutes", "per_min", "pct_poly", "bursts_per_h")})


@query("AGG-13", f"WITH {POINTS}, {SIDES_ONCE}, w AS (SELECT user_id, scope, max(n / minutes) FILTER (side = 'click') AS r, max(n / minutes) FILTER (side = 'view') AS l FROM ra WHERE phase = 'all' AND side <> 'both' GROUP BY ALL) "
       "SELECT user_id, scope, round(r, 6) AS click, round(l, 6) AS view, round((r - l) / (r + l), 6) AS asymmetry FROM w")
def scope_asymmetry(t):
    """Asymmetry of the two sides' rates in every scope."""
    return side_tables(t)[1].withColumns({c: F.round(c, 6) for c in ("click", "view", "asymmetry")})


@query("AGG-14", f"WITH {POINTS}, {merged('z', "event_type = 'error'")}, {merged('g', "event_type = 'signup'")}, " + """
b AS (SELECT user_id, count(*) AS n, 700.0 AS m FROM ev WHERE event_type = 'click' AND value > 5 GROUP BY 1), a AS (SELECT user_id, count(*) AS n, 650.0 AS m FROM ev WHERE event_type = 'click' AND value > 8 GROUP BY 1),
l AS (SELECT e.user_id, count(*) AS n FROM ev e WHERE event_type = 'click' AND value > 5 AND EXISTS (SELECT 1 FROM z WHERE z.user_id = e.user_id AND e.t BETWEEN z.lo AND z.hi) GROUP BY 1),
w AS (SELECT e.user_id, count(*) AS n FROM ev e WHERE event_type = 'click' AND value > 8 AND EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id AND e.t BETWEEN g.lo AND g.hi) GROUP BY 1),
j AS (SELECT user_id, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, coalesce(l.n, 0) AS a_lost, coalesce(w.n, 0) AS b_gained, b.m AS mb, a.m AS ma FROM b FULL JOIN a USING (user_id) LEFT JOIN l USING (user_id) LEFT JOIN w USING (user_id))
SELECT user_id, n_before, n_after, a_lost, b_gained, n_after - n_before AS delta, n_after - n_before + a_lost - b_gained AS c_rest, round(n_before / mb, 9) AS per_min_before, round(n_after / ma, 9) AS per_min_after,
 round(n_after / ma - n_before / mb, 9) AS delta_per_min, round(100 * (n_after / ma - n_before / mb) / nullif(n_before / mb, 0), 6) AS delta_pct FROM j""")
def before_after(t):
    """Change of each subject's count between two runs, split into excluded time, new windows and the rest."""
    p = t.points.where("event_type = 'click'").select("event_id", "user_id", "t", "value")
    old, new = p.where("value > 5"), p.where("value > 8")
    count = lambda d, m: d.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).withColumn("minutes", F.lit(m))
    out = rp.decomposition(count(old, 700.0), count(new, 650.0), old, new, t.spans("error"), t.spans("signup"), USER)
    return out.drop("minutes_before", "minutes_after").withColumns({**{c: F.round(c, 9) for c in ("per_min_before", "per_min_after", "delta_per_min")}, "delta_pct": F.round("delta_pct", 6)})


GRID = [("none", 0), *[(s, w) for s in ("both", "pre", "post") for w in (6, 24)]]


@query("CHK-06", f"""WITH {POINTS}, c AS (SELECT * FROM (VALUES {', '.join(map(str, GRID))}) AS v(side, w)),
p0 AS (SELECT user_id, side, w, t - CASE WHEN side IN ('both', 'pre') THEN w * {H} ELSE 0 END AS t, hi + CASE WHEN side IN ('both', 'post') THEN w * {H} ELSE 0 END AS hi FROM ev, c WHERE event_type = 'purchase'),
{merged('p', keys='user_id, side, w', source='p0')}, sp AS (SELECT user_id, min(t) AS a, max(t) AS b FROM ev GROUP BY user_id),
l AS (SELECT p.user_id, side, w, sum(least(hi, b) - greatest(lo, a)) AS off FROM p JOIN sp ON p.user_id = sp.user_id AND hi > a AND lo < b GROUP BY ALL),
f AS (SELECT sp.user_id, c.side, c.w, coalesce(off, 0) AS off FROM sp CROSS JOIN c LEFT JOIN l ON l.user_id = sp.user_id AND l.side = c.side AND l.w = c.w),
m AS (SELECT count(*) FILTER (off < before) AS n FROM (SELECT off, lag(off) OVER (PARTITION BY user_id, side ORDER BY w) AS before FROM f WHERE side <> 'none')),
q AS (SELECT user_id, w, max(off) FILTER (side = 'both') AS b, max(off) FILTER (side = 'pre') AS x, max(off) FILTER (side = 'post') AS y FROM f WHERE side <> 'none' GROUP BY ALL),
o AS (SELECT user_id, max(off) FILTER (side = 'none') AS z FROM f GROUP BY 1), k AS (SELECT count(*) FILTER (b - z < greatest(x, y) - z OR b - z > x - z + y - z) AS n FROM q JOIN o USING (user_id))
SELECT 'excluded time grows with w' AS control, n AS n_bad, n = 0 AS pass FROM m UNION ALL SELECT 'both between pre and post', n, n = 0 FROM k UNION ALL
SELECT unnest(['balance with no exclusion', 'controls unchanged', 'no negative time']), 0, true""")
def configuration_checks(t):
    """Monotony, balance and unchanged controls (subjects without events) over seven exclusion settings."""
    from tidemark.operators.exposure import each_configuration, outside_grid
    span = t.points.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    pts = t.points.where("event_type = 'click'").select("event_id", "user_id", "t")
    key = ["user_id", "side", "w"]
    zones = durable(iv.union(ev.peri_zones(t.spans("purchase"), USER, GRID, H), key))
    swept = durable(iv.sweep(each_configuration(span.where("hi > lo"), GRID), zones, key))
    kept = outside_grid(swept, zones, pts, USER, GRID)
    # what is dropped is measured by itself, not as the rest of what is kept
    off = swept.where("in_a AND in_b").groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).alias("off"))
    inside = iv.contains(each_configuration(pts, GRID), zones, key, "t", closed=True, normalised=True).groupBy(*key).agg(F.count_if("inside").alias("gone"))
    grid = kept.join(off, key, "left").join(inside, key, "left").na.fill(0)
    none = grid.where("side = 'none'").select("user_id", F.col("off").alias("off0"), F.col("gone").alias("gone0"))
    busy = t.points.groupBy("user_id").agg(F.when(F.count_if(F.col("event_type") == "purchase") > 0, "case").otherwise("control").alias("grp"))
    grid = grid.join(none, "user_id").join(busy, "user_id").select("user_id", "grp", "side", "w", F.col("n_events").alias("n_kept"), (F.col("gone") - F.col("gone0")).alias("n_dropped"),
                                                                   F.col("exposure").alias("observed"), (F.col("off") - F.col("off0")).alias("excluded"))
    return rp.configuration_checks(grid, USER, "grp", "control")


@query("PRJ-20", """SELECT event_id, ll_status, detection_status FROM (SELECT event_id, ['accepted', 'in_band', 'accepted', NULL][event_id % 4 + 1] AS ll_status, ['accepted', 'rescued', 'imputed'][event_id % 3 + 1] AS detection_status FROM events)
WHERE coalesce(ll_status, '') <> 'in_band' AND detection_status = 'accepted'""")
def relevant_events(t):
    """Events that exclude time for transients: none in the review band, none rescued or imputed."""
    at = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % n + 1).cast("int"))
    rows = t.events.select("event_id", at(["accepted", "in_band", "accepted", None], 4).alias("ll_status"), at(["accepted", "rescued", "imputed"], 3).alias("detection_status"))
    return rp.relevant_events(rows)


@query("UDF-03", """SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value > 10) AS n, round(sum(value) FILTER (event_type = 'purchase' AND value > 10), 6) AS total,
 round(max(value) FILTER (event_type = 'purchase' AND value > 10), 6) AS largest FROM events GROUP BY user_id""")
def selected_summary(t):
    """Summary per subject over the rows that a selector handed in picks; subjects without such rows stay."""
    out = rp.selected_summary(t.events, USER, lambda d: (d["event_type"] == "purchase") & (d["value"] > 10), {
        "n": F.count_if, "total": lambda ok: F.round(F.sum(F.when(ok, F.col("value"))), 6), "largest": lambda ok: F.round(F.max(F.when(ok, F.col("value"))), 6)})
    return out


FILLED = {"case_applied": "''", "case_source": "''", "suggested_case": "''", "reference_used": "NULL::DOUBLE", "reference_source": "''", "gain_estimate_raw": "NULL::DOUBLE", "gain_source": "''",
          "sensitivity_equivalent_uV_per_mm": "NULL::DOUBLE", "line_ratio_db": "NULL::DOUBLE", "line_ratio_p95_db": "NULL::DOUBLE", "line_ratio_max_db": "NULL::DOUBLE", "pct_time_line_high": "NULL::DOUBLE",
          "quantization_step_uV": "NULL::DOUBLE", "snr_quantization_db": "NULL::DOUBLE", "adc_codes_span": "NULL::DOUBLE", "pct_clipped": "NULL::DOUBLE", "flat_fraction": "NULL::DOUBLE",
          "notch_blocks_skipped": "NULL::INT", "seizure_threshold_mode": "''", "iid_threshold_mode": "''", "excel_attenuation": "''"}


@query("AGG-05", f"""WITH c AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS t0, avg((value > 40)::INT) * 100 AS o, count(*) FILTER (value < 1) AS short, stddev_samp(value) AS sd FROM events GROUP BY ALL),
r AS (SELECT unnest(range(0, (SELECT max(user_id) + 6 FROM events))) AS user_id), f AS (SELECT user_id, user_id % 7 = 0 AS fw FROM r),
x AS (SELECT r.user_id, event_type, n, t0, o, short, sd, n IS NULL AS absent, fw FROM r JOIN f USING (user_id) LEFT JOIN c USING (user_id))
SELECT 's' || user_id AS subject_id, coalesce(event_type, '') AS region, 'rec_' || user_id AS source_file, t0 AS session_start,
 CASE WHEN absent THEN '' WHEN n >= 12 THEN 'clean,detect,quality' WHEN n >= 8 THEN 'clean,quality' ELSE 'clean' END AS stages_completed,
 CASE WHEN absent THEN 1 WHEN n < 8 THEN 2 WHEN n < 12 THEN 1 ELSE 0 END AS n_errors,
 CASE WHEN absent THEN 'file not found' WHEN n < 8 THEN 'too few rows to detect; too few rows for quality' WHEN n < 12 THEN 'too few rows to detect' ELSE '' END AS error_messages,
 CASE WHEN n >= 12 THEN short::INT END AS n_blocks_rejected_short, round(o, 6) AS outlier_pct, CASE WHEN NOT absent THEN 0.0::DOUBLE END AS nan_pct,
 CASE WHEN fw THEN 1 ELSE 0 END AS n_warnings, CASE WHEN fw THEN 'odd file' ELSE '' END AS warning_messages, CASE WHEN n >= 8 AND sd > 15 THEN 'ok' WHEN n >= 8 THEN 'low_amplitude' ELSE '' END AS quality_class,
 CASE WHEN n >= 8 THEN round(sd, 6) END AS sigma_band_uV, CASE WHEN NOT absent THEN 1.0::DOUBLE END AS gain_applied, false AS notch_applied, {', '.join(f'{v} AS {k}' for k, v in FILLED.items())} FROM x""")
def quality_report(t):
    """Quality rows of every subject and channel; stages that failed and files that are missing stay as rows."""
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("t0"), F.round(100 * F.avg((F.col("value") > 40).cast("int")), 6).alias("o"),
                                                      F.count_if(F.col("value") < 1).alias("short"), F.stddev_samp("value").alias("sd"))
    name = lambda: [F.concat(F.lit("s"), "user_id").alias("subject_id"), F.col("event_type").alias("region"), F.concat(F.lit("rec_"), "user_id").alias("source_file")]
    c = durable(c.select(*name(), "user_id", "n", "t0", "o", "short", "sd"))
    key = list(rp.CHANNEL)
    stages = {"clean": c.select(*key, F.col("o").alias("outlier_pct"), F.lit(0.0).alias("nan_pct"), F.lit(1.0).alias("gain_applied")),
              "detect": c.where("n >= 12").select(*key, F.col("short").alias("n_blocks_rejected_short")),
              "quality": c.where("n >= 8").select(*key, F.round("sd", 6).alias("sigma_band_uV"), F.when(F.col("sd") > 15, "ok").otherwise("low_amplitude").alias("quality_class"))}
    top = t.events.agg(F.max("user_id").alias("m"))
    requested = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") + 5)).alias("user_id")).select(F.col("user_id"), F.concat(F.lit("s"), "user_id").alias("subject_id"), F.concat(F.lit("rec_"), "user_id").alias("source_file"))
    requested = durable(requested)
    told = lambda d, region, kind, text, ix: d.select("source_file", region.alias("region"), F.lit(kind).alias("kind"), F.lit(text).alias("message"), F.lit(ix).alias("ix"))
    none = F.lit(None).cast("string")
    problems = told(c.where("n < 12"), F.col("region"), "error", "too few rows to detect", 1).unionByName(told(c.where("n < 8"), F.col("region"), "error", "too few rows for quality", 2))
    problems = problems.unionByName(told(requested.join(c.select("source_file").distinct(), "source_file", "left_anti"), none, "error", "file not found", 0))
    problems = problems.unionByName(told(requested.where("user_id % 7 = 0"), none, "warning", "odd file", 0))
    out = rp.quality_report(c.select(*key, F.col("t0").alias("session_start")), stages, problems, requested.drop("user_id"))
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("EVT-12 EVT-13", f"WITH RECURSIVE {POINTS}, {RECON}" + f""",
inf AS (SELECT user_id, group_id, min(ref_lo) AS ref_lo, max(ref_hi) AS ref_hi FROM m JOIN gid USING (user_id, root) GROUP BY ALL),
ch AS (SELECT user_id, event_type, min(t) AS a, max(hi) AS z FROM ev WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL),
blk AS (SELECT user_id, event_type, 0 AS block_id, a AS b_lo, a + (z - a) // 3 AS b_hi FROM ch UNION ALL SELECT user_id, event_type, 1, a + 2 * (z - a) // 3, z FROM ch),
slot AS (SELECT inf.user_id, group_id, ch.event_type, ref_lo, ref_hi FROM inf JOIN ch USING (user_id) WHERE NOT EXISTS (SELECT 1 FROM m JOIN gid USING (user_id, root) WHERE m.user_id = inf.user_id AND gid.group_id = inf.group_id AND m.event_type = ch.event_type)),
near AS (SELECT r.*, group_id, row_number() OVER (PARTITION BY r.event_id ORDER BY greatest(r.t, ref_lo) - least(r.hi, ref_hi), group_id) AS k FROM ev r JOIN inf ON inf.user_id = r.user_id
  AND greatest(r.t, ref_lo) - least(r.hi, ref_hi) < {2 * H} WHERE event_type IN ('click', 'view', 'error') AND value < 12),
free AS (SELECT s.* FROM slot s WHERE NOT EXISTS (SELECT 1 FROM near b WHERE b.k = 1 AND b.user_id = s.user_id AND b.group_id = s.group_id AND b.event_type = s.event_type)),
bb AS (SELECT free.*, b_lo, b_hi, row_number() OVER (PARTITION BY free.user_id, group_id, free.event_type ORDER BY least(ref_hi, b_hi) - greatest(ref_lo, b_lo) DESC, block_id) AS k, least(ref_hi, b_hi) - greatest(ref_lo, b_lo) AS c
 FROM free LEFT JOIN blk ON blk.user_id = free.user_id AND blk.event_type = free.event_type)
SELECT user_id, group_id, event_type, CASE WHEN c > 0 THEN greatest(ref_lo, b_lo) ELSE ref_lo END AS lo, CASE WHEN c > 0 THEN least(ref_hi, b_hi) ELSE ref_hi END AS hi, CASE WHEN c > 0 THEN 'no_candidate' ELSE 'no_valid_signal' END AS rejected_by,
 (SELECT count(*) FROM ch WHERE ch.user_id = bb.user_id) + 1 AS n_channels_total FROM bb WHERE k = 1
UNION ALL SELECT user_id, group_id, 'signup', ref_lo, ref_hi, 'detection_failed', (SELECT count(*) FROM ch WHERE ch.user_id = inf.user_id) + 1 FROM inf""")
def imputed_events(t):
    """Windows filled in for channels without a row: clipped to the valid block that overlaps most, or marked; a failed channel gets every event."""
    rows = channel_rows(t).withColumnRenamed("value", "score")
    ends = rows.groupBy("user_id", "event_type").agg(F.min("lo").alias("a"), F.max("hi").alias("z"))
    a, span = F.col("a"), F.col("z") - F.col("a")
    third = lambda n: (a + F.floor(n * span / 3)).cast("long")
    block = lambda i, lo, hi: F.struct(F.lit(i).alias("block_id"), lo.cast("long").alias("b_lo"), hi.cast("long").alias("b_hi"))
    blocks = ends.select("user_id", "event_type", F.inline(F.array(block(0, a, third(1)), block(1, third(2), F.col("z")))))
    failed = rows.select("user_id").distinct().withColumn("event_type", F.lit("signup"))
    out = ev.reconcile(rows.where("score >= 12"), rows.where("score < 12"), rows.select("user_id", "event_type").distinct(), USER, "event_type", 2 * H, blocks, failed)
    return out.where("detection_status = 'imputed'").select("user_id", "group_id", "event_type", "lo", "hi", "rejected_by", "n_channels_total")
