"""Event construction: transients, runs, zones, grouping across channels, labels."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import POINTS, merged, query
from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators.rangejoin import overlap_join
from tidemark.operators.scan import ordered_scan
from tidemark.session import settle

USER = ["user_id"]
H = 3_600_000_000

# zones around errors, remaining peaks, complexes and bursts: shared by several queries
ZONES = (f"z0 AS (SELECT user_id, t - {H} AS t, t + {H} AS hi FROM ev WHERE event_type = 'error'), "
         + merged("z", source="z0"))
PEAKS = """pk AS (SELECT * FROM ev p WHERE event_type <> 'error' AND value >= 5 AND NOT EXISTS
 (SELECT 1 FROM z WHERE z.user_id = p.user_id AND p.t BETWEEN z.lo AND z.hi))"""
COMPLEX = merged("cx", source="pk", hi="t", gap=str(8 * H), positive=False,
                 aggs="count(*) AS n_spikes, max(value) AS max_amplitude, sum(value) / count(*) AS mean_amplitude")
BURST = (merged("bu_", source="cx", lo="lo", hi="lo", gap=str(48 * H), positive=False, aggs="count(*) AS n_complexes")
         + f", bu AS (SELECT * FROM bu_ WHERE n_complexes > 3 AND hi - lo > {24 * H} AND hi - lo < {400 * H})")
CHAIN = f"WITH {POINTS}, {ZONES}, {PEAKS}, {COMPLEX}, {BURST}"


def zones_of(t):
    near = t.points.where("event_type = 'error'").select(
        "user_id", (F.col("t") - H).alias("lo"), (F.col("t") + H).alias("hi"))
    return iv.union(near, USER)


def peaks_of(t):
    pts = t.points.where("event_type <> 'error' AND value >= 5").select("event_id", "user_id", "t", "value")
    return iv.contains(pts, zones_of(t), USER, "t", closed=True).where("NOT inside").drop("inside")


def complexes_of(t):
    return settle(ev.complexes(peaks_of(t), USER, "t", "value", 8 * H))


def bursts_of(cx):
    return ev.bursts(cx, USER, 48 * H, 3, 24 * H, 400 * H)


@query("EVT-05 STR-02", CHAIN + """ SELECT user_id, lo AS start, hi AS "end", n_spikes, max_amplitude,
 round(mean_amplitude, 6) AS mean_amplitude, CASE WHEN n_spikes >= 2 THEN 'polyspike' ELSE 'single' END AS classification FROM cx""")
def complexes(t):
    return complexes_of(t).withColumn("mean_amplitude", F.round("mean_amplitude", 6))


@query("EVT-06", CHAIN + " SELECT user_id, lo, hi, n_complexes FROM bu")
def bursts(t):
    return bursts_of(complexes_of(t))


@query("EVT-07", CHAIN + """ SELECT cx.user_id, cx.lo AS start, bu.lo AS burst_start FROM cx LEFT JOIN bu
 ON cx.user_id = bu.user_id AND cx.lo BETWEEN bu.lo AND bu.hi""")
def burst_membership(t):
    cx = complexes_of(t)
    return ev.burst_membership(cx, bursts_of(cx), USER).select("user_id", "start", "burst_start")


@query("EVT-08 EVT-04 SET-05 AGG-04 JOIN-06", CHAIN + """, sp AS (SELECT user_id, min(t) AS a, max(t) AS b FROM ev GROUP BY user_id),
zl AS (SELECT sp.user_id, sum(least(z.hi, b) - greatest(z.lo, a)) AS off FROM sp JOIN z ON z.user_id = sp.user_id
  AND z.hi > a AND z.lo < b GROUP BY sp.user_id),
ex AS (SELECT sp.user_id, (b - a - coalesce(off, 0)) / 6e7 AS minutes FROM sp LEFT JOIN zl USING (user_id)),
c AS (SELECT user_id, count(*) AS n_complexes, count(*) FILTER (n_spikes >= 2) AS n_poly, sum(n_spikes) AS n_spikes,
  avg(n_spikes) FILTER (n_spikes >= 2) AS spp FROM cx GROUP BY user_id),
b AS (SELECT user_id, count(*) AS n_bursts FROM bu GROUP BY user_id)
SELECT user_id, round(minutes, 3) AS minutes, coalesce(n_complexes, 0) AS n_complexes, coalesce(n_poly, 0) AS n_poly,
 CAST(coalesce(n_spikes, 0) AS BIGINT) AS n_spikes, coalesce(n_bursts, 0) AS n_bursts, round(spp, 6) AS spikes_per_poly,
 round(coalesce(n_complexes, 0) / minutes, 9) AS complexes_per_min, round(coalesce(n_bursts, 0) / minutes * 60, 9) AS bursts_per_h,
 round(100 * coalesce(n_poly, 0) / greatest(coalesce(n_complexes, 0), 1), 6) AS pct_poly
FROM ex LEFT JOIN c USING (user_id) LEFT JOIN b USING (user_id)""")
def subject_rates(t):
    """Flagship: peaks outside exclusion zones -> complexes -> bursts -> rates per analysed minute."""
    span = t.points.groupBy("user_id").agg(F.min("t").alias("rec_lo"), F.max("t").alias("rec_hi"))
    near = t.points.where("event_type = 'error'").select("user_id", F.col("t").alias("lo"), F.col("t").alias("hi"))
    zones = ev.exclusion_zones([("error", near, H)], USER, span)
    included = iv.subtract(span.select("user_id", F.col("rec_lo").alias("lo"), F.col("rec_hi").alias("hi")), zones, USER)
    minutes = included.groupBy("user_id").agg((F.sum(F.col("hi") - F.col("lo")) / 6e7).alias("minutes"))
    cx = complexes_of(t)
    out = ev.rate_summary(cx, bursts_of(cx), minutes, USER, "minutes").drop("spikes_per_min")
    digits = {"minutes": 3, "spikes_per_poly": 6, "complexes_per_min": 9, "bursts_per_h": 9, "pct_poly": 6}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("EVT-01 SIG-03 WIN-05 AGG-01", f"WITH {POINTS}" + """, n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev),
k AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM n WHERE value > 15),
r AS (SELECT user_id, min(n) AS first_n, max(n) AS last_n, count(*) AS n_samples FROM k GROUP BY user_id, g)
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_n) AS run_id FROM r WHERE n_samples >= 3""")
def threshold_runs(t):
    """Runs of consecutive samples over a threshold, duration filter before any merge, chronological ids."""
    n = ev.numbered(t.points.select("user_id", "t", "event_id", "value"), USER, ["t", "event_id"], "n")
    runs = ev.threshold_runs(n, USER, "n", F.col("value") > 15).where("n_samples >= 3")
    return ev.numbered(runs, USER, ["first_n"], "run_id")


@query("EVT-02 WIN-09 SIG-28", f"WITH RECURSIVE {POINTS}, {merged('u')}," + f"""
o AS (SELECT user_id, lo, hi, row_number() OVER (PARTITION BY user_id ORDER BY lo) AS k FROM u),
f AS (SELECT user_id, k, lo AS s, hi AS e, lo AS piece FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k,
  CASE WHEN o.lo - f.e <= {12 * H} AND greatest(f.e, o.hi) - f.s <= {48 * H} THEN f.s ELSE o.lo END,
  CASE WHEN o.lo - f.e <= {12 * H} AND greatest(f.e, o.hi) - f.s <= {48 * H} THEN greatest(f.e, o.hi) ELSE o.hi END,
  CASE WHEN o.lo - f.e <= {12 * H} AND greatest(f.e, o.hi) - f.s <= {48 * H} THEN f.piece ELSE o.lo END
 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
SELECT user_id, piece AS lo, max(e) AS hi FROM f GROUP BY user_id, piece""")
def bounded_merge(t):
    """Greedy merge of runs: gap at most 12 h and merged span at most 48 h."""
    spans = iv.union(t.points.select("user_id", F.col("t").alias("lo"), "hi"), USER)
    return ev.bounded_merge(spans, USER, "lo", "hi", 12 * H, 48 * H)


@query("WIN-09 SIG-28", f"WITH {POINTS}" + """ SELECT event_id, coalesce(last_value(CASE WHEN value > 20 THEN true WHEN value <= 8 THEN false END
 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), false) AS active FROM ev""")
def hysteresis(t):
    pts = t.points.select("event_id", "user_id", "t", "value")
    return ev.hysteresis(pts, USER, ["t", "event_id"], "value", 20, 8).select("event_id", "active")


@query("EVT-19", f"WITH {POINTS}" + f""", n AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)
 OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS others FROM ev), """
       + merged("r", "event_type = 'error'", keys="user_id, others", source="n", gap=str(72 * H), positive=False, aggs="count(*) AS n_events")
       + " SELECT user_id, lo, hi, n_events FROM r")
def disconnect_runs(t):
    """Consecutive error events (nothing else between) within 72 h of the running end form one span."""
    pts = t.points.select("event_id", "user_id", "event_type", F.col("t").alias("lo"), "hi")
    return ev.disconnect_runs(pts, USER, F.col("event_type") == "error", 72 * H)


@query("EVT-30 AGG-21 CHK-06", f"WITH {POINTS}, c AS (SELECT * FROM (VALUES ('none', 0), ('both', 6), ('both', 24), ('pre', 6), ('post', 6)) AS v(side, w)), "
       f"p0 AS (SELECT user_id, side, w, t - CASE WHEN side IN ('both', 'pre') THEN w * {H} ELSE 0 END AS t, "
       f"hi + CASE WHEN side IN ('both', 'post') THEN w * {H} ELSE 0 END AS hi FROM ev, c WHERE event_type = 'purchase'), "
       + merged("p", keys="user_id, side, w", source="p0")
       + ", sp AS (SELECT user_id, min(t) AS a, max(t) AS b FROM ev GROUP BY user_id), "
       "l AS (SELECT p.user_id, side, w, sum(least(hi, b) - greatest(lo, a)) AS off FROM p JOIN sp ON p.user_id = sp.user_id AND hi > a AND lo < b GROUP BY ALL), "
       "k AS (SELECT p.user_id, side, w, count(*) AS inside FROM p JOIN ev ON ev.user_id = p.user_id AND ev.event_type = 'click' AND ev.t BETWEEN p.lo AND p.hi GROUP BY ALL), "
       "n AS (SELECT user_id, count(*) AS n FROM ev WHERE event_type = 'click' GROUP BY user_id) "
       "SELECT n.user_id, c.side, CAST(c.w AS INTEGER) AS w, CAST(b - a - coalesce(off, 0) AS BIGINT) AS exposure_us, n - coalesce(inside, 0) AS n_events, "
       "round((n - coalesce(inside, 0)) / nullif(b - a - coalesce(off, 0), 0) * 3.6e9, 9) AS per_hour "
       "FROM n JOIN sp USING (user_id) CROSS JOIN c LEFT JOIN l ON l.user_id = n.user_id AND l.side = c.side AND l.w = c.w "
       "LEFT JOIN k ON k.user_id = n.user_id AND k.side = c.side AND k.w = c.w")
def peri_exclusion_rates(t):
    """Event rate outside zones around purchases for five exclusion settings."""
    from tidemark.operators.exposure import exclusion_grid
    span = t.points.groupBy("user_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    pts = t.points.where("event_type = 'click'").select("event_id", "user_id", "t")
    grid = [("none", 0), ("both", 6), ("both", 24), ("pre", 6), ("post", 6)]
    out = exclusion_grid(t.spans("purchase"), span, pts, USER, grid, H)
    return out.select("user_id", "side", "w", F.col("exposure").alias("exposure_us"), "n_events",
                      F.round(F.try_divide(F.col("n_events"), F.col("exposure")) * 3.6e9, 9).alias("per_hour"))


@query("EVT-31", f"WITH {POINTS}" + f""", d AS (SELECT user_id, t AS a, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS b FROM ev),
g AS (SELECT user_id, unnest([a, b]) AS x FROM d WHERE b - a > {24 * H})
SELECT event_id, EXISTS (SELECT 1 FROM g WHERE g.user_id = e.user_id AND (abs(g.x - e.t) <= {H} OR abs(g.x - e.hi) <= {H})) AS adjacent_to_gap
FROM ev e WHERE event_type = 'view'""")
def adjacent_to_gap(t):
    """Events with an end within one hour of an edge of a day-long gap."""
    from tidemark.operators.scan import lead
    nxt = ordered_scan(t.points.select("user_id", "event_id", "t"), USER, ["t", "event_id"], [lead("b", "t")])
    g = nxt.where(F.col("b") - F.col("t") > 24 * H).select("user_id", F.col("t").alias("lo"), F.col("b").alias("hi"))
    return ev.near_gap(t.spans("view"), g, USER, H).select("event_id", "adjacent_to_gap")


@query("EVT-25 STAT-01", f"WITH {POINTS}, {merged('u', "event_type <> 'purchase'")}" + """, p AS (
 SELECT user_id, t AS b, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS a FROM ev WHERE event_type = 'purchase')
SELECT p.user_id, p.b AS t, p.b - p.a AS isi FROM p WHERE b > a AND (SELECT coalesce(sum(least(u.hi, p.b) - greatest(u.lo, p.a)), 0)
 FROM u WHERE u.user_id = p.user_id AND u.hi > p.a AND u.lo < p.b) >= 0.01 * (p.b - p.a)""")
def observed_isi(t):
    """Start-to-start intervals of which at least 1 % was observed (other events' spans)."""
    starts = t.points.where("event_type = 'purchase'").select("user_id", "t")
    obs = t.points.where("event_type <> 'purchase'").select("user_id", F.col("t").alias("lo"), "hi")
    return ev.observed_intervals(starts, obs, USER, "t", 0.01)


@query("EVT-26", f"WITH {POINTS}, {merged('u', "event_type <> 'purchase'")}" + f"""
SELECT e.event_id, NOT EXISTS (SELECT 1 FROM ev o WHERE o.event_type = 'purchase' AND o.user_id = e.user_id AND o.event_id <> e.event_id
 AND o.t < e.t AND o.hi > e.t - {48 * H}) AND (SELECT coalesce(sum(least(u.hi, e.t) - greatest(u.lo, e.t - {48 * H})), 0) FROM u
 WHERE u.user_id = e.user_id AND u.hi > e.t - {48 * H} AND u.lo < e.t) >= 0.01 * {48 * H} AS is_lead
FROM ev e WHERE event_type = 'purchase'""")
def lead_events(t):
    """Events with none before them for 48 h and at least 1 % of that time observed."""
    obs = t.points.where("event_type <> 'purchase'").select("user_id", F.col("t").alias("lo"), "hi")
    return ev.lead_events(t.spans("purchase"), obs, USER, 48 * H, 0.01).select("event_id", "is_lead")


GROUPS = f"""b AS (SELECT event_id, user_id, event_type, value, t, hi FROM ev WHERE event_type IN ('click', 'view', 'error')),
e AS (SELECT a.event_id AS u, b.event_id AS v FROM b a JOIN b ON a.user_id = b.user_id AND a.event_type <> b.event_type
 AND greatest(a.t, b.t) - least(a.hi, b.hi) < {2 * H}),
cc AS (SELECT event_id AS node, event_id AS root FROM b UNION SELECT e.v, cc.root FROM cc JOIN e ON e.u = cc.node),
roots AS (SELECT node AS event_id, min(root) AS root FROM cc GROUP BY node),
m AS (SELECT b.*, root FROM b JOIN roots USING (event_id)),
sp AS (SELECT user_id, root, min(t) AS ref_lo, max(hi) AS ref_hi FROM m GROUP BY ALL),
gid AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ref_lo, ref_hi, root) AS group_id FROM sp)"""


def channel_rows(t):
    return t.points.where("event_type IN ('click', 'view', 'error')").select(
        "event_id", "user_id", "event_type", "value", F.col("t").alias("lo"), "hi")


@query("EVT-09 EVT-10", f"WITH RECURSIVE {POINTS}, {GROUPS}" + """, fr AS (SELECT root, event_type, count(*) > 1 AS fragmented FROM m GROUP BY ALL),
st AS (SELECT *, CASE WHEN value >= 12 THEN 'accepted' WHEN value >= 6 THEN 'in_band' ELSE 'rejected' END AS s FROM m),
ca AS (SELECT root, count(DISTINCT event_type) AS nch, count(DISTINCT event_type) FILTER (s = 'accepted') AS na,
 coalesce(string_agg(DISTINCT event_type, ';' ORDER BY event_type) FILTER (s = 'accepted'), '') AS regs FROM st GROUP BY root),
ib AS (SELECT root, count(DISTINCT event_type) AS nb FROM st x WHERE s = 'in_band' AND NOT EXISTS (SELECT 1 FROM st y WHERE y.root = x.root
  AND y.event_type = x.event_type AND y.s = 'accepted') GROUP BY root)
SELECT m.event_id, group_id, ref_lo, ref_hi, fragmented, nch AS n_channels_in_group, na AS n_accepted, coalesce(nb, 0) AS n_in_band,
 regs AS accepted_in_regions, CASE WHEN na >= 2 THEN 'Crisis' WHEN na = 1 THEN 'Candidates' ELSE 'Candidates_in_band' END AS category
FROM m JOIN gid USING (user_id, root) JOIN fr ON fr.root = m.root AND fr.event_type = m.event_type JOIN ca ON ca.root = m.root LEFT JOIN ib ON ib.root = m.root""")
def channel_groups(t):
    """Group rows of different channels closer than two hours (transitively) and categorise the groups."""
    g = ev.group_across_channels(channel_rows(t), USER, "event_type", 2 * H)
    status = F.when(F.col("value") >= 12, "accepted").when(F.col("value") >= 6, "in_band").otherwise("rejected")
    out = ev.categorise(g.withColumn("status", status), USER, "event_type", "status")
    return out.select("event_id", "group_id", "ref_lo", "ref_hi", "fragmented", "n_channels_in_group", "n_accepted",
                      "n_in_band", "accepted_in_regions", "category")


RECON = GROUPS.replace("event_type IN ('click', 'view', 'error')", "event_type IN ('click', 'view', 'error') AND value >= 12")


@query("EVT-11 EVT-12 EVT-13 JOIN-14 SRT-04 AGG-02", f"WITH RECURSIVE {POINTS}, {RECON}" + f""",
inf AS (SELECT user_id, group_id, min(ref_lo) AS ref_lo, max(ref_hi) AS ref_hi, count(DISTINCT event_type) AS na,
  string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS regs FROM m JOIN gid USING (user_id, root) GROUP BY ALL),
ch AS (SELECT DISTINCT user_id, event_type FROM ev WHERE event_type IN ('click', 'view', 'error')),
slot AS (SELECT inf.user_id, group_id, ch.event_type, ref_lo, ref_hi FROM inf JOIN ch USING (user_id)
  WHERE NOT EXISTS (SELECT 1 FROM m JOIN gid USING (user_id, root) WHERE m.user_id = inf.user_id AND gid.group_id = inf.group_id AND m.event_type = ch.event_type)),
rej AS (SELECT * FROM ev WHERE event_type IN ('click', 'view', 'error') AND value < 12),
near AS (SELECT r.*, group_id, row_number() OVER (PARTITION BY r.event_id ORDER BY greatest(r.t, ref_lo) - least(r.hi, ref_hi), group_id) AS k
  FROM rej r JOIN inf ON inf.user_id = r.user_id AND greatest(r.t, ref_lo) - least(r.hi, ref_hi) < {2 * H}),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id, group_id, event_type ORDER BY value DESC, event_id) AS q FROM near WHERE k = 1),
al AS (SELECT m.user_id, gid.group_id, event_type, event_id, t AS lo, hi, value AS score, 'accepted' AS detection_status, '' AS rejected_by FROM m JOIN gid USING (user_id, root)
 UNION ALL SELECT s.user_id, s.group_id, s.event_type, b.event_id, coalesce(b.t, s.ref_lo), coalesce(b.hi, s.ref_hi), b.value,
  CASE WHEN b.event_id IS NULL THEN 'imputed' ELSE 'rescued' END, CASE WHEN b.event_id IS NULL THEN 'no_candidate' ELSE 'll_ratio' END
  FROM slot s LEFT JOIN best b ON b.q = 1 AND b.user_id = s.user_id AND b.group_id = s.group_id AND b.event_type = s.event_type)
SELECT al.user_id, al.group_id, event_type, event_id, lo, al.hi, score, detection_status, rejected_by, na AS accepted_in_n_channels, regs AS accepted_in_regions,
 (SELECT count(*) FROM ch WHERE ch.user_id = al.user_id) AS n_channels_total, na >= 2 AS is_bilateral_accepted FROM al JOIN inf USING (user_id, group_id)""")
def reconciled_events(t):
    """Agree on events across channels: accepted, rescued candidates, imputed windows."""
    rows = channel_rows(t).withColumnRenamed("value", "score")
    out = ev.reconcile(rows.where("score >= 12"), rows.where("score < 12"), rows.select("user_id", "event_type").distinct(),
                       USER, "event_type", 2 * H)
    return out.drop("fragmented", "ref_lo", "ref_hi")


@query("EVT-14 PRJ-21 AGG-03", f"WITH {POINTS}" + """, r AS (SELECT user_id, CAST(t // 86400000000 AS BIGINT) AS day, t, hi, value, event_type,
 CASE WHEN value >= 20 THEN 'TP' WHEN value >= 5 THEN 'FP' ELSE '' END AS label, CASE WHEN value < 12 THEN event_type ELSE '' END AS comment,
 CASE WHEN value >= 3 THEN 'accepted' ELSE 'imputed' END AS st FROM ev)
SELECT user_id, day, min(t) AS lo, max(hi) AS hi, count(*) AS n_rows, max(value) AS max_score, count(*) FILTER (label = '') AS n_rows_unlabeled,
 CASE count(DISTINCT label) FILTER (label <> '') WHEN 0 THEN '' WHEN 1 THEN max(label) ELSE 'CONFLICT' END AS label,
 coalesce(string_agg(DISTINCT comment, ';' ORDER BY comment) FILTER (comment <> ''), '') AS comments,
 CASE WHEN bool_or(event_type = 'click' AND st = 'accepted') AND bool_or(event_type = 'view' AND st = 'accepted') THEN 'bilateral'
  WHEN count(DISTINCT event_type) FILTER (st = 'accepted') = 1 AND bool_or(event_type = 'click' AND st = 'accepted') THEN 'click_only'
  WHEN count(DISTINCT event_type) FILTER (st = 'accepted') = 1 AND bool_or(event_type = 'view' AND st = 'accepted') THEN 'view_only' ELSE 'unknown' END AS laterality
FROM r GROUP BY user_id, day""")
def label_events(t):
    """Rows of one labelled event (here: subject x day) with label conflict, comments and laterality."""
    day = F.floor(F.col("t") / 86_400_000_000).cast("bigint")
    rows = t.points.select(
        "user_id", day.alias("day"), F.col("t").alias("lo"), "hi", F.col("value").alias("score"), "event_type",
        F.when(F.col("value") >= 20, "TP").when(F.col("value") >= 5, "FP").otherwise("").alias("label"),
        F.when(F.col("value") < 12, F.col("event_type")).otherwise("").alias("comment"),
        F.when(F.col("value") >= 3, "accepted").otherwise("imputed").alias("detection_status"))
    return ev.label_events(rows, USER, "day", "event_type", "click", "view")


@query("EVT-16 STR-05", f"WITH {POINTS}, " + merged("d", op=">=", aggs="count(*) AS n_merged, arg_min(event_id, struct_pack(a := t, b := hi, c := event_id)) AS first_id")
       + " SELECT * FROM d")
def dedupe_overlaps(t):
    """Strictly overlapping events of a subject become one."""
    spans = t.points.select("event_id", "user_id", F.col("t").alias("lo"), "hi").where("hi > lo")
    return ev.dedupe_overlaps(spans, USER)


@query("EVT-16", f"WITH {POINTS}, " + merged("d", op=">=", aggs="arg_min(event_id, struct_pack(a := t, b := hi, c := event_id)) AS first_id")
       + " SELECT e.event_id, d.first_id AS merged_into FROM ev e JOIN d ON d.user_id = e.user_id AND e.t >= d.lo AND e.t < d.hi WHERE e.hi > e.t")
def merged_origins(t):
    """The merged event every original belongs to."""
    spans = t.points.select("event_id", "user_id", F.col("t").alias("lo"), "hi").where("hi > lo")
    return ev.origin_of(spans, ev.dedupe_overlaps(spans, USER), USER).select("event_id", "merged_into")


@query("EVT-17 EVT-27", f"WITH {POINTS}, d AS (SELECT *, 'detected' AS source FROM ev WHERE event_type = 'click')," + """
m AS (SELECT *, 'missed' AS source FROM ev e WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM d WHERE d.user_id = e.user_id
 AND d.t < e.hi AND d.hi > e.t))
SELECT user_id, event_id, source, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id, source, hi) AS seizure_id FROM (FROM d UNION ALL FROM m)""")
def final_events(t):
    """Detected plus missed events that overlap none of them, numbered per subject by onset."""
    det = t.spans("click").withColumn("source", F.lit("detected"))
    mis = t.spans("purchase").withColumn("source", F.lit("missed"))
    out = ev.numbered(ev.add_missed(det, mis, USER), USER, ["lo", "event_id", "source", "hi"], "seizure_id")
    return out.select("user_id", "event_id", "source", "seizure_id")


@query("EVT-18", f"WITH {POINTS}" + f""", x AS (SELECT user_id, event_id, t, lag(event_id) OVER w AS prev_id, lag(hi) OVER w AS ph FROM ev
 WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, prev_id, event_id, t - ph AS gap FROM x WHERE t - ph < {H}""")
def close_pairs(t):
    return ev.close_pairs(t.points.select("user_id", "event_id", F.col("t").alias("lo"), "hi"), USER, H)


@query("EVT-15", f"WITH {POINTS}" + """, mg AS (SELECT event_id, user_id AS merge_id FROM ev WHERE event_type = 'signup' AND value > 20),
s AS (SELECT merge_id, min(t) AS a, max(hi) AS b, arg_min(event_id, struct_pack(t := t, e := event_id)) AS head FROM ev JOIN mg USING (event_id) GROUP BY merge_id)
SELECT ev.event_id, CASE WHEN head = ev.event_id THEN a ELSE t END AS lo, CASE WHEN head = ev.event_id THEN b ELSE hi END AS hi,
 CASE WHEN head <> ev.event_id THEN head END AS merged_into FROM ev LEFT JOIN mg USING (event_id) LEFT JOIN s USING (merge_id) WHERE event_type = 'signup'""")
def manual_merges(t):
    """Listed events of a subject are joined into their first one."""
    lst = t.points.where("event_type = 'signup' AND value > 20").select("event_id", F.col("user_id").alias("merge_id"))
    return ev.manual_merges(t.spans("signup"), lst, "event_id").drop("user_id")


@query("JOIN-05 AGG-12 SRC-12", f"WITH {POINTS}" + """, c AS (SELECT d.event_id AS det_id, d.user_id, d.t, min(g.event_id) AS gt_id FROM ev d LEFT JOIN ev g
 ON g.event_type = 'purchase' AND g.user_id = d.user_id AND d.t <= g.hi + 600000000 AND d.hi >= g.t - 600000000 WHERE d.event_type = 'click' GROUP BY ALL)
SELECT det_id, gt_id, CASE WHEN gt_id IS NULL THEN 'fp' WHEN row_number() OVER (PARTITION BY gt_id ORDER BY t, det_id) = 1 THEN 'tp' ELSE 'fragment' END AS match_status FROM c""")
def claim_join(t):
    """Each ground-truth event claims the unclaimed detections near it; the earliest is the hit."""
    from tidemark.operators.scoring import claim
    det = t.spans("click").withColumnRenamed("event_id", "det_id")
    gt = t.spans("purchase").withColumnRenamed("event_id", "gt_id")
    return claim(det, gt, USER, 600_000_000).select("det_id", "gt_id", "match_status")


@query("AGG-12 FN-09", f"WITH {POINTS}" + """, c AS (SELECT d.event_id AS det_id, d.user_id, min(g.event_id) AS gt_id FROM ev d LEFT JOIN ev g
 ON g.event_type = 'purchase' AND g.user_id = d.user_id AND d.t <= g.hi + 600000000 AND d.hi >= g.t - 600000000 WHERE d.event_type = 'click' GROUP BY ALL),
d AS (SELECT user_id, count(DISTINCT gt_id) AS tp, count(*) FILTER (gt_id IS NULL) AS fp, count(gt_id) - count(DISTINCT gt_id) AS fragments FROM c GROUP BY user_id),
g AS (SELECT user_id, count(*) AS n_gt FROM ev WHERE event_type = 'purchase' GROUP BY user_id),
s AS (SELECT user_id, n_gt, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fragments, 0) AS fragments FROM g LEFT JOIN d USING (user_id))
SELECT *, n_gt - tp AS fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS "precision", round(coalesce(tp / nullif(n_gt, 0), 0), 9) AS recall,
 round(coalesce(2 * tp / nullif(tp + fp + n_gt, 0), 0), 9) AS f1 FROM s""")
def detection_scores(t):
    """Precision, recall and F1 per subject with ratios of nothing counted as zero."""
    from tidemark.operators.scoring import claim, scores
    det = t.spans("click").withColumnRenamed("event_id", "det_id")
    gt = t.spans("purchase").withColumnRenamed("event_id", "gt_id")
    out = scores(claim(det, gt, USER, 600_000_000), gt, USER)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("JOIN-12", f"WITH {POINTS}, th AS (SELECT unnest(generate_series(20, 60)) AS k)," + """
p AS (SELECT d.event_id AS det_id, g.event_id AS gt_id, d.value FROM ev d JOIN ev g ON d.event_type = 'click' AND g.event_type = 'purchase'
 AND g.user_id = d.user_id AND d.t <= g.hi + 600000000 AND d.hi >= g.t - 600000000),
tp AS (SELECT k, count(DISTINCT gt_id) AS tp, count(DISTINCT det_id) AS hit FROM th JOIN p ON value >= k / 4.0 GROUP BY k),
n AS (SELECT k, count(*) FILTER (value >= k / 4.0) AS kept FROM th, ev WHERE event_type = 'click' GROUP BY k)
SELECT k / 4.0 AS threshold, coalesce(tp, 0) AS tp, kept - coalesce(hit, 0) AS fp, (SELECT count(*) FROM ev WHERE event_type = 'purchase') - coalesce(tp, 0) AS fn
FROM n LEFT JOIN tp USING (k)""")
def threshold_sweep(t):
    """Hits, misses and false detections for 41 thresholds, from one overlap join."""
    from tidemark.operators.scoring import threshold_sweep as sweep
    det = t.points.where("event_type = 'click'").select(F.col("event_id").alias("det_id"), "user_id", F.col("t").alias("lo"), "hi", F.col("value").alias("score"))
    gt = t.spans("purchase").withColumnRenamed("event_id", "gt_id")
    out = sweep(det, gt, USER, 600_000_000, [k / 4 for k in range(20, 61)])
    return out.select("threshold", "tp", "fp", "fn")
