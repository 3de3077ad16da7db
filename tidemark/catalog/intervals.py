"""Interval algebra, runs and windows on the event table."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import POINTS, merged, query
from tidemark.operators import intervals as iv
from tidemark.operators.islands import islands
from tidemark.operators.rangejoin import overlap_join
from tidemark.operators.scan import (lag, last_known, lead, next_known, ordered_scan, position,
                                     running_max, running_sum)

USER = ["user_id"]
AB = f"WITH {POINTS}, {merged('a', "event_type = 'click'")}, " \
     f"{merged('b', "event_type = 'error'")}"


@query("SET-01 WIN-04", f"WITH {POINTS}, {merged('u', 'true')} SELECT user_id, lo, hi FROM u")
def interval_union(t):
    """Disjoint cover of every subject's event intervals; touching intervals join."""
    return iv.union(t.points.select("user_id", F.col("t").alias("lo"), "hi"), USER)


@query("SET-02", f"WITH {POINTS}, {merged('u', 'true')} "
       "SELECT user_id, CAST(sum(hi - lo) AS BIGINT) AS length FROM u GROUP BY user_id")
def interval_length(t):
    return iv.total_length(t.points.select("user_id", F.col("t").alias("lo"), "hi"), USER)


@query("SET-04", AB + """ SELECT a.user_id, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi
FROM a JOIN b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi""")
def interval_intersect(t):
    return iv.intersect(t.spans("click"), t.spans("error"), USER)


@query("SET-03 SET-05", AB + """, cut AS (
  SELECT a.user_id, a.lo AS alo, a.hi AS ahi, b.lo AS blo, b.hi AS bhi,
         row_number() OVER (PARTITION BY a.user_id, a.lo ORDER BY b.lo) AS k,
         lead(b.lo) OVER (PARTITION BY a.user_id, a.lo ORDER BY b.lo) AS nlo
  FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.lo < b.hi AND b.lo < a.hi),
pieces AS (
  SELECT user_id, alo AS lo, coalesce(blo, ahi) AS hi FROM cut WHERE k = 1
  UNION ALL SELECT user_id, bhi, coalesce(nlo, ahi) FROM cut WHERE blo IS NOT NULL)
SELECT user_id, lo, hi FROM pieces WHERE hi > lo""")
def interval_subtract(t):
    return iv.subtract(t.spans("click"), t.spans("error"), USER)


@query("SET-06 SET-15", f"WITH {POINTS}, {merged('b', "event_type = 'error'")}" + """
SELECT a.event_id, CAST(coalesce(sum(CASE WHEN b.lo IS NOT NULL THEN least(a.hi, b.hi) - greatest(a.t, b.lo) END), 0) AS BIGINT) AS overlap
FROM ev a LEFT JOIN b ON a.user_id = b.user_id AND a.t < b.hi AND b.lo < a.hi
WHERE a.event_type = 'click' GROUP BY a.event_id""")
def interval_overlap_per_row(t):
    """Seconds of each interval covered by another set: prefix sums, no pair is formed."""
    return iv.overlap_length(t.spans("click"), t.spans("error"), USER).select("event_id", "overlap")


@query("JOIN-07 SIG-25", f"WITH {POINTS}, {merged('b', "event_type = 'error'")}" + """
, last AS (SELECT user_id, max(hi) AS top FROM b GROUP BY user_id)
SELECT p.event_id, count(b.lo) > 0 AS inside FROM ev p LEFT JOIN last USING (user_id)
LEFT JOIN b ON p.user_id = b.user_id AND p.t >= b.lo AND (p.t < b.hi OR (p.t = b.hi AND b.hi = last.top))
WHERE p.event_type <> 'error' GROUP BY p.event_id""")
def points_inside(t):
    pts = t.points.where("event_type <> 'error'").select("event_id", "user_id", "t")
    return iv.contains(pts, t.spans("error"), USER, "t").select("event_id", "inside")


@query("JOIN-08", f"WITH {POINTS}" + """ SELECT p.event_id FROM ev p WHERE p.event_type = 'view' AND EXISTS (
  SELECT 1 FROM ev b WHERE b.event_type = 'error' AND b.user_id = p.user_id AND p.t BETWEEN b.t AND b.hi)""")
def points_inside_closed(t):
    pts = t.points.where("event_type = 'view'").select("event_id", "user_id", "t")
    return iv.contains(pts, t.spans("error"), USER, "t", closed=True).where("inside").select("event_id")


@query("JOIN-09", f"WITH {POINTS}, {merged('b', "event_type = 'error'")}" + """
SELECT p.event_id, b.lo AS span_start FROM ev p LEFT JOIN b
  ON p.user_id = b.user_id AND p.t >= b.lo AND p.t <= b.hi WHERE p.event_type = 'purchase'""")
def containing_interval(t):
    """Which recording span holds each onset (as-of lookup)."""
    spans = iv.union(t.spans("error"), USER).withColumn("span_start", F.col("lo"))
    pts = t.points.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return iv.holder_of(pts, spans, USER, "t", "span_start", "span_start").select("event_id", "span_start")


@query("SET-07 FN-03", f"""WITH {POINTS}, {merged('u', 'true')},
d AS (SELECT user_id, lo, hi, unnest(generate_series(CAST(make_timestamp(lo) AS DATE),
      CAST(make_timestamp(hi) AS DATE), INTERVAL 1 DAY)) AS day FROM u),
b AS (SELECT user_id, CAST(day AS DATE) AS day, bin, least(hi, epoch_us(CAST(day AS TIMESTAMP)) + CAST(m1 AS BIGINT) * 60000000)
      - greatest(lo, epoch_us(CAST(day AS TIMESTAMP)) + CAST(m0 AS BIGINT) * 60000000) AS us
      FROM d, (VALUES (0, 0, 480), (1, 480, 1170), (2, 1170, 1440)) AS e(bin, m0, m1))
SELECT user_id, CAST(day AS VARCHAR) AS day, bin, round(sum(us) / 1e6, 3) AS seconds
FROM b WHERE us > 0 GROUP BY user_id, day, bin""")
def clock_bins(t):
    """Exposure by local day and wall-clock bin (dark / light / dark)."""
    spans = t.points.select("user_id", F.col("t").alias("lo"), "hi")
    out = iv.clock_split(spans, USER, "UTC", [0, 480, 1170, 1440])
    return out.select("user_id", F.col("day").cast("string").alias("day"), "bin",
                      F.round(F.col("length") / 1e6, 3).alias("seconds"))


@query("SET-08", f"""WITH {POINTS},
{merged('rec', "event_type IN ('click','view')")}, {merged('gap', "event_type = 'error'")},
{merged('dx', "event_type = 'signup'")}, {merged('off', "event_type IN ('error','signup')")},
a AS (SELECT r.user_id, greatest(r.lo, o.lo) AS lo, least(r.hi, o.hi) AS hi FROM rec r JOIN off o
      ON r.user_id = o.user_id AND r.lo < o.hi AND o.lo < r.hi),
d AS (SELECT r.user_id, greatest(r.lo, o.lo) AS lo, least(r.hi, o.hi) AS hi FROM rec r JOIN dx o
      ON r.user_id = o.user_id AND r.lo < o.hi AND o.lo < r.hi),
g AS (SELECT d.user_id, greatest(d.lo, o.lo) AS lo, least(d.hi, o.hi) AS hi FROM d JOIN dx o
      ON d.user_id = o.user_id AND d.lo < o.hi AND o.lo < d.hi),
tr AS (SELECT user_id, sum(hi - lo) AS rec FROM rec GROUP BY 1), ta AS (SELECT user_id, sum(hi - lo) AS lost FROM a GROUP BY 1),
td AS (SELECT user_id, sum(hi - lo) AS dxr FROM g GROUP BY 1)
SELECT user_id, CAST(rec AS BIGINT) AS rec_us, CAST(rec - coalesce(lost, 0) AS BIGINT) AS eeg_us,
 CAST(rec - coalesce(lost, 0) + coalesce(dxr, 0) AS BIGINT) AS observed_us
FROM tr LEFT JOIN ta USING (user_id) LEFT JOIN td USING (user_id)""")
def observation_time(t):
    """rec = union of files; usable = rec - gaps - disconnections; observed adds reviewed ones."""
    from tidemark.operators.exposure import observation_sets
    sets = observation_sets(t.spans("click", "view"), t.spans("error"), t.spans("signup"),
                            t.spans("signup"), USER)
    wide = None
    for name, df in sets.items():
        part = df.groupBy("user_id").agg(F.sum(F.col("hi") - F.col("lo")).alias(f"{name}_us"))
        wide = part if wide is None else wide.join(part, "user_id", "left")
    return wide.select("user_id", "rec_us", F.coalesce("eeg_us", F.lit(0)).alias("eeg_us"),
                       F.coalesce("observed_us", F.lit(0)).alias("observed_us"))


@query("JOIN-04", f"WITH {POINTS}" + """ SELECT a.event_id AS det_id, b.event_id AS gt_id FROM ev a JOIN ev b
ON a.user_id = b.user_id AND a.t <= b.hi + 60000000 AND a.hi >= b.t - 60000000
WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def overlap_pairs(t):
    """Detection x ground truth within a tolerance of one minute, through time buckets."""
    det = t.spans("click").select(F.col("event_id").alias("det_id"), "user_id", F.col("lo").alias("d0"), F.col("hi").alias("d1"))
    gt = t.spans("purchase").select(F.col("event_id").alias("gt_id"), "user_id", F.col("lo").alias("g0"), F.col("hi").alias("g1"))
    return overlap_join(det, gt, USER, l_lo="d0", l_hi="d1", r_lo="g0", r_hi="g1",
                        tol=60_000_000).select("det_id", "gt_id")


@query("WIN-01 WIN-03 WIN-05 SIG-03", f"WITH {POINTS}" + """, d AS (SELECT *, t - lag(t) OVER w AS isi,
 row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT event_id, n, isi, CAST(sum(CASE WHEN isi > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id
 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS label FROM d""")
def interval_labels(t):
    """Difference to the previous row, row number and running label after gaps over 6 h."""
    rows = ordered_scan(t.points.select("event_id", "user_id", "t"), USER, ["t", "event_id"],
                        [lag("prev", "t"), position("n")])
    rows = rows.withColumn("isi", F.col("t") - F.col("prev"))
    flag = (F.coalesce(F.col("isi") > 21_600_000_000, F.lit(False))).cast("long")
    out = ordered_scan(rows, USER, ["t", "event_id"], [running_sum("label", flag)])
    return out.select("event_id", "n", "isi", "label")


@query("WIN-04 WIN-08", f"WITH {POINTS}" + """ SELECT event_id, max(hi) OVER (PARTITION BY user_id ORDER BY t, event_id
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach,
 last_value(CASE WHEN event_type = 'error' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id
 ROWS UNBOUNDED PRECEDING) AS last_error,
 first_value(CASE WHEN event_type = 'error' THEN t END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id
 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_error,
 lead(event_id) OVER (PARTITION BY user_id ORDER BY t, event_id) AS next_id FROM ev""")
def fills_and_reach(t):
    err = F.when(F.col("event_type") == "error", F.col("t"))
    return ordered_scan(t.points, USER, ["t", "event_id"],
                        [running_max("reach", "hi"), last_known("last_error", err),
                         next_known("next_error", err), lead("next_id", "event_id")]
                        ).select("event_id", "reach", "last_error", "next_error", "next_id")


@query("SIG-01 AGG-30", f"WITH {POINTS}" + """, d AS (SELECT user_id, t AS gap_start,
 lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap_end FROM ev)
SELECT user_id, gap_start, gap_end, gap_end - gap_start AS length_us FROM d WHERE gap_end - gap_start > 21600000000""")
def gaps(t):
    """Stretches of more than six hours without an event."""
    nxt = ordered_scan(t.points.select("user_id", "event_id", "t"), USER, ["t", "event_id"], [lead("gap_end", "t")])
    return (nxt.where(F.col("gap_end") - F.col("t") > 21_600_000_000)
               .select("user_id", F.col("t").alias("gap_start"), "gap_end",
                       (F.col("gap_end") - F.col("t")).alias("length_us")))


@query("EVT-24", f"WITH {POINTS}, h AS (SELECT unnest([6, 12, 24]) AS gap_h)," + """
d AS (SELECT gap_h, user_id, t, event_id, t - lag(t) OVER (PARTITION BY gap_h, user_id ORDER BY t, event_id) AS isi FROM ev, h
  WHERE event_type = 'purchase'),
l AS (SELECT gap_h, user_id, sum(CASE WHEN isi > gap_h * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY gap_h, user_id
  ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM d),
s AS (SELECT gap_h, user_id, g, count(*) AS n FROM l GROUP BY ALL)
SELECT gap_h, user_id, count(*) AS n_clusters, max(n) AS largest FROM s GROUP BY gap_h, user_id""")
def clusters(t):
    """Clusters of events under three gap limits."""
    from tidemark.operators.events import cluster_counts
    pts = t.points.where("event_type = 'purchase'").select("user_id", "t")
    return cluster_counts(pts, USER, "t", {6: 6 * 3_600_000_000, 12: 12 * 3_600_000_000, 24: 24 * 3_600_000_000})


@query("SIG-03 SIG-21", f"WITH {POINTS}" + """, n AS (SELECT user_id, t, event_id, value >= 25 AS m,
 row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ev),
k AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM n WHERE m)
SELECT user_id, min(n) AS first_n, max(n) AS last_n, count(*) AS length FROM k GROUP BY user_id, g""")
def mask_runs(t):
    """Maximal runs of consecutive samples satisfying a predicate."""
    n = ordered_scan(t.points.select("user_id", "t", "event_id", "value"), USER, ["t", "event_id"], [position("n")])
    runs = islands(n.where("value >= 25").select("user_id", F.col("n").alias("first_n"), F.col("n").alias("last_n")),
                   USER, "first_n", "last_n", gap=1, measures={"length": ("count", "first_n")})
    return runs
