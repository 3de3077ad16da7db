"""Signal operators on event values per subject (sample index = row number) and embedding arrays."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.operators import signal as sg
from tidemark.operators.events import numbered

USER = ["user_id"]
SIG = """s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x FROM events)"""
W = "PARTITION BY user_id ORDER BY n"


def samples(t):
    pts = t.points.select("user_id", "event_id", "t", F.col("value").alias("x"))
    return numbered(pts, USER, ["t", "event_id"], "n").withColumn("n", F.col("n") - 1).drop("t")


def chunks(t, length=16):
    return sg.to_chunks(samples(t), USER, length=length)


def rounded(df, column, digits=6):
    return df.select("user_id", "n", F.round(column, digits).alias(column))


@query("WIN-02 UDF-01", f"WITH {SIG} SELECT user_id, n, round(avg(x) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM s")
def moving_mean(t):
    """Centred moving mean of six samples, shrinking at the ends, on chunks with halos."""
    return rounded(sg.to_samples(sg.moving(chunks(t), USER, 6, out="smooth"), USER, ["smooth"]), "smooth")


@query("SIG-14", f"WITH {SIG}, d AS (SELECT *, coalesce(abs(x - lag(x) OVER ({W})), abs(lead(x) OVER ({W}) - x), 0) AS d FROM s) "
       f"SELECT user_id, n, round(sum(d) OVER ({W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS line_length FROM d")
def line_length(t):
    return rounded(sg.to_samples(sg.line_length(chunks(t), USER, 9), USER, ["line_length"]), "line_length")


@query("SIG-29 FN-07", f"WITH {SIG}, " + ", ".join(
    f"w{m} AS (SELECT user_id, n, coalesce(sum(x) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {m // 2} FOLLOWING), 0) - coalesce(sum(x) OVER ({W} ROWS BETWEEN {m // 2 - 1} PRECEDING AND CURRENT ROW), 0) AS v FROM s)"
    for m in (4, 8, 16)) + " SELECT user_id, n, round(abs(w4.v + w8.v + w16.v), 6) AS walsh FROM w4 JOIN w8 USING (user_id, n) JOIN w16 USING (user_id, n)")
def walsh(t):
    return rounded(sg.to_samples(sg.walsh(chunks(t), USER), USER, ["walsh"]), "walsh")


@query("SIG-05 SIG-04", f"WITH {SIG} SELECT user_id, n, round(0.1 * coalesce(lead(x, 2) OVER ({W}), 0) + 0.2 * coalesce(lead(x) OVER ({W}), 0) + 0.4 * x "
       f"+ 0.2 * coalesce(lag(x) OVER ({W}), 0) + 0.1 * coalesce(lag(x, 2) OVER ({W}), 0), 6) AS filtered FROM s")
def fir_filter(t):
    """Symmetric FIR on chunks equals the filter over the whole block."""
    import numpy as np
    out = sg.fir(chunks(t), USER, np.array([0.1, 0.2, 0.4, 0.2, 0.1]), out="filtered")
    return rounded(sg.to_samples(out, USER, ["filtered"]), "filtered")


@query("SIG-07 SIG-09", f"WITH {SIG}, m AS (SELECT user_id, median(x) AS med, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM s GROUP BY user_id), "
       "d AS (SELECT user_id, CASE WHEN median(abs(x - med)) = 0 THEN 1 ELSE median(abs(x - med)) END AS mad FROM s JOIN m USING (user_id) GROUP BY user_id), "
       "p AS (SELECT user_id, 100 * avg(CASE WHEN x < med - 3 * mad OR x > med + 3 * mad THEN 1.0 ELSE 0.0 END) AS pct FROM s JOIN m USING (user_id) JOIN d USING (user_id) GROUP BY user_id) "
       "SELECT user_id, round(med, 6) AS median, round(mad, 6) AS mad, round(sd, 6) AS std, mn AS min, mx AS max, round(pct, 6) AS pct_flagged, "
       "round(CASE WHEN pct > 10 THEN -30 ELSE med - 3 * mad END, 6) AS lower, round(CASE WHEN pct > 10 THEN 30 ELSE med + 3 * mad END, 6) AS upper, "
       "CASE WHEN pct > 10 THEN 'fixed' ELSE 'automatic' END AS threshold_type FROM m JOIN d USING (user_id) JOIN p USING (user_id)")
def robust_limits(t):
    """Median, MAD and the outlier limits they give, with the switch to fixed limits."""
    s = samples(t)
    st = sg.robust_stats(s, USER)
    out = st.join(sg.outlier_limits(st, s, USER, 3.0, 10.0, (-30.0, 30.0)), USER)
    num = ("median", "mad", "std", "pct_flagged", "lower", "upper")
    return out.select("user_id", "min", "max", "threshold_type", *[F.round(c, 6).alias(c) for c in num])


GOOD = f"""g AS (SELECT *, CASE WHEN x BETWEEN 2 AND 25 THEN n END AS gn, CASE WHEN x BETWEEN 2 AND 25 THEN x END AS gx FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n) AS j, count(*) OVER (PARTITION BY user_id) AS c FROM g WHERE gn IS NOT NULL),
e AS (SELECT user_id, max(CASE WHEN j = 1 THEN n END) AS a1, max(CASE WHEN j = 1 THEN x END) AS v1, max(CASE WHEN j = 2 THEN n END) AS a2, max(CASE WHEN j = 2 THEN x END) AS v2,
 max(CASE WHEN j = c THEN n END) AS b1, max(CASE WHEN j = c THEN x END) AS w1, max(CASE WHEN j = c - 1 THEN n END) AS b2, max(CASE WHEN j = c - 1 THEN x END) AS w2 FROM k GROUP BY user_id),
f AS (SELECT *, last_value(gn IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS pn, last_value(gx IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS px,
 first_value(gn IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qn, first_value(gx IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qx FROM g)"""


@query("SIG-08 WIN-08", f"WITH {SIG}, {GOOD} SELECT f.user_id, n, gn IS NULL AS is_outlier, round(CASE WHEN gn IS NOT NULL THEN x "
       "WHEN pn IS NOT NULL AND qn IS NOT NULL THEN px + (n - pn) / (qn - pn) * (qx - px) WHEN a2 IS NULL OR a1 IS NULL THEN x "
       "WHEN pn IS NULL THEN v1 + (n - a1) / (a2 - a1) * (v2 - v1) ELSE w2 + (n - b2) / (b1 - b2) * (w1 - w2) END, 6) AS clean FROM f LEFT JOIN e USING (user_id)")
def outlier_interpolation(t):
    """Out-of-range samples replaced by linear inter- and extrapolation."""
    out = sg.replace_outliers(samples(t), USER, F.lit(2), F.lit(25))
    return out.select("user_id", "n", "is_outlier", F.round("clean", 6).alias("clean"))


@query("SIG-10", f"WITH {SIG}, m AS (SELECT user_id, min(x) AS a, max(x) AS b FROM s GROUP BY user_id) SELECT user_id, n, round((x - a) / nullif(b - a, 0), 6) AS norm FROM s JOIN m USING (user_id)")
def normalised(t):
    return rounded(sg.normalise(samples(t), USER), "norm")


@query("SIG-13", f"WITH {SIG}, m AS (SELECT user_id, median(x * x) AS median FROM s GROUP BY user_id) SELECT user_id, round(median, 6) AS median, round(median * 10, 6) AS threshold, "
       "round(100 * avg(CASE WHEN x * x > median * 10 THEN 1.0 ELSE 0.0 END), 6) AS pct_above FROM s JOIN m USING (user_id) GROUP BY user_id, median")
def energy_threshold(t):
    """Global threshold per channel: ten times the exact median of the energy."""
    out = sg.global_threshold(samples(t).withColumn("e", F.col("x") * F.col("x")), USER, "e", 10.0)
    return out.select("user_id", *[F.round(c, 6).alias(c) for c in ("median", "threshold", "pct_above")])


@query("SIG-23", f"WITH {SIG}, f AS (SELECT user_id, v, avg(CASE WHEN abs(x) < v THEN 1.0 ELSE 0.0 END) AS fr FROM s, (SELECT unnest(generate_series(20, 50, 5)) AS v) GROUP BY ALL) "
       "SELECT user_id, round(coalesce(min(v) FILTER (fr >= 0.9) - 5, 45), 1) AS baseline FROM f GROUP BY user_id")
def baseline_grid(t):
    """Smallest rung with 90 % of |x| below it, minus one step."""
    out = sg.baseline_ladder(samples(t), USER, "x", range(20, 51, 5), 0.9, 5, 50)
    return out.select("user_id", F.round("baseline", 1).alias("baseline"))


@query("SIG-21", f"WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, floor(value / 20) AS x FROM events), "
       "r AS (SELECT user_id, x, n - row_number() OVER (PARTITION BY user_id, x ORDER BY n) AS g FROM s), l AS (SELECT user_id, count(*) AS c FROM r GROUP BY user_id, x, g) "
       "SELECT user_id, round(sum(CASE WHEN c >= 5 THEN c ELSE 0 END) / sum(c), 6) AS flat_fraction FROM l GROUP BY user_id")
def flat_fraction(t):
    """Share of samples in runs of at least five equal (coarsened) values."""
    s = samples(t).withColumn("x", F.floor(F.col("x") / 20))
    return sg.flat_fraction(s, USER, 5, USER).select("user_id", F.round("flat_fraction", 6).alias("flat_fraction"))


@query("SIG-22", f"WITH {SIG}, r AS (SELECT user_id, n, n - row_number() OVER ({W}) AS g FROM s WHERE abs(x) < 12) "
       "SELECT user_id, min(n) AS first_n, max(n) AS last_n FROM r GROUP BY user_id, g HAVING count(*) > 4")
def flat_segments(t):
    return sg.low_segments(samples(t), USER, 12.0, 4)


@query("SIG-19 SIG-20", f"WITH {SIG}, d AS (SELECT DISTINCT user_id, CAST(round(x * 100) AS BIGINT) AS x FROM s), l AS (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY x) AS d FROM d), "
       "q AS (SELECT user_id, min(d) AS step, count(*) AS n_distinct FROM l GROUP BY user_id) "
       "SELECT q.user_id, step, n_distinct, round(100 * avg(CASE WHEN abs(round(x * 100) - 100) <= step / 2.0 OR abs(round(x * 100) - 3000) <= step / 2.0 THEN 1.0 ELSE 0.0 END), 6) AS pct_clipped "
       "FROM q JOIN s USING (user_id) GROUP BY ALL")
def quantisation(t):
    """Quantisation step, distinct values and share of clipped samples."""
    s = samples(t).withColumn("x", F.round(F.col("x") * 100).cast("bigint"))
    q = sg.quantisation_step(s, USER)
    dims = q.select("user_id", "step", F.lit(100).alias("phys_min"), F.lit(3000).alias("phys_max"))
    return q.join(sg.clipped_share(s, dims, USER), USER).select("user_id", "step", "n_distinct", F.round("pct_clipped", 6).alias("pct_clipped"))


@query("SIG-30 WIN-10", f"WITH {SIG} SELECT user_id, n, bool_or(x > 30) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM s")
def dilation(t):
    out = sg.dilate(samples(t).withColumn("hit", F.col("x") > 30), USER, "hit", 2)
    return out.select("user_id", "n", "dilated")


@query("SIG-27", f"WITH {SIG}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM s), b AS (SELECT *, n // CAST(ceil(c / 10.0) AS BIGINT) AS b FROM c WHERE c > 20), "
       "e AS (SELECT user_id, arg_min(n, struct_pack(x := x, n := n)) AS i, min(x) AS lo, arg_max(n, struct_pack(x := x, n := -n)) AS j, max(x) AS hi FROM b GROUP BY user_id, b) "
       "SELECT user_id, i AS n, lo AS x FROM e UNION ALL SELECT user_id, j, hi FROM e UNION ALL SELECT user_id, n, x FROM c WHERE c <= 20")
def decimated(t):
    """Min and max per bucket for a ten-bucket display series."""
    return sg.decimate(samples(t), USER, 10).select("user_id", "n", "x")


@query("SIG-32", "SELECT event_type, CAST(least(floor(value / 1.5), 99) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 150 GROUP BY ALL")
def amplitude_histogram(t):
    return sg.histogram(t.events, ["event_type"], "value", 0.0, 150.0, 100)


@query("SIG-34", """SELECT event_type AS region, CAST(hour(ts) AS INTEGER) AS hour, median(value) FILTER (user_id % 2 = 0) AS a, median(value) FILTER (user_id % 2 = 1) AS b,
 median(value) FILTER (user_id % 2 = 0) / median(value) FILTER (user_id % 2 = 1) BETWEEN 0.8 AND 1.25 AS compatible FROM events GROUP BY ALL""")
def source_compatibility(t):
    """Amplitude of two sources per region and hour, and whether their ratio is acceptable."""
    from tidemark.operators.quality import source_ratio
    x = t.events.select(F.col("event_type").alias("region"), F.hour("ts").alias("hour"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("source"), "value")
    return source_ratio(x, ["region", "hour"], "source", "a", "b", "value", (0.8, 1.25))


@query("SIG-15 SIG-35 CHK-10", f"WITH {SIG}, k AS (SELECT *, n - row_number() OVER ({W}) AS g FROM s WHERE x > 12), r AS (SELECT user_id, min(n) AS a, max(n) AS b FROM k GROUP BY user_id, g HAVING count(*) >= 2), "
       "m AS (SELECT user_id, median(x) AS med FROM s GROUP BY user_id) "
       "SELECT r.user_id, a AS event_id, count(*) AS n_samples, round(median(x) / med, 6) AS ll_ratio, round(max(x) / 12, 6) AS peak_energy_ratio, round(avg(x) / 12, 6) AS mean_energy_ratio, "
       "round(sum(x) / 12, 6) AS auc_ratio, round(stddev_samp(x) / avg(x), 6) AS envelope_cv FROM r JOIN s ON s.user_id = r.user_id AND n BETWEEN a AND b JOIN m ON m.user_id = r.user_id GROUP BY r.user_id, a, med")
def event_metrics(t):
    """Trace metrics of every run above 12: events meet chunks by range join, medians are exact."""
    from tidemark.operators.events import threshold_runs
    from tidemark.operators.quantiles import exact_median
    s = samples(t)
    runs = threshold_runs(s, USER, "n", F.col("x") > 12).where("n_samples >= 2").withColumn("event_id", F.col("first_n")).drop("n_samples")
    c = sg.to_chunks(s, USER, length=16).withColumnRenamed("samples", "energy").withColumn("line_length", F.col("energy"))
    th = exact_median(s, USER, "x", "ll_median").withColumn("threshold", F.lit(12.0))
    out = sg.event_metrics(runs, c, USER, th, USER)
    num = ("ll_ratio", "peak_energy_ratio", "mean_energy_ratio", "auc_ratio", "envelope_cv")
    return out.select("user_id", "event_id", "n_samples", *[F.round(m, 6).alias(m) for m in num])


@query("SIG-17", """WITH v AS (SELECT vec_id, embedding AS e, len(embedding) AS m FROM embeddings),
x AS (SELECT vec_id, i, m, CAST(e[i + 1] AS DOUBLE) * (0.54 - 0.46 * cos(2 * pi() * i / (m - 1))) AS y, (0.54 - 0.46 * cos(2 * pi() * i / (m - 1))) ** 2 AS w FROM v, (SELECT unnest(generate_series(0, 1023)) AS i) WHERE i < m),
d AS (SELECT vec_id, k, sum(y * cos(2 * pi() * k * i / 256)) AS re, sum(y * sin(2 * pi() * k * i / 256)) AS im, sum(w) AS w FROM x, (SELECT unnest(generate_series(10, 40)) AS k) GROUP BY ALL),
p AS (SELECT vec_id, k, 2 * (re * re + im * im) / (256 * w) AS p FROM d)
SELECT vec_id, round(sum(CASE WHEN k IN (10, 40) THEN p / 2 ELSE p END), 6) AS power FROM p GROUP BY vec_id""")
def band_power(t):
    """Band power of short array signals (Hamming periodogram, trapezoid over 10..40 Hz at 256 Hz)."""
    from tidemark.operators.quality import array_band_power
    return t.embeddings.select("vec_id", F.round(array_band_power(256.0, 10.0, 40.0)(F.col("embedding").cast("array<double>")), 6).alias("power"))


@query("SIG-37 FN-04", f"WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x, CAST(json_extract(props, '$.k') AS DOUBLE) AS y FROM events), "
       f"d AS (SELECT *, coalesce(sqrt((x - lag(x) OVER ({W})) ** 2 + (y - lag(y) OVER ({W})) ** 2), 0) AS d FROM s), "
       f"c AS (SELECT *, sum(d) OVER ({W}) AS c FROM d) "
       "SELECT a.user_id, 1 AS query_id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) AS displacement, round(b.c - a.c, 6) AS path_length FROM c a JOIN c b ON a.user_id = b.user_id AND a.n = 5 AND b.n = 30")
def track_distance(t):
    """Displacement and path length between 0.5 s and 3 s of a 10 Hz track."""
    y = F.get_json_object("props", "$.k").cast("double")
    pts = t.points.select("user_id", "event_id", "t", F.col("value").alias("pos_x"), y.alias("pos_y"))
    tr = numbered(pts, USER, ["t", "event_id"], "n").withColumn("n", F.col("n") - 1)
    q = tr.select("user_id").distinct().select("user_id", F.lit(1).alias("query_id"), F.lit(0.5).alias("a"), F.lit(3.0).alias("b"))
    out = sg.path_length(tr, q, USER, 10.0)
    return out.select("user_id", "query_id", F.round("displacement", 6).alias("displacement"), F.round("path_length", 6).alias("path_length"))


REC = """r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS record_ix, (epoch_us(ts) // 60000000) * 60.0 AS onset_s FROM events),
d AS (SELECT *, lead(onset_s) OVER (PARTITION BY user_id ORDER BY record_ix) - onset_s - 36000 AS dev FROM r),
k AS (SELECT *, CASE WHEN dev IS NULL OR abs(dev) <= 600 THEN 'none' WHEN dev >= 14400 THEN 'gap' WHEN dev <= -14400 THEN 'anomaly' ELSE 'jitter' END AS kind FROM d)"""


@query("SIG-01 SIG-02 STR-03", f"WITH {REC} SELECT user_id, record_ix, kind, CAST(coalesce(sum(4 + CASE WHEN kind = 'gap' THEN round(dev * 0.001) ELSE 0 END) OVER w, 0) AS BIGINT) AS n0, "
       "CAST(coalesce(sum(CASE WHEN kind = 'gap' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS block_id FROM k "
       "WINDOW w AS (PARTITION BY user_id ORDER BY record_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def record_placement(t):
    """Gaps, jitter and anomalies between records, and each record's first sample and block."""
    pts = numbered(t.points.select("user_id", "event_id", "t"), USER, ["t", "event_id"], "record_ix")
    r = pts.select("user_id", (F.col("record_ix") - 1).alias("record_ix"), (F.floor(F.col("t") / 60_000_000) * 60.0).alias("onset_s"), F.lit(36000.0).alias("dur"))
    g = sg.record_gaps(r, USER, "dur", 600.0, 14400.0)
    return sg.place_records(g, USER, F.lit(0.001), F.lit(4)).select("user_id", "record_ix", "kind", "n0", "block_id")
