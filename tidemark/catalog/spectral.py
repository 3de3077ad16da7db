"""Spectra, whole-block envelopes, peaks and threshold variants on event values per subject (sample index = row number)."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.signals import SIG, USER, W, chunks, samples
from tidemark.catalog.stats import B, pct
from tidemark.config import TransientConfig
from tidemark.operators import signal as sg
from tidemark.operators import spectra as sp
from tidemark.operators.peaks import find_peaks
from tidemark.plans import detect, sensitivity
from tidemark.session import durable

FS, WINDOW = 256.0, 32


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- whole-block envelope

ENVELOPE = f"""{SIG}, u AS (SELECT user_id, n, x / 100 AS x, count(*) OVER (PARTITION BY user_id) AS total FROM s),
h AS (SELECT a.user_id, a.n, a.x, sum(CASE WHEN a.n = b.n THEN 0 WHEN a.total % 2 = 0 THEN CASE WHEN (a.n - b.n) % 2 = 0 THEN 0 ELSE 2 * b.x / tan(pi() * (a.n - b.n) / a.total) END
 ELSE b.x * (1 / tan(pi() * (a.n - b.n) / a.total) - CASE WHEN (a.n - b.n) % 2 = 0 THEN 1 ELSE -1 END / sin(pi() * (a.n - b.n) / a.total)) END / a.total) AS y
 FROM u a JOIN u b ON a.user_id = b.user_id GROUP BY a.user_id, a.n, a.x), e AS (SELECT user_id, n, sqrt(x * x + y * y) AS envelope FROM h)"""


@query("SIG-12", f"WITH {ENVELOPE} SELECT user_id, n, round(envelope, 6) AS envelope, round(avg(envelope ** 4) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS energy FROM e")
def analytic_energy(t):
    """Envelope of the analytic signal of each whole series, and the moving mean of its fourth power."""
    scaled = chunks(t).withColumn("samples", F.transform("samples", lambda x: x / 100))
    both = sg.energy(sp.analytic_envelope(scaled, USER), USER, 6)
    return rounded(sg.to_samples(both, USER, ["envelope", "energy"]), "envelope", "energy")


# ---------------------------------------------------------------- windows

def density(source: str, name: str, bins: str, taper: str, extra: str = "", w: int = WINDOW) -> str:
    """SQL: one-sided densities ``p`` by bin ``k`` (1 Hz) of half-overlapping windows of ``source`` (user_id, n, x), at 256 Hz."""
    return f"""{name}_w AS (SELECT user_id, n // {w // 2} - j AS b, n - (n // {w // 2} - j) * {w // 2} AS i, x, max(n) OVER (PARTITION BY user_id) + 1 AS total FROM {source}, (SELECT unnest([0, 1]) AS j)),
{name}_x AS (SELECT user_id, b, i, x * ({taper}) AS y FROM {name}_w WHERE b >= 0 AND b * {w // 2} + {w} <= total {extra}),
{name} AS (SELECT user_id, b, k, 2 * (sum(y * cos(2 * pi() * k * i / 256)) ** 2 + sum(y * sin(2 * pi() * k * i / 256)) ** 2) / (256 * (SELECT sum(({taper}) ** 2) FROM range({w}) AS r(i))) AS p
 FROM {name}_x, {bins} GROUP BY user_id, b, k)"""


HAMMING, HANN = "0.54 - 0.46 * cos(2 * pi() * i / 31)", "0.5 - 0.5 * cos(2 * pi() * i / 31)"
BAND = lambda a, b: f"sum(CASE WHEN k = {a} OR k = {b} THEN p / 2 WHEN k > {a} AND k < {b} THEN p ELSE 0 END)"
WINDOWS = f"""{SIG}, {density('s', 'd', '(SELECT unnest(generate_series(15, 70)) AS k)', HAMMING)},
sw AS (SELECT user_id, b * 16 AS n, greatest(0, {BAND(15, 70)} - {BAND(48, 52)}) AS p_scale, 10 * log10({BAND(49, 51)} / (({BAND(45, 48)} + {BAND(52, 55)}) / 2)) AS ratio_db FROM d GROUP BY user_id, b)"""


@query("SIG-17", f"WITH {WINDOWS} SELECT user_id, n, round(p_scale, 6) AS p_scale, round(ratio_db, 6) AS ratio_db FROM sw")
def spectral_windows(t):
    """Band power and mains ratio of every half-overlapping window, across chunk borders."""
    return rounded(sp.window_spectra(chunks(t), USER, FS, WINDOW), "p_scale", "ratio_db")


QUALITY = f"""{WINDOWS}, v AS (SELECT s.user_id, CAST(round(s.x * 100) AS BIGINT) AS x, event_type <> 'error' AS ok FROM s JOIN events USING (event_id)), g AS (SELECT * FROM v WHERE ok),
sig AS (SELECT user_id, sqrt(median(p_scale)) AS sigma, median(ratio_db) AS ratio, max(ratio_db) AS top, 100 * avg((ratio_db > 3)::INT) AS high FROM sw GROUP BY user_id),
rk AS (SELECT user_id, ratio_db, row_number() OVER (PARTITION BY user_id ORDER BY ratio_db) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM sw), p95 AS (SELECT user_id, {pct(95, 'ratio_db', 'p95')} FROM rk GROUP BY user_id),
q AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY x) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM g), iq AS (SELECT user_id, {pct(25, 'x', 'q25')}, {pct(75, 'x', 'q75')} FROM q GROUP BY user_id),
m AS (SELECT user_id, median(x) AS med FROM g GROUP BY user_id), mad AS (SELECT user_id, median(abs(x - med)) AS mad FROM g JOIN m USING (user_id) GROUP BY user_id),
st AS (SELECT user_id, min(dx) AS step, count(*) AS n_distinct FROM (SELECT user_id, x - lag(x) OVER (PARTITION BY user_id ORDER BY x) AS dx FROM (SELECT DISTINCT user_id, x FROM g)) GROUP BY user_id),
na AS (SELECT user_id, 100 * avg((NOT ok)::INT) AS pct_nan FROM v GROUP BY user_id)
SELECT user_id, round(sigma, 6) AS sigma_band, round(ratio, 6) AS line_ratio_db, p95 AS line_ratio_p95_db, round(top, 6) AS line_ratio_max_db, round(high, 6) AS pct_time_line_high,
 round(1.4826 * CASE WHEN mad = 0 THEN 1 ELSE mad END, 6) AS mad, CAST(step AS DOUBLE) AS step, n_distinct, round(pct_nan, 6) AS pct_nan, round(20 * log10(sigma / step), 6) AS snr_db, round((q75 - q25) / step, 6) AS adc_span
FROM na LEFT JOIN sig USING (user_id) LEFT JOIN p95 USING (user_id) LEFT JOIN iq USING (user_id) LEFT JOIN mad USING (user_id) LEFT JOIN st USING (user_id)"""


@query("SIG-18 SIG-20", f"WITH {QUALITY}")
def channel_quality(t):
    """Quality of every series: spectral amplitude, mains statistics, scaled deviation, quantisation, span and missing share."""
    s = samples(t).join(t.events.select("event_id", (F.col("event_type") != "error").alias("valid")), "event_id").withColumn("x", F.round(F.col("x") * 100).cast("bigint").cast("double"))
    q = sp.channel_quality(chunks(t), s, USER, USER, FS, WINDOW, threshold_db=3.0)
    num = ("sigma_band", "line_ratio_db", "line_ratio_p95_db", "line_ratio_max_db", "pct_time_line_high", "mad", "pct_nan", "snr_db", "adc_span")
    return rounded(q, *num).select("user_id", "step", "n_distinct", *num)


TAPS = [float(v) for v in sg.band_taps(20.0, 100.0, FS, 64.0)]
PROMINENCE = lambda c, f: f"10 * log10(avg({c}) FILTER (k BETWEEN {f - 1} AND {f + 1}) / median({c}) FILTER (k BETWEEN {f - 5} AND {f - 2} OR k BETWEEN {f + 2} AND {f + 5}))"
NOTCH = f"""{SIG}, c AS (SELECT user_id, n, 0.5 * x + 0.5 * coalesce(lag(x) OVER ({W}), 0) AS x FROM s),
a AS (SELECT user_id, n, x - avg(x) OVER (PARTITION BY user_id) AS x FROM s), b AS (SELECT user_id, n, x - avg(x) OVER (PARTITION BY user_id) AS x FROM c),
{density('a', 'da', '(SELECT unnest(generate_series(5, 105)) AS k)', HANN)}, {density('b', 'db', '(SELECT unnest(generate_series(5, 105)) AS k)', HANN)},
d AS (SELECT user_id, k, pa, pb FROM (SELECT user_id, k, avg(p) AS pa FROM da GROUP BY ALL) JOIN (SELECT user_id, k, avg(p) AS pb FROM db GROUP BY ALL) USING (user_id, k)),
r AS (SELECT user_id, {PROMINENCE('pa', 50)} AS raw_db, {PROMINENCE('pb', 50)} AS clean_db, {PROMINENCE('pa', 100)} - {PROMINENCE('pb', 100)} AS second,
 max(abs(10 * log10(pb / pa))) FILTER (k BETWEEN 5 AND 45) AS low, max(abs(10 * log10(pb / pa))) FILTER (k BETWEEN 55 AND 75) AS high FROM d GROUP BY user_id),
t AS (SELECT unnest({TAPS}) AS tap, unnest(generate_series(-7, 7)) AS j),
fa AS (SELECT o.user_id, o.n, sum(tap * i.x) AS x FROM s o JOIN t ON true JOIN s i ON i.user_id = o.user_id AND i.n = o.n + j GROUP BY o.user_id, o.n),
fb AS (SELECT o.user_id, o.n, sum(tap * i.x) AS x FROM c o JOIN t ON true JOIN c i ON i.user_id = o.user_id AND i.n = o.n + j GROUP BY o.user_id, o.n),
ga AS (SELECT user_id, n, x - avg(x) OVER (PARTITION BY user_id) AS x FROM fa), gb AS (SELECT user_id, n, x - avg(x) OVER (PARTITION BY user_id) AS x FROM fb),
l AS (SELECT gb.user_id, m, sum(ga.x * gb.x) AS s FROM gb JOIN (SELECT unnest(generate_series(-5, 5)) AS m) ON true JOIN ga ON ga.user_id = gb.user_id AND ga.n = gb.n + m GROUP BY gb.user_id, m),
k AS (SELECT user_id, arg_max(m, s) AS lag, max(s) AS s FROM l GROUP BY user_id), z AS (SELECT ga.user_id, sqrt(sum(ga.x ** 2) * sum(gb.x ** 2)) AS norm FROM ga JOIN gb USING (user_id, n) GROUP BY ga.user_id)
SELECT user_id, round(raw_db, 6) AS raw_db, round(clean_db, 6) AS clean_db, round(raw_db - clean_db, 6) AS drop_db, (second > 10)::INT AS n_harmonics, round(low, 6) AS deviation_low_db, round(high, 6) AS deviation_high_db,
 lag, round(k.s / norm, 6) AS lag_r, CASE WHEN raw_db - clean_db < 10 THEN 'not applied' WHEN raw_db - clean_db <= 25 THEN 'partial' ELSE 'applied' END AS verdict,
 greatest(low, high) < 1 AS band_ok, lag = 0 AS phase_ok FROM r JOIN k USING (user_id) JOIN z USING (user_id)"""


@query("SIG-33", f"WITH {NOTCH}")
def notch_report(t):
    """Series before and after a two-point mean: mains prominence, harmonics, change of the bands, lag of the correlation peak."""
    s = durable(samples(t))
    from tidemark.operators.scan import lag, ordered_scan
    after = ordered_scan(s, USER, ["n"], [lag("p", "x")]).withColumn("x", 0.5 * F.col("x") + 0.5 * F.coalesce("p", F.lit(0.0)))
    out = sp.verify_notch(sg.to_chunks(s, USER, length=16), sg.to_chunks(after, USER, length=16), USER, USER, FS, window_s=WINDOW / FS, band=(20.0, 100.0), band_width=64.0, lag_s=5 / FS)
    out = rounded(out, "raw_db", "clean_db", "drop_db", "deviation_low_db", "deviation_high_db", "lag_r")
    return out.withColumn("n_harmonics", F.size("filtered_harmonics")).drop("filtered_harmonics")


# ---------------------------------------------------------------- peaks, thresholds

PEAKS = f"""{SIG}, l AS (SELECT user_id, n, x, lag(x) OVER ({W}) AS px, lead(x) OVER ({W}) AS nx, count(*) OVER (PARTITION BY user_id) AS total FROM s),
r0 AS (SELECT user_id, n, x AS h, px FROM l WHERE px IS NULL OR px <> x), r1 AS (SELECT *, lead(h) OVER ({W}) AS after FROM r0), pk AS (SELECT user_id, n, h FROM r1 WHERE px < h AND after < h),
a AS (SELECT p.user_id, p.n, p.h, max(l.n) FILTER (l.n < p.n AND l.x > p.h) AS lo, min(l.n) FILTER (l.n > p.n AND l.x > p.h) AS hi FROM pk p JOIN l ON l.user_id = p.user_id GROUP BY ALL),
b AS (SELECT a.user_id, a.n, h, h - greatest(min(x) FILTER (l.n < a.n AND l.n > coalesce(lo, -1)), min(x) FILTER (l.n > a.n AND l.n < coalesce(hi, 1000000))) AS prominence FROM a JOIN l ON l.user_id = a.user_id GROUP BY a.user_id, a.n, h),
c AS (SELECT b.user_id, b.n, h, prominence, coalesce(arg_max(l.n + (lv - l.x) / (l.nx - l.x), l.n) FILTER (l.n < b.n AND l.n >= b.n - 8 AND l.x <= lv), greatest(0, b.n - 8)) AS a,
 coalesce(arg_min(l.n - (lv - l.x) / (l.px - l.x), l.n) FILTER (l.n > b.n AND l.n <= b.n + 8 AND l.x <= lv), least(max(total) - 1, b.n + 8)) AS z
 FROM (SELECT *, h - prominence / 2 AS lv FROM b WHERE prominence >= 5) b JOIN l ON l.user_id = b.user_id GROUP BY b.user_id, b.n, h, prominence), q AS (SELECT user_id, n, h, prominence FROM c WHERE z - a <= 6)"""
# Walks the peaks of one run, tallest first, and keeps those farther than three samples from all kept before.
KEEP = "unnest(list_reduce(list([n] ORDER BY h DESC, n), lambda a, b: CASE WHEN len(list_filter(a, lambda y: abs(y - b[1]) <= 3)) > 0 THEN a ELSE list_concat(a, b) END))"


@query("SIG-25 SIG-31", f"WITH {PEAKS}, k AS (SELECT user_id, {KEEP} AS n FROM q WHERE h >= 15 GROUP BY user_id) "
       "SELECT user_id, n, round(h, 4) AS h, round(prominence, 4) AS prominence FROM k JOIN q USING (user_id, n)")
def signal_peaks(t):
    """Peaks of every subject's value series by height, prominence, width and distance (whole series)."""
    c = chunks(t).withColumn("height", F.lit(15.0))
    return find_peaks(c, USER, prominence=5.0, width=6, distance=3).select("user_id", "n", F.round("h", 4).alias("h"), F.round("prominence", 4).alias("prominence"))


#: Series at one sample a second: the rules below in samples.
RULES = TransientConfig(baseline_start=20, baseline_step=5, baseline_top=50, baseline_fraction=0.9, lower_factor=0.6, upper=90, prominence=5, distance_s=3, width_s=6,
                        spike_gap_ms=4000, burst_gap_s=20, burst_min_n=1, burst_min_s=4, burst_max_s=60)
FIXED, PERCENTILES = (10.0, 20.0, 40.0), (50.0, 90.0)
NAMES = ("actual", "fixed_10", "fixed_20", "fixed_40", "p50", "p90")
VARIANTS = f"""{PEAKS}, er AS (SELECT s.user_id, n FROM s JOIN events USING (event_id) WHERE event_type = 'error'),
inc AS (SELECT user_id, n, x, row_number() OVER (PARTITION BY user_id ORDER BY x) AS k, count(*) OVER (PARTITION BY user_id) AS total FROM s WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.user_id = s.user_id AND abs(er.n - s.n) <= 1)),
fr AS (SELECT user_id, v, avg((x < v)::INT) AS f FROM inc, (SELECT unnest(generate_series(20, 50, 5)) AS v) GROUP BY ALL),
vh AS (SELECT user_id, 'actual' AS variant, CAST((coalesce(min(v) FILTER (f >= 0.9) - 5, 45)) * 0.6 AS DOUBLE) AS height FROM fr GROUP BY user_id
 UNION ALL SELECT DISTINCT user_id, 'fixed_' || f, f FROM inc, (SELECT unnest([10, 20, 40]) AS f)
 UNION ALL SELECT user_id, 'p50', {pct(50, 'x', 'h').removesuffix(' AS h')} FROM inc GROUP BY user_id UNION ALL SELECT user_id, 'p90', {pct(90, 'x', 'h').removesuffix(' AS h')} FROM inc GROUP BY user_id),
kp AS (SELECT q.user_id, variant, {KEEP} AS n FROM q JOIN vh ON vh.user_id = q.user_id AND h >= height GROUP BY q.user_id, variant),
ki AS (SELECT kp.user_id, variant, n FROM kp JOIN q USING (user_id, n) WHERE h <= 90 AND NOT EXISTS (SELECT 1 FROM er WHERE er.user_id = kp.user_id AND abs(er.n - kp.n) <= 1)),
cg AS (SELECT *, sum(o) OVER (PARTITION BY user_id, variant ORDER BY n) AS g FROM (SELECT *, coalesce((n - lag(n) OVER (PARTITION BY user_id, variant ORDER BY n) > 4)::INT, 1) AS o FROM ki)),
cx AS (SELECT user_id, variant, min(n) AS a, count(*) AS spikes FROM cg GROUP BY user_id, variant, g),
bg AS (SELECT *, sum(o) OVER (PARTITION BY user_id, variant ORDER BY a) AS g FROM (SELECT *, coalesce((a - lag(a) OVER (PARTITION BY user_id, variant ORDER BY a) > 20)::INT, 1) AS o FROM cx)),
bu AS (SELECT user_id, variant, count(*) AS n_bursts FROM (SELECT user_id, variant, g FROM bg GROUP BY ALL HAVING count(*) > 1 AND max(a) - min(a) > 4 AND max(a) - min(a) < 60) GROUP BY ALL),
cc AS (SELECT user_id, variant, count(*) AS n_complexes, count(*) FILTER (spikes = 1) AS n_single, count(*) FILTER (spikes > 1) AS n_polyspike FROM cx GROUP BY ALL),
mi AS (SELECT user_id, count(*) / 60.0 AS minutes FROM inc GROUP BY user_id),
tv AS (SELECT user_id, variant, height, coalesce(n_complexes, 0) AS n_complexes, coalesce(n_single, 0) AS n_single, coalesce(n_polyspike, 0) AS n_polyspike, coalesce(n_bursts, 0) AS n_bursts, minutes
 FROM vh JOIN mi USING (user_id) LEFT JOIN cc USING (user_id, variant) LEFT JOIN bu USING (user_id, variant))"""


def variants_of(t):
    """Counts of every variant per series: one search of the peaks, zones of one sample around errors left out."""
    s = samples(t).join(t.events.select("event_id", "event_type"), "event_id").withColumnRenamed("user_id", "channel_id").withColumn("block_id", F.lit(0))
    s = durable(s)
    zones = s.where("event_type = 'error'").select("channel_id", (F.col("n") - 1).cast("double").alias("lo"), (F.col("n") + 1).cast("double").alias("hi"))
    c = sg.to_chunks(s, detect.BLOCK, length=16)
    inside = durable(sg.outside_zones(c, zones, detect.BLOCK, detect.CHANNEL))
    variants = durable(sensitivity.variant_heights(detect.baseline_heights(inside, RULES), inside, FIXED, PERCENTILES))
    pk = durable(detect.peaks_by_height(c, zones, variants.select("channel_id", "height").distinct(), 1.0, RULES))
    cx, bs = detect.grouped_peaks(pk, [*detect.BLOCK, "height"], 1.0, RULES)
    minutes = inside.groupBy("channel_id").agg((F.count(F.lit(1)) / F.lit(60)).alias("minutes"))
    return durable(sensitivity.counts_by_height(cx, bs, variants).join(minutes, "channel_id").withColumnRenamed("channel_id", "user_id"))


@query("SIG-26", f"WITH {VARIANTS} SELECT user_id, variant, round(height, 6) AS height, n_complexes, n_single, n_polyspike, n_bursts, round(minutes, 6) AS minutes FROM tv")
def threshold_sensitivity(t):
    """Transients of every threshold variant; the SQL searches the peaks of every threshold anew."""
    return rounded(variants_of(t), "height", "minutes")


@query("AGG-24", f"WITH {VARIANTS} SELECT user_id, " + ", ".join(
    f"round(max(height) FILTER (variant = '{v}'), 6) AS height_{v}, round(max(n_complexes / minutes) FILTER (variant = '{v}'), 6) AS cx_min_{v}" for v in NAMES) + " FROM tv GROUP BY user_id")
def sensitivity_channels(t):
    """One row per series: height and complexes per minute of every variant (long to wide)."""
    wide = sensitivity.wide(variants_of(t), USER, NAMES)
    return rounded(wide, *[c for c in wide.columns if c != "user_id"])


@query("AGG-24", f"WITH {VARIANTS} SELECT user_id % 20 AS subject, variant, round(median(height), 6) AS median_height, CAST(sum(n_complexes) AS BIGINT) AS n_complexes, round(sum(n_complexes) / sum(minutes), 6) AS complexes_per_min, "
       "round(sum(n_single) / sum(minutes), 6) AS single_per_min, round(sum(n_polyspike) / sum(minutes), 6) AS polyspikes_per_min, round(60 * sum(n_bursts) / sum(minutes), 6) AS bursts_per_h FROM tv GROUP BY ALL")
def sensitivity_subjects(t):
    """Variants pooled over the series of a subject."""
    out = sensitivity.by_subject(variants_of(t).withColumn("subject", F.col("user_id") % 20), ["subject"])
    return rounded(out, "median_height", *sensitivity.RATES).select("subject", "variant", "median_height", "n_complexes", *sensitivity.RATES)


@query("AGG-24 STAT-12")
def sensitivity_groups(t):
    """Every variant and rate compared between two groups (10,000 replicates), with its rank correlation to the subject's mean value."""
    subjects = sensitivity.by_subject(variants_of(t), USER)
    info = t.events.groupBy("user_id").agg(F.avg("value").alias("outcome")).withColumn("grp", F.when(F.col("user_id") % 3 == 0, "case").otherwise("control"))
    return sensitivity.by_group(subjects.join(info, "user_id"), "user_id", "grp", "case", "control", "outcome", B, 11)
