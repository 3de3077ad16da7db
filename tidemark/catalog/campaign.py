"""Zones, channel plans, sensitivity tables and incremental work."""

from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.catalog.registry import POINTS, merged, query
from tidemark.functions import text
from tidemark.operators import events as ev
from tidemark.operators import quality as ql
from tidemark.operators import signal as sg
from tidemark.plans import campaign as cp
from tidemark.sources import edf, store

USER = ["user_id"]
H = 3_600_000_000

LAB = """lab AS (SELECT event_id, user_id, t AS lo, hi, event_id % 5 <> 0 AS in_scope, CASE WHEN value > 25 THEN 'TP' WHEN value < 2 THEN '' ELSE 'FP' END AS label,
 CASE event_type WHEN 'click' THEN 'IIDs' WHEN 'view' THEN 'disconnect' WHEN 'error' THEN 'grooming/scratching' WHEN 'signup' THEN 'other' ELSE 'unrecognized:x' END AS comments FROM ev),
zn AS (SELECT user_id, CASE WHEN event_type = 'click' THEN 'R7' ELSE 'R1' END AS rule, event_id, t AS lo, hi, 'seizures' AS pass_as FROM ev WHERE value > 40
 UNION ALL SELECT user_id, 'crisette', event_id, t, hi, 'seizures' FROM ev WHERE value BETWEEN 30 AND 32
 UNION ALL SELECT user_id, CASE WHEN NOT in_scope AND label = 'TP' THEN 'R1' WHEN label = '' THEN 'R6' WHEN comments = 'grooming/scratching' THEN 'R3' WHEN comments = 'other' THEN 'R4' ELSE 'R6' END, event_id, lo, hi, 'manual'
  FROM lab WHERE (NOT in_scope OR label = 'FP') AND NOT (label = 'FP' AND comments IN ('IIDs', 'disconnect'))
 UNION ALL SELECT user_id, 'R5', event_id, t, hi, 'manual' FROM ev WHERE event_type = 'view' AND value > 22
 UNION ALL SELECT user_id, 'R8', event_id, t, hi, 'manual' FROM ev WHERE event_type = 'error' AND value > 35)"""
CHN = """ch AS (SELECT user_id, event_type AS channel_id0, min(t) AS start, max(t) AS stop FROM ev WHERE event_type IN ('click', 'view') GROUP BY ALL),
cz AS (SELECT c.user_id, c.user_id || '|' || channel_id0 AS channel_id, zn.*, lo - CASE WHEN pass_as = 'seizures' THEN 3600000000 ELSE 0 END - start AS zlo, hi + CASE WHEN pass_as = 'seizures' THEN 3600000000 ELSE 0 END - start AS zhi, stop - start AS dur
 FROM zn JOIN ch c ON c.user_id = zn.user_id AND lo - CASE WHEN pass_as = 'seizures' THEN 3600000000 ELSE 0 END < stop AND hi + CASE WHEN pass_as = 'seizures' THEN 3600000000 ELSE 0 END > start)"""


def labelled(t):
    kind = F.col("event_type")
    comments = (F.when(kind == "click", "IIDs").when(kind == "view", "disconnect").when(kind == "error", "grooming/scratching")
                 .when(kind == "signup", "other").otherwise("unrecognized:x"))
    return t.points.select("event_id", "user_id", F.col("t").alias("lo"), "hi", (F.col("event_id") % 5 != 0).alias("in_scope"),
                           F.when(F.col("value") > 25, "TP").when(F.col("value") < 2, "").otherwise("FP").alias("label"), comments.alias("comments"))


def zones(t):
    p = t.points.select("event_id", "user_id", F.col("t").alias("lo"), "hi", "value", "event_type")
    final = p.where("value > 40").withColumn("has_comment", F.col("event_type") == "click")
    return cp.zone_table(final, p.where("value BETWEEN 30 AND 32"), labelled(t), p.where("event_type = 'view' AND value > 22"),
                         p.where("event_type = 'error' AND value > 35"), "user_id")


def channels(t):
    return t.points.where("event_type IN ('click', 'view')").groupBy("user_id", "event_type").agg(F.min("t").alias("start"), F.max("t").alias("stop")).select(
        "user_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("channel_id"), "start", "stop")


@query("EVT-21 PRJ-14", f"WITH {POINTS}, {LAB} SELECT user_id, rule, CAST(event_id AS VARCHAR) AS origin, lo, hi, pass_as, row_number() OVER (PARTITION BY user_id ORDER BY lo, rule, CAST(event_id AS VARCHAR), pass_as) AS zone_id FROM zn")
def exclusion_zone_table(t):
    """Exclusion zones by rule, numbered per subject."""
    return zones(t)


@query("EVT-22", f"WITH {POINTS}, {LAB}, {CHN} SELECT channel_id, CAST(event_id AS VARCHAR) AS origin, rule, zlo AS lo, zhi AS hi FROM cz")
def channel_zones(t):
    """Zones meeting each channel's span once seizure zones are widened, in channel time."""
    z = zones(t)
    out = cp.channel_zones(z, channels(t), "user_id", H)
    return out.join(z.select("user_id", "zone_id", "origin"), ["user_id", "zone_id"]).select("channel_id", "origin", "rule", "lo", "hi")


@query("EVT-23 EVT-20", f"WITH {POINTS}, {LAB}, {CHN}, cl AS (SELECT channel_id, greatest(zlo, 0) AS lo, least(zhi, dur) AS hi FROM cz), {merged('m', keys='channel_id', source='(SELECT DISTINCT channel_id, lo, hi FROM cl)', lo='lo')}, "
       "x AS (SELECT channel_id, sum(hi - lo) AS off FROM m GROUP BY 1), n AS (SELECT channel_id, count(*) FILTER (pass_as = 'seizures') AS ns, count(*) FILTER (pass_as = 'manual') AS nm FROM cz GROUP BY 1) "
       "SELECT user_id || '|' || channel_id0 AS channel_id, coalesce(ns, 0) AS n_zones_seizures, coalesce(nm, 0) AS n_zones_manual, CAST(coalesce(off, 0) AS BIGINT) AS excluded, CAST(stop - start - coalesce(off, 0) AS BIGINT) AS expected, "
       "CASE WHEN user_id % 13 = 0 THEN 'file excluded: X' ELSE '' END AS not_run_reason FROM ch LEFT JOIN x ON x.channel_id = user_id || '|' || channel_id0 LEFT JOIN n ON n.channel_id = user_id || '|' || channel_id0")
def channel_plan(t):
    """Per channel: run or the reason why not, zones, excluded and expected analysed time."""
    ch = channels(t).withColumn("file", F.lit("f"))
    cz = cp.channel_zones(zones(t), ch, "user_id", H)
    bad = ch.where("user_id % 13 = 0").select("user_id", "file", F.lit("X").alias("id"), F.lit("whole file").alias("kind"))
    ex = cp.excluded_files([bad], ["user_id", "file"], ch.groupBy("user_id", "file").agg(F.min("start").alias("start"), F.max("stop").alias("stop")))
    out = cp.channel_plan(ch, cz, cz.limit(0), ex, "user_id", "file", F.lit(True))
    return out.select("channel_id", "n_zones_seizures", "n_zones_manual", "excluded", "expected", "not_run_reason")


@query("EVT-23", f"WITH {POINTS}, {LAB}, {CHN}, cl AS (SELECT channel_id, unnest([rule, 'TOTAL']) AS rule, greatest(zlo, 0) AS lo, least(zhi, dur) AS hi FROM cz), {merged('m', keys='rule, channel_id', source='(SELECT DISTINCT rule, channel_id, lo, hi FROM cl)', lo='lo')}, "
       "x AS (SELECT rule, sum(hi - lo) AS off FROM m GROUP BY 1), n AS (SELECT rule, count(*) AS n FROM cl GROUP BY 1) SELECT rule, n AS n_zones, CAST(coalesce(off, 0) AS BIGINT) AS excluded FROM n LEFT JOIN x USING (rule)")
def rule_summary(t):
    """Zones and excluded time per rule, and over the union of all rules."""
    ch = channels(t)
    return cp.rule_summary(cp.channel_zones(zones(t), ch, "user_id", H), ch)


@query("EVT-32", f"WITH {POINTS}, {LAB}, s AS (SELECT event_id, label, 'own' AS scenario, comments FROM lab UNION ALL SELECT event_id, label, 'all other', 'other' FROM lab) "
       "SELECT scenario, CASE comments WHEN 'IIDs' THEN 'R2' WHEN 'disconnect' THEN 'R5' WHEN 'grooming/scratching' THEN 'R3' WHEN 'other' THEN 'R4' ELSE 'R6' END AS rule, count(*) AS n FROM s WHERE label = 'FP' GROUP BY ALL")
def comment_scenarios(t):
    """Alternative comment readings planned side by side."""
    rows = cp.scenarios(labelled(t).where("label = 'FP'"), ["own", "all other"], lambda n: F.col("comments") if n == "own" else F.lit("other"))
    return rows.groupBy("scenario", text.exclusion_rule(F.col("comments"))[0].alias("rule")).agg(F.count(F.lit(1)).alias("n"))


@query("PRJ-19", f"WITH {POINTS}, {merged('rec', "event_type = 'click'")}, {merged('off', "event_type = 'error'")}, " + """
x AS (SELECT e.event_id, value, hi - t AS len, (SELECT coalesce(sum(least(r.hi, e.hi) - greatest(r.lo, e.t)), 0) FROM rec r WHERE r.user_id = e.user_id AND r.hi > e.t AND r.lo < e.hi) AS a,
 (SELECT coalesce(sum(least(r.hi, e.hi) - greatest(r.lo, e.t)), 0) FROM off r WHERE r.user_id = e.user_id AND r.hi > e.t AND r.lo < e.hi) AS b FROM ev e WHERE event_type = 'purchase')
SELECT event_id, CASE WHEN value <= 10 THEN 'eeg' WHEN a > 0 THEN 'video_in_eeg' WHEN b >= len THEN 'video_beyond_eeg' ELSE 'violation' END AS source FROM x""")
def video_sources(t):
    """Video evidence inside the recording, beyond it in reviewed off-time, or a violation."""
    e = t.points.where("event_type = 'purchase'").select("event_id", "user_id", F.col("t").alias("lo"), "hi", F.when(F.col("value") > 10, "video").otherwise("eeg").alias("source"))
    return cp.reclassify_video(e, t.spans("error"), t.spans("click"), USER).select("event_id", "source")


@query("AGG-24", f"WITH {POINTS}, v AS (SELECT * FROM (VALUES ('actual', 10.0), ('fixed_20', 20.0), ('fixed_40', 40.0)) AS v(variant, h)), "
       "c AS (SELECT user_id, variant, count(*) FILTER (value >= h) AS n FROM ev, v GROUP BY ALL) "
       "SELECT user_id, max(n) FILTER (variant = 'actual') AS actual, max(n) FILTER (variant = 'fixed_20') AS fixed_20, max(n) FILTER (variant = 'fixed_40') AS fixed_40 FROM c GROUP BY user_id")
def sensitivity_wide(t):
    """Counts per threshold variant, one column per variant."""
    names = {"actual": 10.0, "fixed_20": 20.0, "fixed_40": 40.0}
    v = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), F.lit(h).alias("h")) for k, h in names.items()])).alias("v")
    x = t.points.select("user_id", "value", v).select("user_id", "v.variant", (F.col("value") >= F.col("v.h")).cast("long").alias("hit"))
    return x.groupBy("user_id").pivot("variant", list(names)).agg(F.sum("hit"))


@query("AGG-27", f"WITH {POINTS}" + f""" SELECT e.event_id, count(p.event_id) AS n_points FROM ev e LEFT JOIN ev p ON p.user_id = e.user_id AND p.event_type = 'click' AND p.t >= e.t - {H} AND p.t < e.hi + {H}
WHERE e.event_type = 'error' GROUP BY e.event_id""")
def window_counts(t):
    """Points in a window around each zone: two cumulative counts, no pairs."""
    from tidemark.operators import intervals as iv
    e = t.spans("error").select("event_id", "user_id", F.inline(F.array(
        F.struct((F.col("lo") - H).alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("hi") + H).alias("at"), F.lit(1).alias("sign")))))
    pts = t.points.where("event_type = 'click'").select("user_id", "t")
    at = iv.cumulative_at(e, USER, "at", counts={"n": (pts, "t", False)})
    return at.groupBy("event_id").agg(F.sum(F.col("sign") * F.col("n")).alias("n_points"))


@query("AGG-29", """WITH x AS (SELECT user_id, count(DISTINCT event_id) FILTER (event_type = 'click') AS a, count(DISTINCT event_id) FILTER (event_type = 'view') AS b, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS h FROM events GROUP BY 1)
SELECT user_id, round(a / nullif(h, 0), 6) AS click, round(b / nullif(h, 0), 6) AS view FROM x""")
def events_per_hour(t):
    """Distinct events per recorded hour, one column per source."""
    n = lambda k: F.count_distinct(F.when(F.col("event_type") == k, F.col("event_id"))).alias(k)
    x = t.points.groupBy("user_id").agg(n("click"), n("view"), ((F.max("t") - F.min("t")) / 3.6e9).alias("h"))
    return x.select("user_id", *[F.round(F.try_divide(F.col(k), F.col("h")), 6).alias(k) for k in ("click", "view")])


SIG = "s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x FROM events)"


@query("SIG-11 EVT-03", f"WITH {SIG}, k AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g FROM s WHERE x > 3), b AS (SELECT user_id, min(n) AS a, max(n) AS b FROM k GROUP BY user_id, g) "
       "SELECT user_id, CASE WHEN b - a + 1 >= 10 THEN a + 2 ELSE a END AS first_n, CASE WHEN b - a + 1 >= 10 THEN b - 2 ELSE b END AS last_n, b - a + 1 >= 10 AS kept FROM b")
def trimmed_blocks(t):
    """Blocks trimmed at both ends; those too short after the trim are rejected."""
    from tidemark.catalog.signals import samples
    blocks = ev.threshold_runs(samples(t), USER, "n", F.col("x") > 3).drop("n_samples")
    kept, rejected = sg.trimmed_blocks(blocks, 2, 6)
    return kept.withColumn("kept", F.lit(True)).unionByName(rejected.drop("reason").withColumn("kept", F.lit(False)))


@query("SIG-31", f"WITH RECURSIVE {SIG}, k AS (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY n) AS p, lead(x) OVER (PARTITION BY user_id ORDER BY n) AS q, max(x) OVER (PARTITION BY user_id) AS m FROM s), "
       "c AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY n) AS i FROM k WHERE x > p AND x >= q AND x >= 0.4 * m), "
       "f AS (SELECT user_id, i, n AS last, 1 AS kept FROM c WHERE i = 1 UNION ALL SELECT c.user_id, c.i, CASE WHEN c.n - f.last < 4 THEN f.last ELSE c.n END, f.kept + CASE WHEN c.n - f.last < 4 THEN 0 ELSE 1 END FROM f JOIN c ON c.user_id = f.user_id AND c.i = f.i + 1) "
       "SELECT user_id, max(kept) AS num_peaks FROM f GROUP BY user_id")
def spaced_peaks(t):
    """Peaks of each event (here: the whole subject) above 40 % of its maximum, first come four samples apart."""
    from tidemark.catalog.signals import samples
    from tidemark.plans.detect import count_peaks
    s = samples(t).select(F.col("user_id").cast("string").alias("channel_id"), F.lit(0).alias("block_id"), "n", "x")
    c = sg.to_chunks(s, ["channel_id", "block_id"], length=16)
    e = s.groupBy("channel_id", "block_id").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n")).withColumn("event_id", F.lit(1))
    out = count_peaks(e, c, 0.4, 4).where("num_peaks > 0")
    return out.select(F.col("channel_id").cast("long").alias("user_id"), "num_peaks")


@query("SNK-08", f"WITH {SIG} SELECT user_id, CAST(floor(n / 16.0) AS BIGINT) AS segment, count(*) AS n_samples, round(sum(x), 4) AS total FROM s GROUP BY ALL")
def time_segments(t):
    """Fixed-length segments of every recording with their sample accounting."""
    from tidemark.catalog.signals import samples
    s = store.time_segments(samples(t), 8.0, 2.0)
    return s.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n_samples"), F.round(F.sum("x"), 4).alias("total"))


@query("SNK-06 SNK-05", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'new' WHEN p_size % 4 = 1 THEN 'skipped' WHEN p_size % 4 = 2 THEN 'reprocessed' ELSE CASE WHEN p_brand = 'Brand#1' THEN 'skipped' ELSE 'reprocessed' END END AS status FROM part""")
def resume_status(t):
    """Stored clean results kept only when case, gain source, gain and notch agree."""
    p = t.part.select("p_partkey", "p_size", "p_brand", F.col("p_retailprice").alias("gain"), F.lit("auto").alias("gain_source"), F.lit("on").alias("notch"), F.lit("Brand#1").alias("case"))
    m = F.col("p_size") % 4
    s = p.where(m != 0).withColumns({"gain": F.when(m == 2, F.col("gain") * 1.001).otherwise(F.col("gain") * (1 + 1e-11)), "case": F.when(m == 3, F.col("p_brand")).otherwise(F.col("case"))})
    return store.resume_status(p, s, ["p_partkey"]).select("p_partkey", "status")


@query("SRC-18 FN-11", "SELECT doc_id, octet_length(encode(text)) AS bytes, sha256(text) AS digest FROM documents")
def content_digests(t):
    """Size and digest of whole documents: the identity of an input at a run."""
    return t.documents.select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


@query("PRJ-02 PRJ-09", """WITH l AS (SELECT DISTINCT lang AS f, source AS label FROM documents), w AS (SELECT DISTINCT lang AS f, 'eeg ' || upper(source) AS want FROM documents UNION SELECT DISTINCT lang, 'absent' FROM documents)
SELECT w.f AS source_file, want AS label, l.label AS channel_label, CASE WHEN l.label IS NULL THEN 'missing' ELSE 'loose' END AS "match" FROM w LEFT JOIN l ON l.f = w.f AND upper(replace(l.label, ' ', '')) = upper(replace(regexp_replace(want, '^eeg ', ''), ' ', ''))""")
def channel_selection(t):
    """Requested labels matched exactly, else ignoring case, prefix and spaces."""
    d = t.documents.select(F.col("lang").alias("source_file"), F.col("source").alias("channel_label")).distinct()
    want = d.select("source_file", F.concat(F.lit("eeg "), F.upper("channel_label")).alias("label"), F.lit("r").alias("region"))
    want = want.unionByName(d.select("source_file", F.lit("absent").alias("label"), F.lit("r").alias("region")).distinct())
    return edf.select_channels(d, want).drop("region")


@query("PRJ-18 PRJ-17", """SELECT CAST(user_id AS VARCHAR) AS subject_id, event_type AS region, CAST(event_id AS INTEGER) AS seizure_id, value AS ll_ratio, false AS over_max_duration, '' AS seizure_mode FROM events""")
def public_schema(t):
    """Detector rows under the public schema: renamed, typed, defaults for what is missing."""
    x = t.events.select("user_id", "event_type", "event_id", "value")
    out = schemas.shaped(x, schemas.SEIZURES, {"subject_id": "user_id", "region": "event_type", "seizure_id": "event_id", "ll_ratio": "value"})
    return out.select("subject_id", "region", "seizure_id", "ll_ratio", "over_max_duration", "seizure_mode")


@query("PRJ-09", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN true WHEN l_returnflag = 'N' THEN l_quantity > 30 ELSE false END AS notch FROM lineitem""")
def notch_switch(t):
    """Notch on, off, or decided by the quality class."""
    mode = F.when(F.col("l_returnflag") == "A", "on").when(F.col("l_returnflag") == "N", "auto").otherwise("off")
    q = F.when(F.col("l_quantity") > 30, "line_contaminated").otherwise("ok")
    return t.lineitem.select("l_orderkey", "l_linenumber", ql.notch_active(mode, q).alias("notch"))
