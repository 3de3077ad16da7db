"""Lookups, set algebra on tables, labels, checks and comparisons of runs."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import POINTS, query
from tidemark.functions import clock, text
from tidemark.operators import lookups as lk
from tidemark.operators import quality as ql
from tidemark.operators import tables as tb


@query("JOIN-01 SRC-07", """SELECT o_orderkey, CASE WHEN c = 1 THEN s_name END AS s_name, CASE WHEN c IS NULL THEN 'missing' WHEN c > 1 THEN 'ambiguous' ELSE 'ok' END AS lookup_status
FROM orders LEFT JOIN (SELECT s_suppkey % 700 AS k, count(*) AS c, max(s_name) AS s_name FROM supplier WHERE s_suppkey % 3 <> 0 GROUP BY 1) ON k = o_custkey % 700""")
def unique_lookup(t):
    """Dimension lookup that reports missing and ambiguous keys instead of multiplying rows."""
    dim = t.supplier.where("s_suppkey % 3 <> 0").select((F.col("s_suppkey") % 700).alias("k"), "s_name")
    return lk.unique_lookup(t.orders.select("o_orderkey", (F.col("o_custkey") % 700).alias("k")), dim, ["k"]).drop("k")


@query("JOIN-02 SRC-11 WIN-07", """WITH r AS (SELECT lower('F' || (p_partkey % 50)) AS f, CASE WHEN p_size % 3 = 0 THEN '' ELSE lower(split_part(p_brand, '#', 2)) END AS reg, p_partkey AS k, p_type AS v FROM part),
l AS (SELECT f, reg, arg_max(v, k) AS v FROM r GROUP BY f, reg)
SELECT s_suppkey, coalesce(a.v, b.v, 'normal') AS case_name, CASE WHEN a.v IS NOT NULL THEN 'region' WHEN b.v IS NOT NULL THEN 'wildcard' ELSE 'default' END AS rule_source
FROM supplier s LEFT JOIN l a ON a.f = lower('f' || (s_suppkey % 70)) AND a.reg = CAST(s_nationkey AS VARCHAR) AND a.reg <> '' LEFT JOIN l b ON b.f = lower('f' || (s_suppkey % 70)) AND b.reg = ''""")
def priority_lookup(t):
    """Rule by file name: region-specific over wildcard, last row wins, else the default."""
    rules = t.part.select(F.concat(F.lit("F"), F.col("p_partkey") % 50).alias("file"),
                          F.when(F.col("p_size") % 3 == 0, "").otherwise(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("region"),
                          F.col("p_partkey").alias("row"), F.col("p_type").alias("case_name"))
    ch = t.supplier.select("s_suppkey", F.concat(F.lit("f"), F.col("s_suppkey") % 70).alias("file"), F.col("s_nationkey").cast("string").alias("region"))
    return lk.priority_lookup(ch, rules, "file", "region", "row", ["case_name"], {"case_name": "normal"}).drop("file", "region")


@query("JOIN-13 PRJ-05", """WITH a AS (SELECT c_nationkey AS k, avg(c_acctbal) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1), b AS (SELECT n_regionkey AS r, count(*) AS v FROM nation WHERE n_regionkey < 3 GROUP BY 1)
SELECT s_suppkey, round(coalesce(a.v, b.v), 4) AS reference, CASE WHEN a.v IS NOT NULL THEN 'specific' WHEN b.v IS NOT NULL THEN 'general' ELSE 'none' END AS reference_source
FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN a ON a.k = s_nationkey LEFT JOIN b ON b.r = n_regionkey""")
def fallback_lookup(t):
    s = t.supplier.join(t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey").select("s_suppkey", "s_nationkey", "n_regionkey")
    a = t.customer.where("c_nationkey % 2 = 0").groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.avg("c_acctbal").alias("reference"))
    b = t.nation.where("n_regionkey < 3").groupBy("n_regionkey").agg(F.count(F.lit(1)).cast("double").alias("reference"))
    out = lk.fallback_lookup(s, a, b, ["s_nationkey"], ["n_regionkey"], "reference")
    return out.select("s_suppkey", F.round("reference", 4).alias("reference"), "reference_source")


@query("JOIN-03", """WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events WHERE event_type = 'click'),
r AS (SELECT user_id, event_id, epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 5000000 ELSE 0 END AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) + CASE WHEN event_id % 7 = 0 THEN 5000000 ELSE 0 END, event_id) AS k
 FROM events WHERE event_type = 'click' AND event_id % 11 <> 0)
SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.k, r.k) AS ordinal, l.event_id, CASE WHEN r.k IS NULL THEN 'left_only' WHEN l.k IS NULL THEN 'right_only' WHEN abs(l.t - r.t) >= 1000 THEN 'moved' ELSE 'ok' END AS row_status
FROM l FULL JOIN r ON l.user_id = r.user_id AND l.k = r.k""")
def positional_join(t):
    """Re-saved labels joined by position, with the rows that moved or went missing."""
    left = t.points.where("event_type = 'click'").select("user_id", "event_id", "t")
    moved = F.col("t") + F.when(F.col("event_id") % 7 == 0, 5_000_000).otherwise(0)
    right = left.where("event_id % 11 <> 0").select("user_id", "event_id", moved.alias("t"))
    return lk.positional_join(left, right, ["user_id"], ["t", "event_id"], "t", 1000).select("user_id", "ordinal", "event_id", "row_status")


@query("JOIN-06 SRC-13", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def never_seen(t):
    """Dimension rows without a matching fact (left anti)."""
    seen = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.select("c_custkey").join(seen, "c_custkey", "left_anti")


@query("JOIN-11 AGG-31", """WITH a AS (SELECT user_id, count(*) AS n_a, round(sum(value), 2) AS s_a FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id, count(*) AS n_b FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, n_a, s_a, n_b FROM a FULL JOIN b USING (user_id)""")
def full_outer_summary(t):
    a = t.events.where("event_type = 'click'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_a"), F.round(F.sum("value"), 2).alias("s_a"))
    b = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_b"))
    return a.join(b, "user_id", "full")


@query("JOIN-15", "SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 1")
def single_source(t):
    """Sessions with exactly one source; conflicting ones are left out."""
    return lk.single_source(t.orders, ["o_custkey"], "o_orderpriority")[0]


@query("JOIN-16 SRC-13", """SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN 'too large' END, 'not analysed') AS reason FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)""")
def absence_reasons(t):
    """Requested rows that are absent, with the recorded or the default reason."""
    used = t.lineitem.where("l_returnflag = 'R' AND l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    skipped = t.part.where("p_size > 25").select("p_partkey", F.lit("too large").alias("reason"))
    return lk.absence_reasons(t.part.select("p_partkey"), used, skipped, ["p_partkey"], "not analysed")


@query("SRC-06", """SELECT o_custkey, min(o_orderdate) AS first_start, max(o_orderdate) AS last_end, count(DISTINCT o_orderstatus) AS n_regions, max(o_totalprice) FILTER (o_orderstatus = 'F') AS "F",
 max(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus = 'O') AS analysed FROM orders GROUP BY 1""")
def recording_catalogue(t):
    """Recording catalogue: span, number of channels, one column per channel, both present."""
    from tidemark.sources.catalogue import catalogue
    x = t.orders.select("o_custkey", F.col("o_orderstatus").alias("region"), F.col("o_orderdate").alias("start"), F.col("o_orderdate").alias("end"), "o_totalprice")
    out = catalogue(x, ["o_custkey"], "region", ["F", "O"], "start", "end", "o_totalprice")
    return out.select("o_custkey", F.col("start").alias("first_start"), F.col("end").alias("last_end"), "n_regions", "F", "O", "analysed")


@query("SRC-19 SRC-20 WIN-07", """WITH a AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS total FROM orders GROUP BY 1)
SELECT o_custkey, coalesce(a.total, b.total) AS total, CASE WHEN a.total IS NULL THEN 1 ELSE 0 END AS store FROM b LEFT JOIN a USING (o_custkey)""")
def first_store(t):
    """First store that holds a key wins; inside a store the last duplicate wins."""
    o = t.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("total"), "o_orderstatus")
    last = lambda d: lk.last_wins(d.drop("o_orderstatus"), ["o_custkey"], "o_orderkey").drop("o_orderkey")
    return lk.first_store([last(o.where("o_orderstatus = 'F'")), last(o)], ["o_custkey"])


@query("AGG-06 AGG-07", """WITH x AS (SELECT c_mktsegment AS region, c_acctbal AS s FROM customer WHERE c_acctbal > 0)
SELECT region, count(*) AS n_channels, round(median(s), 4) AS reference FROM (FROM x UNION ALL SELECT 'pooled', s FROM x) GROUP BY 1""")
def run_reference(t):
    """Reference amplitude per region and pooled, over unattenuated channels."""
    x = t.customer.select(F.col("c_mktsegment").alias("region"), F.col("c_acctbal").alias("sigma"))
    out = ql.run_reference(x, "region", "sigma", F.col("sigma") <= 0)
    return out.select("region", "n_channels", F.round("reference", 4).alias("reference"))


@query("AGG-07 SRT-03", """WITH x AS (SELECT c_custkey, c_mktsegment, c_acctbal FROM customer), q AS (SELECT c_mktsegment, median(c_acctbal) AS m FROM x GROUP BY 1)
SELECT c_custkey, round(c_acctbal / m, 6) AS multiple FROM x JOIN q USING (c_mktsegment)""")
def cohort_deviation(t):
    """Each channel as a multiple of its region's median, farthest first."""
    return ql.cohort_calibration(t.customer, "c_mktsegment", "c_acctbal")[1].select("c_custkey", F.round("multiple", 6).alias("multiple"))


@query("PRJ-05", """WITH x AS (SELECT s_suppkey, abs(s_acctbal) AS sigma, CASE s_suppkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN 'explicit' ELSE 'auto' END AS mode, s_suppkey / 10.0 AS g, CASE WHEN s_nationkey < 15 THEN 100.0 * s_nationkey ELSE 900 END AS ref FROM supplier),
r AS (SELECT *, CASE mode WHEN 'explicit' THEN g WHEN 'auto' THEN ref / nullif(sigma, 0) END AS raw FROM x)
SELECT s_suppkey, round(CASE WHEN mode = 'off' THEN 1 WHEN mode = 'explicit' THEN least(raw, 50) WHEN raw IS NULL OR raw <= 0 THEN 1 WHEN raw BETWEEN 1 / 1.5 AND 1.5 THEN 1 ELSE least(raw, 50) END, 6) AS gain_applied FROM r""")
def gain_decision(t):
    """Gain per channel: off, explicit, or reference over amplitude with a dead band and a clamp."""
    mode = F.when(F.col("s_suppkey") % 3 == 0, "off").when(F.col("s_suppkey") % 3 == 1, "explicit").otherwise("auto")
    x = t.supplier.select("s_suppkey", "s_nationkey", F.abs("s_acctbal").alias("sigma_band"), mode.alias("gain_mode"), (F.col("s_suppkey") / 10.0).alias("gain"))
    ref = t.nation.where("n_nationkey < 15").select(F.col("n_nationkey").alias("s_nationkey"), (F.col("n_nationkey") * 100.0).alias("reference"))
    return ql.gain_decision(x, ref, "s_nationkey", 900.0).select("s_suppkey", F.round("gain_applied", 6).alias("gain_applied"))


@query("PRJ-07 AGG-08", """SELECT CASE WHEN l_quantity < 5 OR l_discount > 0.09 THEN 'unusable' WHEN l_quantity < 15 AND (l_tax > 0.07 OR l_linenumber > 6) THEN 'low_amplitude+line' WHEN l_quantity < 15 THEN 'low_amplitude'
 WHEN l_tax > 0.07 OR l_linenumber > 6 THEN 'line_contaminated' ELSE 'ok' END AS quality, count(*) AS n FROM lineitem GROUP BY 1""")
def quality_classes(t):
    q = ql.quality_class(F.col("l_quantity"), F.col("l_tax"), F.col("l_linenumber"), F.lit(0.0), F.col("l_discount") * 100 / 9 * 5, min_snr=5, low_snr=15, line_limit=0.07, intermittent=6)
    return t.lineitem.groupBy(q.alias("quality")).agg(F.count(F.lit(1)).alias("n"))


@query("PRJ-08", """WITH x AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), m AS (SELECT c_nationkey, CASE WHEN count(*) >= 2 THEN median(c_acctbal) END AS m FROM x GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 97 < 12 THEN 'unusable' WHEN (c_acctbal * 3 < m OR c_custkey % 97 < 26) AND (c_custkey % 14 > 10 OR c_custkey % 13 > 10) THEN 'both'
 WHEN c_acctbal * 3 < m OR c_custkey % 97 < 26 THEN 'attenuated' WHEN c_custkey % 14 > 10 OR c_custkey % 13 > 10 THEN 'line' ELSE 'normal' END AS suggested_case FROM x JOIN m USING (c_nationkey)""")
def suggested_case(t):
    """Case of each channel: unusable, both, attenuated, line or normal."""
    k = F.col("c_custkey")
    snr, line_db, pct = k % 97, k % 14, k % 13
    quality = ql.quality_class(snr, line_db, pct, F.lit(0.0), F.lit(0.0), min_snr=12, low_snr=26, line_limit=10, intermittent=10)
    return ql.suggested_case(t.customer, "c_nationkey", "c_acctbal", snr, line_db, pct, quality).select("c_custkey", "suggested_case")


@query("PRJ-13 PRJ-14 SRC-17 FN-05", """WITH c AS (SELECT conv_id, turn, CASE (conv_id + turn) % 15 WHEN 0 THEN ' iids ' WHEN 1 THEN 'IID' WHEN 2 THEN 'Disconnect' WHEN 3 THEN 'disconnected' WHEN 4 THEN 'disconnection' WHEN 5 THEN 'Grooming'
 WHEN 6 THEN 'scratching' WHEN 7 THEN 'grooming/scratching' WHEN 8 THEN 'grooming / scratching' WHEN 9 THEN 'grooming-scratching' WHEN 10 THEN 'scratching/grooming' WHEN 11 THEN 'other' WHEN 12 THEN 'Others' WHEN 13 THEN '' ELSE role END AS raw FROM conversations),
k AS (SELECT *, CASE WHEN trim(lower(raw)) = '' THEN '' WHEN trim(lower(raw)) IN ('iid', 'iids') THEN 'IIDs' WHEN trim(lower(raw)) IN ('disconnect', 'disconnected', 'disconnection') THEN 'disconnect'
 WHEN trim(lower(raw)) IN ('grooming', 'scratching', 'grooming/scratching', 'grooming / scratching', 'grooming-scratching', 'scratching/grooming') THEN 'grooming/scratching' WHEN trim(lower(raw)) IN ('other', 'others') THEN 'other' ELSE 'unrecognized:' || trim(raw) END AS comment FROM c)
SELECT conv_id, turn, comment, CASE WHEN comment = '' OR comment LIKE 'unrecognized:%' THEN 'R6' WHEN comment = 'IIDs' THEN 'R2' WHEN comment = 'disconnect' THEN 'R5' WHEN comment = 'grooming/scratching' THEN 'R3' ELSE 'R4' END AS rule FROM k""")
def comment_rules(t):
    """Free-text comments normalised to categories and mapped to exclusion rules."""
    spelt = [" iids ", "IID", "Disconnect", "disconnected", "disconnection", "Grooming", "scratching", "grooming/scratching", "grooming / scratching",
             "grooming-scratching", "scratching/grooming", "other", "Others", ""]
    m = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(15)).cast("int")
    raw = F.coalesce(F.get(F.array(*[F.lit(s) for s in spelt]), m), F.col("role"))
    x = t.conversations.select("conv_id", "turn", text.comment(raw).alias("comment"))
    return x.withColumn("rule", text.exclusion_rule(F.col("comment"))[0])


@query("PRJ-10 PRJ-11 PRJ-12 PRJ-06 PRJ-20", """SELECT event_id, CASE WHEN value >= 20 THEN 'accepted' WHEN value >= 8 THEN 'in_band' ELSE 'rejected' END AS status, CASE event_type WHEN 'click' THEN 'right' WHEN 'view' THEN 'left' ELSE 'unknown' END AS side,
 event_type NOT IN ('signup') AS is_attenuated, event_type IN ('signup', 'error') AS attenuation_known FROM events WHERE event_type <> 'purchase' OR value >= 8""")
def status_and_side(t):
    """Review-band status, hemisphere and attenuation decision."""
    att, known = ql.attenuation(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")), ["signup"], ["error"])
    return t.events.where("event_type <> 'purchase' OR value >= 8").select(
        "event_id", text.band_status(F.col("value"), 20, 8).alias("status"), text.hemisphere(F.col("event_type"), ["Click"], ["View"]).alias("side"),
        att.alias("is_attenuated"), known.alias("attenuation_known"))


@query("PRJ-16 AGG-05", """WITH u AS (SELECT user_id, count(*) FILTER (event_type <> 'signup') AS n, count(*) FILTER (event_type <> 'signup' AND value < 1) AS open FROM events GROUP BY 1)
SELECT user_id, n AS n_events, open AS n_unlabelled, CASE WHEN n = 0 THEN 'no_detections' WHEN open = 0 THEN 'reviewed' WHEN open = n THEN 'not_reviewed' ELSE 'partial' END AS status, n = 0 OR open = 0 AS included FROM u""")
def unit_status(t):
    """Review status of each unit and whether it enters the statistics."""
    from tidemark.plans.campaign import unit_status as status
    rows = t.events.select("user_id", (F.col("event_type") != "signup").alias("is_event"), F.when(F.col("value") < 1, "").otherwise("x").alias("label"))
    return status(rows, ["user_id"])


@query("SET-09 SET-14 PRJ-17", """SELECT o_orderkey, o_totalprice, o_orderstatus, 'n/a' AS note FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice, NULL, 'late' FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000""")
def union_runs(t):
    """Union of runs with different columns: defaults for some, NULL for the others."""
    a = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = t.orders.where("o_orderstatus = 'O' AND o_totalprice > 50000").select("o_orderkey", "o_totalprice", F.lit("late").alias("note"))
    return tb.union_runs([a, b], {"note": "n/a"})


@query("SET-13 SET-14", """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 90000) UNION ALL SELECT o_orderkey, o_custkey, o_totalprice * 2 FROM orders WHERE o_totalprice > 90000""")
def replace_subjects(t):
    """Rows of updated subjects replaced, all others kept."""
    old = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.where("o_totalprice > 90000").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return tb.replace_keys(old, new, ["o_custkey"])


@query("CHK-02 CHK-03 CHK-04 SET-12", """WITH a AS (SELECT o_orderkey, o_totalprice AS p, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p,
 CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 6 <> 0)
SELECT o_orderkey, CASE WHEN a.p IS NULL THEN 'only_b' WHEN b.p IS NULL THEN 'only_a' WHEN a.p = b.p AND a.s = b.s THEN 'same' ELSE 'changed' END AS status,
 CASE WHEN a.p IS NULL OR b.p IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.p <> b.p THEN 'p' END, CASE WHEN a.s <> b.s THEN 's' END) END AS "columns" FROM a FULL JOIN b USING (o_orderkey)""")
def run_diff(t):
    """Row-by-row comparison of two runs with the names of the changed columns."""
    o = t.orders.select("o_orderkey", F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))
    b = o.where("o_orderkey % 6 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("p") + 1).otherwise(F.col("p")).alias("p"),
                                              F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("s")).alias("s"))
    return tb.row_diff(o.where("o_orderkey % 5 <> 0"), b, ["o_orderkey"])


@query("SET-10 SET-11", """(SELECT 'a' AS side, o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 50000 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 60000))
UNION ALL (SELECT 'b', o_custkey, o_orderstatus FROM (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 60000 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 50000))""")
def multiset_difference(t):
    o = t.orders.select("o_custkey", "o_orderstatus", "o_totalprice")
    pick = lambda d: d.select("o_custkey", "o_orderstatus")
    return tb.multiset_equal(pick(o.where("o_totalprice > 50000")), pick(o.where("o_totalprice < 60000")))


@query("SNK-07 SNK-04 CHK-04", f"WITH {POINTS}, " + """a AS (SELECT user_id, sum(t) AS h, count(*) AS n FROM ev WHERE event_type = 'error' GROUP BY 1), b AS (SELECT user_id, sum(t) AS h, count(*) AS n FROM ev WHERE event_type = 'error' AND (user_id % 10 <> 0 OR value < 40) AND user_id % 9 <> 0 GROUP BY 1)
SELECT a.user_id, a.n, CASE WHEN b.n IS NULL THEN 'new' WHEN a.h <> b.h OR a.n <> b.n THEN 'inputs changed' WHEN a.user_id % 8 = 0 THEN 'code changed' ELSE 'reuse' END AS decision FROM a LEFT JOIN b USING (user_id)""")
def reuse_plan(t):
    """Reuse an earlier result iff the signature of its zone set and the code version agree."""
    z = t.spans("error").join(t.events.select("event_id", "value"), "event_id")
    now = tb.set_signature(z, ["user_id"], ["lo", "hi"]).withColumn("code_version", F.lit("v2"))
    old = tb.set_signature(z.where("(user_id % 10 <> 0 OR value < 40) AND user_id % 9 <> 0"), ["user_id"], ["lo", "hi"])
    old = old.withColumn("code_version", F.when(F.col("user_id") % 8 == 0, "v1").otherwise("v2"))
    return tb.reuse_plan(now, old, ["user_id"]).select("user_id", "n", "decision")


@query("CHK-05 CHK-08", """WITH a AS (SELECT event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1), b AS (SELECT event_type, count(*) AS n, sum(value) AS total FROM events WHERE event_type <> 'view' OR value < 60 GROUP BY 1),
u AS (SELECT event_type, 'n' AS name, a.n = b.n AS same FROM a JOIN b USING (event_type) UNION ALL SELECT event_type, 'total', abs(a.total - b.total) <= 1e-9 * abs(a.total) FROM a JOIN b USING (event_type))
SELECT event_type, name FROM u WHERE NOT same""")
def key_figures(t):
    """Named figures of two runs that differ beyond tolerance."""
    agg = lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return tb.key_figures(agg(t.events), agg(t.events.where("event_type <> 'view' OR value < 60")), ["event_type"]).select("event_type", "name")


@query("CHK-01 CHK-07", """SELECT 'times ordered' AS name, count(*) FILTER (value < 0) AS n_bad, count(*) FILTER (value < 0) = 0 AS passes, count(*) FILTER (value < 0) > 0 AS stop FROM events
UNION ALL SELECT 'value bounded', count(*) FILTER (value > 80), count(*) FILTER (value > 80) = 0, false FROM events
UNION ALL SELECT 'orders have customers', count(*), count(*) = 0, count(*) > 0 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def named_checks(t):
    """Named checks from violation rows, with stop conditions."""
    cust = t.customer.select(F.col("c_custkey").alias("o_custkey"))
    return tb.checks([("times ordered", t.events.where("value < 0"), True), ("value bounded", t.events.where("value > 80"), False),
                      ("orders have customers", t.orders.join(cust, "o_custkey", "left_anti"), True)])


@query("CHK-09", """WITH d AS (SELECT * FROM (VALUES ('click', '1', 'keep'), ('click', '12', 'drop'), ('error', '9', 'check')) AS v(event_type, prefix, decision))
SELECT event_id, coalesce(arg_max(decision, length(prefix)) FILTER (starts_with(CAST(event_id AS VARCHAR), prefix)), 'open') AS decision FROM events LEFT JOIN d USING (event_type) GROUP BY event_id""")
def recorded_decisions(t):
    """Flags with the recorded decision of the longest matching prefix, else open."""
    d = t.spark.createDataFrame([("click", "1", "keep"), ("click", "12", "drop"), ("error", "9", "check")], "event_type string, prefix string, decision string")
    x = t.events.select("event_id", "event_type", F.col("event_id").cast("string").alias("detail"))
    return tb.decided(x, d, "event_type", "detail").select("event_id", "decision")


@query("FN-08 FN-10 FN-11 FN-09", """SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, sha256(props) AS digest FROM events""")
def json_props(t):
    """Typed header fields with defaults, and content digests."""
    m = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", text.header_value(m, "k", "double").alias("k"), text.header_value(m, "missing", "string", "none").alias("missing"), F.sha2("props", 256).alias("digest"))


@query("SRT-01 SRT-02 SRT-05 FN-02", f"WITH {POINTS}" + """, s AS (SELECT user_id, t, event_id, 'seizure' AS kind FROM ev WHERE event_type = 'purchase' UNION ALL SELECT user_id, t, event_id, 'burst' FROM ev WHERE event_type = 'click' UNION ALL SELECT user_id, t, event_id, 'gap' FROM ev WHERE event_type = 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM s)
SELECT user_id, event_id, kind, strftime(make_timestamp(t), '%d/%m/%Y %H:%M:%S') AS clock, k AS position, '' AS verdict FROM r""")
def review_sheet(t):
    """Each subject's chronological review sheet."""
    from tidemark.plans.review import review_sheet as sheet
    p = t.points
    kinds = {"seizure": "purchase", "burst": "click", "gap": "error"}
    parts = {k: p.where(F.col("event_type") == v).select("user_id", "event_id", "t") for k, v in kinds.items()}
    out = sheet(parts, ["user_id"], "t", "event_id")
    return out.select("user_id", "event_id", "kind", clock.review_text(F.timestamp_micros("t")).alias("clock"), "position", "verdict")


@query("PRJ-01 PRJ-03 PRJ-04 FN-06", """SELECT p_partkey, round(p_retailprice * CASE p_size % 6 WHEN 1 THEN 1000 WHEN 2 THEN 1000000 ELSE 1 END, 2) AS scaled, p_size % 6 NOT IN (3, 5) AS recognised, regexp_replace(trim(p_brand), '[^A-Za-z0-9_-]', '_', 'g') AS subject,
 CASE WHEN p_size > 10 THEN round(abs(p_retailprice) / (p_size - 10), 6) END AS step FROM part""")
def unit_scaling(t):
    """Units to microvolts, subject ids from names, quantisation step."""
    m = F.col("p_size") % 6
    unit = F.when(m == 0, " µV").when(m == 1, "mV ").when(m == 2, "V").when(m == 4, "microV").when(m == 5, "nV").otherwise("furlong")
    scale, known = text.unit_scale(unit)
    return t.part.select("p_partkey", F.round(F.col("p_retailprice") * scale, 2).alias("scaled"), known.alias("recognised"), text.subject_id(F.col("p_brand")).alias("subject"),
                         F.round(ql.quantisation(F.lit(0), F.col("p_retailprice"), F.lit(10), F.col("p_size")), 6).alias("step"))


@query("SRC-17", """WITH f AS (SELECT page_id, 's' || (page_id % 9) || '-x_2024' || lpad(CAST(1 + page_id % 12 AS VARCHAR), 2, '0') || '05_101112_HPC' || CASE WHEN page_id % 2 = 0 THEN 'r' ELSE 'l' END || CASE WHEN page_id % 3 = 0 THEN '_part' || (page_id % 7) ELSE '' END AS n FROM pages)
SELECT page_id, regexp_extract(n, '^(.+)_([0-9]{8}_[0-9]{6})_', 1) AS subject_id, strptime(regexp_extract(n, '_([0-9]{8}_[0-9]{6})_', 1), '%Y%m%d_%H%M%S') AS start, regexp_extract(n, '_(HPC[rl])', 1) AS region, TRY_CAST(regexp_extract(n, '_part([0-9]+)$', 1) AS INTEGER) AS part FROM f""")
def file_name_parts(t):
    """Metadata from file names built from the page ids."""
    i = F.col("page_id")
    name = F.concat(F.lit("/data/s"), i % 9, F.lit("-x_2024"), F.lpad((1 + i % 12).cast("string"), 2, "0"), F.lit("05_101112_HPC"), F.when(i % 2 == 0, "r").otherwise("l"),
                    F.when(i % 3 == 0, F.concat(F.lit("_part"), i % 7)).otherwise(""), F.lit(".txt"))
    x = t.pages.select("page_id", text.file_parts(name).alias("f")).select("page_id", "f.*")
    return x.withColumn("start", F.col("start").cast("timestamp_ntz"))
