"""Exact rank tests, intervals of any statistic, and differences of nested values."""

from pyspark.sql import functions as F

from tidemark.catalog.registry import query
from tidemark.catalog.stats import B, SUBJ, subjects
from tidemark.operators import exact, nested
from tidemark.operators import resampling as rs
from tidemark.session import settle

TENTH = f"{SUBJ}, t AS (SELECT *, user_id % 10 AS k FROM s)"


def tenths(t):
    """Subjects in ten groups, small enough for exact tests."""
    return subjects(t).withColumn("k", F.col("user_id") % 10)


def walk(name, ranks, term, start="0 AS c_"):
    """SQL: the distribution of a sum over the rows of ``ranks`` (k, i, r2), one row after the other: ways ``c`` to each state."""
    return f"""{name} AS (SELECT DISTINCT k, 0 AS i, 0 AS m, 0 AS s, 1.0::DOUBLE AS c FROM {ranks} UNION ALL
 SELECT k, i, m, s, sum(c) FROM (SELECT d.k, d.i + 1 AS i, d.m + j AS m, d.s + {term} AS s, c FROM {name} d JOIN {ranks} r ON r.k = d.k AND r.i = d.i + 1, (SELECT unnest([0, 1]) AS j)) GROUP BY ALL)"""


@query("STAT-04 WIN-06", f"WITH RECURSIVE {TENTH}, a AS (SELECT k, grp, CAST(2 * rank() OVER (PARTITION BY k ORDER BY v) + count(*) OVER (PARTITION BY k, v) - 1 AS BIGINT) AS r2 FROM t), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r2, grp) AS i FROM a), w AS (SELECT k, count(*) AS n, count(*) FILTER (grp = 'case') AS n1, sum(r2) FILTER (grp = 'case') AS w FROM r GROUP BY k), "
       f"{walk('d', 'r', 'j * r2')}, p AS (SELECT w.k, least(1, 2 * least(sum(c) FILTER (s <= w), sum(c) FILTER (s >= w)) / sum(c)) AS p FROM d JOIN w ON w.k = d.k AND d.i = n AND d.m = n1 GROUP BY w.k) "
       "SELECT k, n1, n - n1 AS n2, CASE WHEN n1 > 0 AND n1 < n THEN round(p, 9) END AS p, CASE WHEN n1 > 0 AND n1 < n THEN 'exact' ELSE 'normal' END AS method FROM w LEFT JOIN p USING (k)")
def exact_rank_sum(t):
    """Rank-sum tests of small groups by the exact distribution of the rank sum, ties included."""
    out = exact.rank_sum_test(tenths(t), ["k"], "grp", "case", "control", "v")
    return out.select("k", "n1", "n2", F.round("p", 9).alias("p"), "method")


@query("STAT-10", f"WITH RECURSIVE {TENTH}, a AS (SELECT k, x - y AS d, CAST(2 * rank() OVER (PARTITION BY k ORDER BY abs(x - y)) + count(*) OVER (PARTITION BY k, abs(x - y)) - 1 AS BIGINT) AS r2 FROM t WHERE x <> y), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r2, d) AS i FROM a), w AS (SELECT k, count(*) AS n, coalesce(sum(r2) FILTER (d > 0), 0) AS w FROM r GROUP BY k), "
       f"{walk('d', 'r', 'j * r2')} SELECT w.k, max(n) AS n, round(max(w) / 2, 1) AS w_plus, round(least(1, 2 * least(sum(c) FILTER (s <= w), sum(c) FILTER (s >= w)) / sum(c)), 9) AS p FROM d JOIN w ON w.k = d.k AND d.i = n GROUP BY w.k")
def exact_signed_rank(t):
    """Signed-rank tests by the exact distribution over all patterns of signs."""
    out = exact.signed_rank_test(tenths(t).withColumn("d", F.col("x") - F.col("y")), ["k"], "d")
    return out.select("k", "n", F.round("w_plus", 1).alias("w_plus"), F.round("p", 9).alias("p"))


@query("STAT-05", f"""WITH RECURSIVE {SUBJ}, t AS (SELECT *, user_id % 5 AS k FROM s), p AS (SELECT a.k, sum(sign(a.v - b.v) * sign(a.user_id - b.user_id)) AS s, count(*) AS pairs FROM t a JOIN t b ON a.k = b.k AND a.user_id < b.user_id GROUP BY a.k),
n AS (SELECT k, count(*) AS n, count(DISTINCT v) = count(*) AS untied FROM t GROUP BY k), m AS (SELECT unnest(generate_series(1, (SELECT max(n) FROM n))) AS m),
d AS (SELECT 1::BIGINT AS m, 0::BIGINT AS s, 1.0::DOUBLE AS c UNION ALL SELECT m, s, sum(c) FROM (SELECT d.m + 1 AS m, d.s + j AS s, c / (d.m + 1) AS c FROM d JOIN (SELECT unnest(range(0, 200)) AS j) ON j <= d.m WHERE d.m < (SELECT max(n) FROM n)) GROUP BY ALL)
SELECT n.k, n, round(p.s / pairs, 6) AS tau_b, round(least(1, 2 * least(sum(c) FILTER (d.s <= (pairs - p.s) / 2), sum(c) FILTER (d.s >= (pairs - p.s) / 2))), 9) AS p
FROM n JOIN p USING (k) JOIN d ON d.m = n.n WHERE untied AND n < 50 GROUP BY n.k, n, p.s, pairs""")
def exact_kendall(t):
    """Order correlation of a subject's number and its sum, by the exact distribution of discordant pairs (keys without ties)."""
    out = exact.kendall_test(subjects(t).withColumn("k", F.col("user_id") % 5), ["k"], "user_id", "v").where("method = 'exact'")
    return out.select("k", "n", F.round("tau_b", 6).alias("tau_b"), F.round("p", 9).alias("p"))


@query("STAT-05")
def correlation_tests(t):
    """Rank, order and log-linear correlation of every group with p-values (long table)."""
    out = exact.correlation_tests(tenths(t), ["k"], "x", "y")
    return out.withColumns({c: F.round(c, 9) for c in ("estimate", "p")})


@query("STAT-06 STAT-07 UDF-02")
def statistic_intervals(t):
    """Bias-corrected accelerated intervals (10,000 replicates) and permutation p-values of three correlations, each a function handed in."""
    s, out = settle(subjects(t)), None
    for name, f in (("spearman", rs.spearman), ("kendall tau-b", rs.kendall), ("pearson", rs.pearson)):
        both = rs.bca(s, ["one"], ["x", "y"], f, B, 21, ["user_id"]).join(rs.permutation_p(s, ["one"], ["x", "y"], f, B, 22, ["user_id"]).select("one", "p"), "one")
        row = both.select(F.lit(name).alias("statistic"), *[F.round(c, 6).alias(c) for c in ("estimate", "ci_lo", "ci_hi", "p")], "interval")
        out = row if out is None else out.unionByName(row)
    return out


def settings(t, last):
    """The first or last event of each subject as a nested value."""
    by = F.struct("ts", "event_id")
    pick = F.max_by if last else F.min_by
    k = F.get_json_object("props", "$.k")
    value = F.struct(F.col("event_type").alias("kind"), F.struct(F.col("value").alias("value"), F.array(F.col("event_type"), k).alias("list")).alias("detail"), F.create_map(F.col("event_type"), k).alias("props"))
    return t.events.groupBy("user_id").agg(pick(value, by).alias("v")).select("user_id", F.col("v.kind").alias("kind"), F.col("v.detail").alias("detail"), F.col("v.props").alias("props"))


def _paths(order):
    return f"""SELECT user_id, unnest(['kind', 'detail.value', 'detail.list.1', 'detail.list.2', 'props.' || event_type]) AS path, unnest([event_type, CAST(value AS VARCHAR), event_type, json_extract_string(props, '$.k'), json_extract_string(props, '$.k')]) AS v
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts {order}, event_id {order}) AS rn FROM events) WHERE rn = 1"""


@query("SET-12", f"""WITH a AS ({_paths('')}), b AS ({_paths('DESC')})
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.path, b.path) AS path, a.v AS before, b.v AS after, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.v IS DISTINCT FROM b.v""")
def path_differences(t):
    """Dotted paths in which a subject's first and last settings (struct, array, map) differ."""
    return nested.path_diff(settings(t, False), settings(t, True), ["user_id"])


@query("FN-10", """SELECT event_id, to_json({'event_id': event_id, 'ts': strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'event_type': event_type, 'big': CASE WHEN user_id % 2 = 0 THEN user_id END})::VARCHAR AS json FROM events""")
def json_rows(t):
    """Rows as JSON text: times as ISO text, numbers that are not finite as null."""
    e = t.events.withColumn("big", F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("double")).otherwise(F.lit(float("nan"))))
    e = e.withColumn("big", nested.finite(F.col("big")).cast("long"))
    return nested.jsonify(e, ["event_id", "ts", "event_type", "big"]).select("event_id", "json")
