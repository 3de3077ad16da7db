import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as ev
from tidemark.operators import intervals as iv
from tidemark.operators.components import connected_components
from tidemark.operators.islands import islands
from tidemark.operators.quantiles import exact_percentiles
from tidemark.operators.rangejoin import overlap_join
from tidemark.operators.scan import lag, last_known, lead, next_known, ordered_scan, position, running_max, running_sum
from tidemark.operators.slicing import fixed_slice, slice_of

KEY = ["k"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def spans(spark, seed, n=120, top=400, width=25):
    """A hot key holding two thirds of the rows, with touching, nested, empty and reversed intervals."""
    r = random.Random(seed)
    data = []
    for i in range(n):
        lo = r.randrange(top)
        data.append((r.choice(["hot", "hot", "b"]), i, lo, lo + r.choice([-3, 0, 1, 2, 5, width, 3 * width])))
    return spark.createDataFrame(data, "k string, event_id long, lo long, hi long"), data


def merge(ivs, gap=0):
    out = []
    for lo, hi in sorted(i for i in ivs if i[1] > i[0]):
        if out and lo <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def by_key(data):
    d = {}
    for k, _, lo, hi in data:
        d.setdefault(k, []).append((lo, hi))
    return d


def test_slices_are_balanced_monotone_and_skip_small_inputs(spark):
    burst = F.when(F.col("id") < 15000, F.lit(5.0) + F.col("id") / 1e6).otherwise(F.col("id").cast("double"))
    df = spark.range(20000).select(F.when(F.col("id") == 19999, F.lit(-1e12)).otherwise(burst).alias("t"))
    assert slice_of(df, "t", 10**6) is None
    cut = df.withColumn("s", slice_of(df, "t", 1000))
    sizes = cut.groupBy("s").count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 2000 and sizes[1] >= 15           # despite an outlier and 15000 rows within 0.015 units
    g = cut.groupBy("s").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("s").collect()
    assert all(x.b <= y.a for x, y in zip(g, g[1:]))


def test_locate_searches_all_levels(spark):
    from tidemark.operators.slicing import locate
    cuts = [i * 1.5 - 700 for i in range(2500)]
    df = spark.range(-800, 4000, 7).select(F.col("id").cast("double").alias("t"))
    got = df.select("t", locate(F.col("t"), cuts).alias("s")).collect()
    assert all(r.s == sum(c <= r.t for c in cuts) for r in got)


@pytest.mark.parametrize("width", [7, 60, 1000])
def test_scan_slices_equal_plain_windows(spark, width):
    df, _ = spans(spark, 1)
    v = F.when(F.col("hi") % 3 == 0, F.col("hi"))
    steps = [lag("lag", "hi"), lead("lead", v), running_sum("sum", "hi"), running_sum("excl", "hi", inclusive=False), position("n"),
             running_max("reach", "hi"), last_known("last", v), last_known("last_x", v, inclusive=False), next_known("next", v), next_known("next_x", v, inclusive=False)]
    plain = ordered_scan(df, KEY, ["lo", "event_id"], steps, None)
    sliced = ordered_scan(df, KEY, ["lo", "event_id"], steps, fixed_slice("lo", width))
    key = lambda d: sorted((tuple(r) for r in d.collect()), key=repr)
    assert key(plain) == key(sliced)


@pytest.mark.parametrize("seed", range(4))
def test_interval_algebra_against_brute_force(spark, seed):
    a, da = spans(spark, seed)
    b, db = spans(spark, seed + 50)
    sl = fixed_slice("lo", 30)
    A, B = by_key(da), by_key(db)
    want = sorted((k, *i) for k in A for i in merge(A[k]))
    assert rows(iv.union(a, KEY, None)) == want == rows(iv.union(a, KEY, sl))
    point = lambda ivs: {t for lo, hi in merge(ivs) for t in range(lo, hi)}
    def cells(df):
        out = {}
        for k, lo, hi in rows(df):
            out.setdefault(k, []).extend(range(lo, hi))
        return {k: sorted(v) for k, v in out.items() if v}
    expect = lambda op: {k: sorted(x) for k in A if (x := op(point(A[k]), point(B.get(k, []))))}
    assert cells(iv.intersect(a, b, KEY, None)) == expect(lambda x, y: x & y)
    assert cells(iv.subtract(a, b, KEY, None)) == expect(lambda x, y: x - y)
    both = {r[1]: r[-1] for r in rows(iv.overlap_length(a, b, KEY, slice_by=None).select("k", "event_id", "overlap"))}
    for k, i, lo, hi in da:
        assert both[i] == (len(set(range(lo, hi)) & point(B.get(k, []))) if hi > lo else 0)
    tot = dict(rows(iv.total_length(a, KEY, slice_by=sl)))
    assert tot == {k: len(point(A[k])) for k in A}


def test_islands_gap_strictness_and_measures(spark):
    df = spark.createDataFrame([("x", 0, 10), ("x", 10, 12), ("x", 15, 20), ("x", 18, 19)], "k string, lo long, hi long")
    got = lambda **kw: [(r.lo, r.hi) for r in islands(df, KEY, "lo", "hi", **kw).orderBy("lo").collect()]
    for sl in (None, fixed_slice("lo", 4)):
        assert got(slice_by=sl) == [(0, 12), (15, 20)]
        assert got(slice_by=sl, strict=True) == [(0, 10), (10, 12), (15, 20)]
        assert got(slice_by=sl, gap=3) == [(0, 20)]
        assert got(slice_by=sl, gap=3, strict=True) == [(0, 12), (15, 20)]
        m = islands(df, KEY, "lo", "hi", slice_by=sl, measures={"n": ("count", "lo"), "s": ("sum", "hi"), "f": ("min", F.struct("lo", "hi")), "all": ("set", "lo")}).orderBy("lo").collect()
        assert [(r.n, r.s, tuple(r.f), sorted(r["all"])) for r in m] == [(2, 22, (0, 10), [0, 10]), (2, 39, (15, 20), [15, 18])]


def test_long_island_over_many_slices_keeps_rows_whole(spark):
    df = spark.createDataFrame([("x", 0, 1000)] + [("x", i, i + 1) for i in range(5, 2000, 5)], "k string, lo long, hi long")
    want = [(0, 1000 + 1)] + [(i, i + 1) for i in range(1005, 2000, 5)]
    got = islands(df, KEY, "lo", "hi", slice_by=fixed_slice("lo", 20), measures={"n": ("count", "lo")}).orderBy("lo").collect()
    assert [(r.lo, r.hi) for r in got] == want and sum(r.n for r in got) == df.count()


def test_contains_edges(spark):
    cover = spark.createDataFrame([("x", 0, 10), ("x", 20, 30)], "k string, lo long, hi long")
    pts = spark.createDataFrame([("x", t) for t in (-1, 0, 9, 10, 20, 30, 31)] + [("y", 5)], "k string, t long")
    got = {(r.k, r.t): r.inside for r in iv.contains(pts, cover, KEY, "t").collect()}
    assert [t for (k, t), v in sorted(got.items()) if v] == [0, 9, 20, 30]       # half-open, last right edge in
    closed = iv.contains(pts, cover, KEY, "t", closed=True).where("inside").collect()
    assert sorted(r.t for r in closed) == [0, 9, 10, 20, 30]


def test_clock_bins_follow_daylight_saving(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo
    tz = ZoneInfo("Europe/Paris")
    for day, hours in (((2026, 3, 29), 23), ((2026, 10, 25), 25)):
        lo, hi = (dt.datetime(*day, tzinfo=tz).timestamp(), (dt.datetime(*day) + dt.timedelta(days=1)).replace(tzinfo=tz).timestamp())
        df = spark.createDataFrame([("x", lo - 1800, hi + 600)], "k string, lo double, hi double")
        got = {(str(r.day), r.bin): r.length for r in iv.clock_split(df, KEY, "Europe/Paris", [0, 480, 1170, 1440]).collect()}
        name = "%04d-%02d-%02d" % day
        assert sum(v for (d, _), v in got.items() if d == name) == hours * 3600
        assert got[(name, 0)] == (8 - (24 - hours)) * 3600 and sum(got.values()) == hi - lo + 2400


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_equals_nested_loop(spark, seed):
    a, da = spans(spark, seed, 60)
    b, db = spans(spark, seed + 9, 60)
    l = a.select("k", F.col("event_id").alias("i"), F.col("lo").alias("a0"), F.col("hi").alias("a1"))
    r = b.select("k", F.col("event_id").alias("j"), F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    for tol, strict in ((0, False), (4, False), (4, True)):
        ok = (lambda x, y: x < y) if strict else (lambda x, y: x <= y)
        want = sorted((i, j) for k, i, lo, hi in da for k2, j, lo2, hi2 in db
                      if k == k2 and hi >= lo and hi2 >= lo2 and ok(lo - tol, hi2) and ok(lo2 - tol, hi))
        got = overlap_join(l.where("a1 >= a0"), r.where("b1 >= b0"), KEY, l_lo="a0", l_hi="a1", r_lo="b0", r_hi="b1", tol=tol, strict=strict, width=11)
        assert sorted((x.i, x.j) for x in got.collect()) == want


def test_components_on_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(200, 100), (100, 150)], "u long, v long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(65)}, 100: 100, 150: 100, 200: 100}


@pytest.mark.parametrize("seed", range(6))
def test_sparse_contact_edges_connect_like_all_pairs(spark, seed):
    r, tol = random.Random(seed), 4
    data = []
    for i in range(70):
        lo = r.randrange(300)
        data.append((r.choice("st"), r.choice("ABC"), i, lo, lo + r.choice([0, 1, 3, 10, 60])))
    parent = list(range(70))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a in data:
        for b in data:
            if a[0] == b[0] and a[1] != b[1] and max(a[3], b[3]) - min(a[4], b[4]) < tol:
                parent[max(find(a[2]), find(b[2]))] = min(find(a[2]), find(b[2]))
    df = spark.createDataFrame(data, "k string, ch string, event_id long, lo long, hi long")
    edges = ev.contact_edges(df, KEY, "ch", tol)
    assert edges.count() <= 4 * len(data)
    parent2 = list(range(70))
    f2 = lambda x: x if parent2[x] == x else f2(parent2[x])
    for e in edges.collect():
        parent2[max(f2(e.u), f2(e.v))] = min(f2(e.u), f2(e.v))
    assert [find(i) for i in range(70)] == [f2(i) for i in range(70)]


def test_bounded_merge_is_greedy_from_the_left(spark):
    r = random.Random(5)
    data, want = [], []
    for k in "ab":
        t, runs = 0, []
        for _ in range(60):
            lo = t + r.choice([1, 2, 3, 9]); hi = lo + r.choice([0, 2, 5, 40]); t = hi
            runs.append((lo, hi)); data.append((k, lo, hi))
        cur = list(runs[0])
        for lo, hi in runs[1:]:
            if lo - cur[1] <= 3 and hi - cur[0] <= 30:
                cur[1] = hi
            else:
                want.append((k, *cur)); cur = [lo, hi]
        want.append((k, *cur))
    df = spark.createDataFrame(data, "k string, lo long, hi long")
    assert rows(ev.bounded_merge(df, KEY, "lo", "hi", 3, 30)) == sorted(want)


def test_percentiles_midpoint_rule(spark):
    def rule(x, p):
        x = sorted(x); n = len(x); q = min(max(p / 100 * n + 0.5, 1), n); a, b = math.floor(q), math.ceil(q)
        return x[a - 1] + (q - a) * (x[b - 1] - x[a - 1])
    r = random.Random(2)
    vals = {"hot": [round(r.gauss(0, 3), 1) for _ in range(301)], "one": [4.0], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in vals.items() for v in vs] + [("hot", float("nan"))], "k string, v double")
    for sl in (None, fixed_slice("v", 0.7)):
        got = {x.k: x for x in exact_percentiles(df, KEY, "v", {"a": 2.5, "m": 50, "b": 97.5}, sl).collect()}
        for k, vs in vals.items():
            assert all(math.isclose(got[k][c], rule(vs, p), abs_tol=1e-12) for c, p in (("a", 2.5), ("m", 50), ("b", 97.5)))


def test_bracketed_percentiles_equal_full_counts(spark):
    r = random.Random(6)
    vals = [("hot", r.choice([r.gauss(0, 1), float(r.randrange(5)), 1e9])) for _ in range(6000)] + [("one", 4.0), ("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(vals, "k string, v double")
    outs = {"min": 0, "a": 2.5, "m": 50, "b": 97, "max": 100}
    assert rows(exact_percentiles(df, KEY, "v", outs, None, bracket=True)) == rows(exact_percentiles(df, KEY, "v", outs, None, bracket=False))


def test_overlap_length_keeps_equal_rows_apart(spark):
    from tidemark.operators import intervals as iv
    a = spark.createDataFrame([("k", 0, 10)] * 2 + [("k", 30, 40)], "k string, lo long, hi long")
    b = spark.createDataFrame([("k", 5, 20)], "k string, lo long, hi long")
    assert sorted(r.overlap for r in iv.overlap_length(a, b, KEY).collect()) == [0, 5, 5]


def test_decisions_keep_equal_flags_apart(spark):
    from tidemark.operators import tables as tb
    flags = spark.createDataFrame([("a", "12x")] * 2 + [("a", "9"), ("b", "12x"), ("c", None)], "topic string, detail string")
    recorded = spark.createDataFrame([("a", "1", "keep"), ("a", "12", "drop")], "topic string, prefix string, decision string")
    got = sorted((r.topic, r.decision) for r in tb.decided(flags, recorded, "topic", "detail").collect())
    assert got == [("a", "drop"), ("a", "drop"), ("a", "open"), ("b", "open"), ("c", "open")]


def test_defaults_are_the_published_values():
    """Every default that a published parameter file states, by its name there."""
    from tidemark.config import CleanConfig, QualityConfig, SustainedConfig, TransientConfig
    s, t, c, q = SustainedConfig(), TransientConfig(), CleanConfig(), QualityConfig()
    assert (s.band, s.edge_trim_s, s.power, s.window_s, s.median_factor, s.legacy_min_s) == ((5, 75), 1, 4, 2, 10, 15)
    assert (s.ll_window_s, s.ll_threshold, s.ll_accept, s.ll_reject, s.merge_gap_s, s.min_s, s.max_s) == (2, 1.75, 1.90, 1.60, 2, 10, 60)
    assert (t.baseline_start, t.baseline_step, t.baseline_fraction, t.baseline_top, t.lower_factor, t.upper, t.band) == (100, 5, 0.97, 130, 2.5, 2000, (15, 70))
    assert (t.distance_s, t.width_s, t.prominence, t.spike_gap_ms, t.burst_gap_s, t.burst_min_n, t.burst_min_s, t.burst_max_s, t.zone_buffer_s) == (
        0.030, 0.060, 200, 150, 5, 3, 4, 40, 5)
    assert (c.use_fixed, c.fixed, c.k, c.switch_pct, c.mains_hz, c.halfwidth_hz) == (True, (-2500, 2500), 10, 0.1, 50, 2)
    assert (q.window_s, q.scale_band, q.line_hz, q.line_db, q.line_intermittent_pct, q.low_snr_db, q.min_snr_db, q.attenuation_ratio) == (4, (15, 70), 50, 10, 10, 26, 12, 3)


def test_slices_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    """Four partitions of the session held 1,000 rows each before, whatever the number of slices."""
    from tidemark.operators import slicing
    from tidemark.operators.scan import lag, ordered_scan
    monkeypatch.setattr(slicing, "TARGET_ROWS", 500)
    monkeypatch.setattr(slicing, "TASK_ROWS", 100)
    df = spark.range(4000).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"))
    got = ordered_scan(df, ["k"], ["t"], [lag("p", "t")]).withColumn("part", F.spark_partition_id()).collect()
    assert all(r.p == (r.t - 3 if r.t >= 3 else None) for r in got) and len(got) == 4000
    held = [r.part for r in got]
    assert max(held.count(p) for p in set(held)) < 1000
    joined = islands(df.withColumn("u", F.col("t") + 1), ["k"], "t", "u", gap=2, measures={"n": ("count", "t")}).collect()
    assert sorted((r.k, r.t, r.n) for r in joined) == [(0, 0, 1334), (1, 1, 1333), (2, 2, 1333)]


def test_small_keys_are_not_cut_however_many_rows_there_are(spark, monkeypatch):
    """Forty keys of 100 rows went through slices, carries and a join before, as all rows together are more than a slice holds."""
    import re
    from tidemark.operators import slicing
    from tidemark.operators.scan import lag, ordered_scan
    monkeypatch.setattr(slicing, "TARGET_ROWS", 500)
    df = spark.range(4000).select((F.col("id") % 40).alias("k"), F.col("id").alias("t"))
    nodes = lambda d: re.findall(r"^[ :+|-]*(Join|Union)", d._jdf.queryExecution().optimizedPlan().toString(), re.M)
    got = ordered_scan(df, ["k"], ["t"], [lag("p", "t")])
    assert nodes(got) == [] and all(r.p == (r.t - 40 if r.t >= 40 else None) for r in got.collect())
    merged = islands(df.withColumn("u", F.col("t") + 1), ["k"], "t", "u", gap=39)
    assert nodes(merged) == [] and merged.count() == 40
    assert nodes(ordered_scan(df.withColumn("k", F.col("t") % 2), ["k"], ["t"], [lag("p", "t")])) == ["Join"]


def test_sets_that_are_disjoint_are_not_merged_again(spark, monkeypatch):
    """The recording was merged again by every operation on it: six merges before, four now."""
    from tidemark.operators.exposure import observation_sets
    calls, union = [], iv.union
    monkeypatch.setattr(iv, "union", lambda *a, **k: calls.append(1) or union(*a, **k))
    spans = lambda *r: spark.createDataFrame([("a", *x) for x in r], "k string, lo long, hi long")
    sets = observation_sets(spans((0, 10), (5, 20), (30, 40)), spans((8, 12)), spans((15, 35)), spans((15, 35)), ["k"])
    got = {n: sorted((r.lo, r.hi) for r in d.collect()) for n, d in sets.items()}
    assert got == {"rec": [(0, 20), (30, 40)], "eeg": [(0, 8), (12, 15), (35, 40)], "observed": [(0, 8), (12, 20), (30, 40)]}
    assert len(calls) == 4
