import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import nested
from tidemark.operators import resampling as rs
from tidemark.operators import stats as st


def tau_b(x, y):
    n, s, tx, ty = len(x), 0, 0, 0
    for i in range(n):
        for j in range(i + 1, n):
            s, tx, ty = s + np.sign(x[j] - x[i]) * np.sign(y[j] - y[i]), tx + (x[i] == x[j]), ty + (y[i] == y[j])
    return s / math.sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty))


def test_statistics_equal_their_definitions():
    r = np.random.default_rng(1)
    v = r.integers(0, 5, (20, 12, 2)).astype(float)
    for one, k, s in zip(v, rs.kendall(v), rs.spearman(v), strict=True):
        x, y = one.T
        ranks = [np.array([(c < a).sum() + ((c == a).sum() + 1) / 2 for a in c]) for c in (x, y)]
        assert math.isclose(k, tau_b(x, y), abs_tol=1e-12) and math.isclose(s, np.corrcoef(*ranks)[0, 1], abs_tol=1e-12)
    assert np.isnan(rs.pearson(np.ones((1, 4, 2)))).all()


def test_intervals_and_permutations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK", 70)
    r = np.random.default_rng(2)
    rows = [(k, i, float(x), float(0.5 * x + e)) for k, n in ((0, 25), (1, 9)) for i, (x, e) in enumerate(r.normal(size=(n, 2)))] + [(0, 99, None, 1.0), (2, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k int, id int, x double, y double").repartition(3)
    got = {v.k: v for v in rs.bca(df, ["k"], ["x", "y"], rs.spearman, 300, 5, ["id"]).collect()}
    perm = {v.k: v.p for v in rs.permutation_p(df, ["k"], ["x", "y"], rs.spearman, 300, 5, ["id"]).collect()}
    for k, n in ((0, 25), (1, 9)):
        v = np.array([[x, y] for kk, _, x, y in rows if kk == k and x is not None])
        one = lambda a: rs.spearman(np.asarray(a)[None])[0]
        boots, mixed = [], []
        for block in range(5):
            count = min(70, 300 - 70 * block)
            boots += [one(v[i]) for i in rs.generator(5, (k,), block).integers(0, n, (count, n))]
            ys = rs.generator(5, (k,), block).permuted(np.repeat(v[None, :, 1], count, axis=0), axis=1)
            mixed += [one(np.column_stack([v[:, 0], y])) for y in ys]
        jack = np.array([one(np.delete(v, i, axis=0)) for i in range(n)])
        lo, hi, kind = rs.bca_bounds(one(v), np.array(boots), jack, 95.0)
        assert np.allclose([got[k].estimate, got[k].ci_lo, got[k].ci_hi], [one(v), lo, hi]) and got[k].interval == kind == "bca" and lo < one(v) < hi
        assert math.isclose(perm[k], (sum(abs(m) >= abs(one(v)) - 1e-12 for m in mixed) + 1) / 301)
    assert got[2].interval == "none" and got[2].ci_lo is None
    monkeypatch.setattr(rs, "LOCAL_ROWS", 5)
    with pytest.raises(ValueError):
        rs.bca(df, ["k"], ["x", "y"], rs.spearman, 10, 5, ["id"])


def test_keys_of_many_rows_are_resampled_by_their_different_rows(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = r.integers(0, 4, (60, 2)).astype(float)
    v[:, 1] += v[:, 0]
    df = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(v)], "k int, id int, x double, y double").repartition(3)
    plain = lambda a: rs.kendall(a)  # noqa: E731  a statistic without a form for counted rows
    run = lambda f: [rs.bca(df, ["k"], ["x", "y"], f, 2000, 5, ["id"]).first(), rs.permutation_p(df, ["k"], ["x", "y"], f, 2000, 5, ["id"]).first()]
    near = {f: run(f) for f in (rs.kendall, rs.spearman, rs.pearson)}
    monkeypatch.setattr(rs, "LOCAL_ROWS", 30)  # more rows, fewer different ones
    far = {f: run(f) for f in near}
    for f in near:
        (a, p), (b, q) = near[f], far[f]
        assert math.isclose(a.estimate, b.estimate) and np.allclose([a.ci_lo, a.ci_hi], [b.ci_lo, b.ci_hi], atol=0.03) and a.interval == b.interval == "bca" and abs(p.p - q.p) < 0.01
    assert np.allclose([*run(plain)[0][1:4]], [*far[rs.kendall][0][1:4]])
    left = [x.r for x in rs.replicated(df, ["k"], ["x", "y"], rs.spearman, "leave one out", 0, 5, ["id"]).collect()]
    assert np.allclose(sorted(left), sorted(rs.spearman(np.delete(v, i, axis=0)[None])[0] for i in range(60)))


def test_counted_statistics_equal_those_of_all_rows():
    r = np.random.default_rng(6)
    values, w = np.unique(r.integers(0, 5, (30, 2)), axis=0).astype(float), None
    w = r.integers(0, 4, (7, len(values)))
    for values in (values, r.normal(size=values.shape) * 1000):
        for f in (rs.pearson, rs.spearman, rs.kendall):
            assert np.allclose(f.counted(values, w), [f(np.repeat(values, n, axis=0)[None])[0] for n in w])
    many = np.column_stack([r.permutation(400), r.permutation(400)]).astype(float)  # compared by pairs
    n = r.integers(0, 3, (2, 400))
    assert np.allclose(rs.kendall.counted(many, n), [rs._kendall_by_pairs(np.repeat(many, k, axis=0)[None])[0] for k in n])


def test_replicates_are_the_same_with_and_without_shuffles(spark, monkeypatch):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", float(x), float(y)) for i, (x, y) in enumerate(r.normal(5, 1, size=(40, 2)))], "id int, g string, x double, y double").withColumn("one", F.lit(0))
    def run():
        rows = st.indexed(df, ["one"], ["id"])
        return [st.group_compare(df, "g", "a", "b", "x", ["id"], 50, 1).select("fold", "ci_lo", "ci_hi").first(), st.permutation_test(rows, ["one"], "x", "y", 50, 2).select("r", "p").first(),
                st.bca_correlation(rows, ["one"], "x", "y", 50, 3).select("r", "ci_lo", "ci_hi").first()]
    near = run()
    monkeypatch.setattr(st, "LOCAL_ROWS", 0)
    assert all(np.allclose(a, b) for a, b in zip(near, run(), strict=True))


def test_exposure_replicates_equal_brute_force(spark):
    minutes = [30, 700, 710, 720, 1400, 715]
    df = spark.createDataFrame([(1, m) for m in minutes] + [(2, 5)], "u int, minute int")
    ex = spark.createDataFrame([(1, h, float(s)) for h, s in ((0, 100), (11, 50), (12, 250))] + [(2, 3, 1.0)], "u int, hour int, seconds double")
    got = {v.u: v for v in st.rayleigh_exposure(df, ex, ["u"], "minute", 40, 7).collect()}
    draws = spark.range(6).crossJoin(spark.range(1, 41).select(F.col("id").cast("int").alias("rep"))).select("rep", F.xxhash64(F.lit(7), F.lit(1), "rep", "id").alias("h")).collect()
    turns = {}
    for d in draws:
        h = d.h % 2**64
        u, w = (h >> 32) / 2**32 * 400, (h & 0xFFFFFFFF) / 2**32
        turns.setdefault(d.rep, []).append(2 * math.pi / 24 * ((0 if u < 100 else 11 if u < 150 else 12) + w))
    length = lambda a: abs(np.exp(1j * np.array(a)).mean())
    rbar = length([2 * math.pi * m / 1440 for m in minutes])
    assert math.isclose(got[1].p_exposure, (sum(length(a) >= rbar for a in turns.values()) + 1) / 41) and got[2].rbar is None


@pytest.mark.parametrize("n", [1, 67, 2500, 40000])
def test_rounded_clock_keeps_its_error(n):
    from tidemark.operators.draws import xxhash_longs
    r = np.random.default_rng(n)
    clock = st.ExposureClock()
    for hours, seconds in ((np.arange(24.0), r.integers(1, 500, 24)), (np.array([0.0, 11, 12, 23]), np.array([1.0, 1e-6, 65534, 1])), (np.array([5.0]), np.ones(1))):
        cdf = np.cumsum(seconds.astype(float))
        seeds = r.integers(0, 2**64, 300 if n < 2000 else 12, dtype=np.uint64)
        h = xxhash_longs(seeds[:, None], np.arange(n))
        place = np.minimum(np.searchsorted(cdf, (h >> np.uint64(32)) / 2.0**32 * cdf[-1], "right"), len(cdf) - 1)
        want = np.abs(np.exp(2j * np.pi / 24 * (hours[place] + (h & np.uint64(0xFFFFFFFF)) / 2.0**32)).mean(axis=1))
        about, error = clock.lengths(seeds, n, hours, cdf)
        assert (np.abs(about - want) <= error).all() and error < 6e-4 and np.abs(about - want).max() > 0


def test_paths_of_nested_values(spark):
    kind = "k int, a struct<b:int,c:struct<d:string>>, m map<string,array<int>>, l array<struct<x:int>>"
    a = spark.createDataFrame([(1, (1, ("x",)), {"p": [1, 2], "q": []}, [(1,), None]), (2, None, {}, []), (3, (1, (None,)), None, None)], kind)
    b = spark.createDataFrame([(1, (1, ("y",)), {"p": [1, 3, 4]}, [(1,), (2,)]), (2, None, {}, []), (3, (1, (None,)), None, None)], kind)
    got = {(r.k, r.path): (r.before, r.after, r.change) for r in nested.path_diff(a, b, ["k"]).collect()}
    assert got == {(1, "a.c.d"): ("x", "y", "changed"), (1, "m.p.2"): ("2", "3", "changed"), (1, "m.p.3"): (None, "4", "added"), (1, "m.q"): ("[]", None, "removed"),
                   (1, "l.2"): (None, None, "removed"), (1, "l.2.x"): (None, "2", "added")}
    assert {r.path for r in nested.path_diff(a, b, ["k"], ignore=["m", "l"]).collect()} == {"a.c.d"}


def test_groups_of_threshold_variants_equal_single_comparisons(spark):
    from tidemark.plans import sensitivity
    r = np.random.default_rng(6)
    rows = [(v, i, "case" if i % 2 else "control", float(r.normal()), *[float(x) for x in r.gamma(2, size=4)]) for v in ("actual", "fixed_1") for i in range(20)]
    df = spark.createDataFrame(rows, "variant string, subject int, grp string, outcome double, " + ", ".join(f"{c} double" for c in sensitivity.RATES))
    out = {(x.variant, x.metric): x for x in sensitivity.by_group(df, "subject", "grp", "case", "control", "outcome", 60, 4).collect()}
    assert len(out) == 8
    for (variant, metric), x in out.items():
        one = df.where(F.col("variant") == variant)
        v = {g: [y[metric] for y in one.collect() if y.grp == g] for g in ("case", "control")}
        assert math.isclose(x.fold, np.median(v["case"]) / np.median(v["control"])) and x.ci_lo <= x.fold <= x.ci_hi and x.fold_reached == (x.fold >= 10)
        assert math.isclose(x.cliffs_delta, np.mean([np.sign(a - b) for a in v["case"] for b in v["control"]]))
