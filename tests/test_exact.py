import itertools
import math

import numpy as np

from tidemark.operators import exact


def average_ranks(v):
    return np.array([(np.sum(v < x) + (np.sum(v == x) + 1) / 2) for x in v])


def test_rank_sums_equal_all_choices(spark):
    r = np.random.default_rng(1)
    rows, want = [], {}
    for k, (n, m, top) in enumerate([(3, 5, 100), (4, 4, 3), (1, 6, 2), (9, 10, 4), (2, 2, 1), (10, 9, 50)]):
        a, b = r.integers(0, top, n), r.integers(0, top, m)
        rows += [(k, "a", float(v)) for v in a] + [(k, "b", float(v)) for v in b]
        ranks = average_ranks(np.concatenate([a, b]))
        w, sums = ranks[:n].sum(), np.array([ranks[list(c)].sum() for c in itertools.combinations(range(n + m), n)])
        want[k] = min(1.0, 2 * min((sums <= w + 1e-9).mean(), (sums >= w - 1e-9).mean()))
    df = spark.createDataFrame(rows, "k int, g string, v double")
    got = {x.k: (x.p, x.method) for x in exact.rank_sum_test(df, ["k"], "g", "a", "b", "v").collect()}
    assert all(got[k][1] == "exact" and math.isclose(got[k][0], p, abs_tol=1e-12) for k, p in want.items())
    larger = {x.k: (x.p, x.method) for x in exact.rank_sum_test(df, ["k"], "g", "a", "b", "v", limit=0).collect()}
    assert larger[5][1] == "normal" and abs(larger[5][0] - want[5]) < 0.03


def test_signed_ranks_equal_all_signs(spark):
    rows, want = [], {}
    for k, d in enumerate([[1.0, -2, 3, 4, 0], [1, 1, -1, 2, -3, 5, 5], [2.0], [-1.0] * 6, list(np.random.default_rng(3).integers(-9, 9, 14))]):
        rows += [(k, float(v)) for v in d]
        d = np.array([v for v in d if v != 0], float)
        ranks = average_ranks(np.abs(d))
        w, sums = ranks[d > 0].sum(), np.array([np.dot(s, ranks) for s in itertools.product((0, 1), repeat=len(d))])
        want[k] = min(1.0, 2 * min((sums <= w + 1e-9).mean(), (sums >= w - 1e-9).mean()))
    got = {x.k: x.p for x in exact.signed_rank_test(spark.createDataFrame(rows, "k int, d double"), ["k"], "d").collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], p, abs_tol=1e-12) for k, p in want.items())


def test_kendall_equals_all_orders_and_the_normal_form(spark):
    r = np.random.default_rng(4)
    x, y = np.arange(7.0), r.permutation(7).astype(float)
    s = lambda v: sum(np.sign(v[j] - v[i]) for i in range(7) for j in range(i + 1, 7))
    sums = np.array([s(np.array(p)) for p in itertools.permutations(range(7))])
    want = min(1.0, 2 * min((sums <= s(y)).mean(), (sums >= s(y)).mean()))
    tied = [(1, float(a), float(b)) for a, b in zip(r.integers(0, 4, 40), r.integers(0, 4, 40), strict=True)]
    df = spark.createDataFrame([(0, a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)] + tied, "k int, x double, y double")
    got = {v.k: v for v in exact.kendall_test(df, ["k"], "x", "y").collect()}
    assert got[0].method == "exact" and math.isclose(got[0].p, want, abs_tol=1e-12) and math.isclose(got[0].tau_b, s(y) / 21)
    a, b = np.array([t[1:] for t in tied]).T
    big = sum(np.sign(a[j] - a[i]) * np.sign(b[j] - b[i]) for i in range(40) for j in range(i + 1, 40))
    ta, tb = (np.unique(v, return_counts=True)[1] for v in (a, b))
    f = lambda t, g: sum(g(c) for c in t)
    var = ((40 * 39 * 85 - f(ta, lambda c: c * (c - 1) * (2 * c + 5)) - f(tb, lambda c: c * (c - 1) * (2 * c + 5))) / 18
           + f(ta, lambda c: c * (c - 1)) * f(tb, lambda c: c * (c - 1)) / (2 * 40 * 39)
           + f(ta, lambda c: c * (c - 1) * (c - 2)) * f(tb, lambda c: c * (c - 1) * (c - 2)) / (9 * 40 * 39 * 38))
    assert got[1].method == "normal" and math.isclose(got[1].p, math.erfc(max(abs(big) - 1, 0) / math.sqrt(2 * var)), rel_tol=1e-9)


def test_correlation_p_values(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 2.0, 1.0), (0, 3.0, 4.0), (0, 4.0, 3.0), (0, 5.0, 6.0), (1, 1.0, 1.0)], "k int, x double, y double")
    got = {(v.k, v.method): (v.estimate, v.p) for v in exact.correlation_tests(df, ["k"], "x", "y").collect()}
    rho, p = got[0, "spearman"]
    t = rho * math.sqrt(3 / (1 - rho**2))
    # Student's distribution with three degrees of freedom in closed form
    want = 1 - 2 / math.pi * (t / math.sqrt(3) / (1 + t * t / 3) + math.atan(t / math.sqrt(3)))
    assert math.isclose(p, want, rel_tol=1e-9) and got[1, "spearman"][1] is None and got[0, "kendall tau-b"][1] > 0
