import hashlib
import math
from statistics import NormalDist

import numpy as np

from tidemark.catalog import ENTRIES

SF = "/root/testdata/sf0.001"


def test_bca_correlation_equals_brute_force_with_10000_replicates(spark):
    from tidemark.catalog.registry import Tables
    from tidemark.catalog.stats import subjects
    rows = sorted((r.user_id, float(r.x), float(r.y)) for r in subjects(Tables(spark, SF)).collect())
    x, y = (np.array([r[k] for r in rows]) for k in (1, 2))
    n, total = len(rows), 10_000
    corr = lambda a, b: np.corrcoef(a, b)[0, 1]
    r = corr(x, y)
    pick = np.array([[int(hashlib.md5(f"3|0|{rep}|{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for rep in range(1, total + 1)])
    with np.errstate(all="ignore"):
        reps = np.array([corr(x[p], y[p]) for p in pick])
    reps = np.sort(reps[~np.isnan(reps)])
    jack = np.array([corr(np.delete(x, i), np.delete(y, i)) for i in range(n)])
    d = jack.mean() - jack
    a, z = (d**3).sum() / (6 * (d**2).sum() ** 1.5), NormalDist().inv_cdf((reps < r).mean())
    def cut(q):
        p = NormalDist().cdf(z + (z + q) / (1 - a * (z + q)))
        k = min(max(p * len(reps) + 0.5, 1), len(reps))
        lo, hi = reps[math.floor(k) - 1], reps[math.ceil(k) - 1]
        return lo + (k - math.floor(k)) * (hi - lo)
    got = ENTRIES["bca_correlation"].run(spark, SF).first()
    assert got.n == n and got.interval == "bca" and math.isclose(got.r, r, abs_tol=1e-6)
    assert math.isclose(got.ci_lo, cut(-1.959963984540054), abs_tol=1e-4) and math.isclose(got.ci_hi, cut(1.959963984540054), abs_tol=1e-4)
