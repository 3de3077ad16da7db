import hashlib

import numpy as np
import xxhash

from tidemark.operators import draws


def test_array_draws_equal_single_hashes(monkeypatch):
    monkeypatch.setattr(draws, "_CHUNK", 64)
    for prefix in ("3|0|17|", "5|10000|", "1|0|case|9|", "ab|", "x" * 60):
        want = [int(hashlib.md5(f"{prefix}{i}".encode()).hexdigest()[:8], 16) for i in range(1203)]
        assert draws.md5_numbers(prefix, 1203).tolist() == want
    seed = -55
    h = xxhash.xxh64_intdigest((9).to_bytes(4, "little"), seed=seed % 2**64)
    want = [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=h) & 0xFFFFFFFF for i in range(200)]
    assert draws.xxhash_numbers(seed, 9, 200).tolist() == want
    long_ = draws.xxhash_longs(draws.xxhash_seed(seed), np.array([7_777_777_777]))
    assert int(long_[0]) == xxhash.xxh64_intdigest((7_777_777_777).to_bytes(8, "little"), seed=seed % 2**64)


def test_a_large_key_is_resampled_without_shuffled_draws(spark):
    """More rows than the former limit of 100,000, whose replicates were rows of shuffles."""
    from pyspark.sql import functions as F
    from tidemark.operators import stats as st
    n = 100_003
    rows = spark.range(n).select(F.lit(0).alias("one"), F.col("id").alias("ix"), F.lit(n).cast("long").alias("n_rows"), (F.col("id") % 97).alias("x"), (F.col("id") % 89).alias("y"))
    got = st.resampled_corr(rows, ["one"], "x", "y", 3, 3, "r")
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    i = np.array([int(hashlib.md5(f"3|0|2|{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)])
    assert np.isclose(got.where("rep = 2").first().r, np.corrcoef(i % 97, i % 89)[0, 1])


def test_kendall_by_a_table_equals_pairs(monkeypatch):
    from tidemark.operators import resampling as rs
    r = np.random.default_rng(4)
    small = r.integers(0, 7, size=(6, 60, 2)).astype(float)
    flat = np.concatenate([small, np.ones((1, 60, 2))])
    want = rs._kendall_by_pairs(flat)
    wide = r.normal(size=(2, 300, 2))
    assert np.array_equal(rs.kendall(wide), rs._kendall_by_pairs(wide))
    monkeypatch.setattr(rs, "_kendall_by_pairs", None)
    assert np.array_equal(rs.kendall(flat), want, equal_nan=True) and np.isnan(want[-1])


def test_middle_ranks_are_those_of_all_drawn_ones():
    """The medians of replicates come from the ranks around the middle; also where the middle is far off."""
    from tidemark.operators import stats
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 64, 999, 5000):
        x = np.round(rng.gamma(2, 1, n), 1)
        ranks, s = stats.ranked([x])
        for drawn in (rng.integers(0, n, n), np.zeros(n, int), np.full(n, n - 1)):
            a, b = stats.middle_ranks(ranks[drawn])
            whole = np.sort(x[drawn])
            assert (s[a], s[b]) == (whole[(n - 1) // 2], whole[n // 2])


def test_numbers_below_a_limit_are_remainders_across_blocks():
    n = 40_000
    h = draws.xxhash_numbers(-5, 3, n)
    one = draws.xxhash_ints(draws.xxhash_ints(draws.xxhash_seed(-5), np.array([3])), np.arange(n)) & np.uint64(0xFFFFFFFF)
    assert (h == one).all()
    for m in (1, 7, n, 2**31 + 5):
        assert (draws.below(h.copy(), m) == h % np.uint32(m)).all()
