"""Resampling of any statistic: bootstrap with bias-corrected accelerated intervals, leave-one-out, permutations.

A statistic is a function of an array ``(replicates, rows, columns)`` that returns one number a replicate, so numpy works on many replicates at once.  The rows of a
key (up to ``LOCAL_ROWS``, counted) travel as one array; blocks of replicates are dealt to the cluster, and what comes back is one number
a replicate.  Of larger keys the different rows travel, each with its number, and a replicate draws these numbers (multinomial for a bootstrap,
a table with the same margins for a permutation); a statistic's ``counted(values, weights)`` works on them as they are.  Equal rows have one leave-one-out value.
Draws come from a generator seeded by seed, key and block: the same on any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import settle

Statistic = Callable[[np.ndarray], np.ndarray]
#: Replicates a task makes at a time, and array cells that it holds for them.
BLOCK, CELLS = 200, 1 << 22
#: Most rows of a key that travel one by one, and most different rows of a larger one.
LOCAL_ROWS = 100_000


# ---------------------------------------------------------------- statistics

def pearson(v: np.ndarray) -> np.ndarray:
    d = v - v.mean(axis=1, keepdims=True)
    xy, xx, yy = (d[..., 0] * d[..., 1]).sum(axis=1), (d[..., 0] ** 2).sum(axis=1), (d[..., 1] ** 2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks along the last axis, ties averaged."""
    order = np.argsort(x, axis=-1, kind="stable")
    s = np.take_along_axis(x, order, axis=-1)
    n = np.arange(x.shape[-1])
    new = np.concatenate([np.ones((*x.shape[:-1], 1), bool), s[..., 1:] != s[..., :-1]], axis=-1)
    end = np.concatenate([new[..., 1:], np.ones((*x.shape[:-1], 1), bool)], axis=-1)
    first = np.maximum.accumulate(np.where(new, n, 0), axis=-1)
    last = np.minimum.accumulate(np.where(end, n, x.shape[-1])[..., ::-1], axis=-1)[..., ::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=-1)
    return out


def spearman(v: np.ndarray) -> np.ndarray:
    return pearson(np.stack([average_ranks(v[..., 0]), average_ranks(v[..., 1])], axis=-1))


def kendall(v: np.ndarray) -> np.ndarray:
    """Tau-b from a table of the distinct values where that has at most 64 cells a row, else from all pairs."""
    levels = [np.unique(v[..., c], return_inverse=True) for c in (0, 1)]
    width, height = (len(values) for values, _ in levels)
    if not v.size or np.isnan(v).any() or width * height > 64 * v.shape[1]:
        return _kendall_by_pairs(v)
    cell = (levels[0][1] * height + levels[1][1]).reshape(v.shape[:2])
    found = [_concordance(np.bincount(row, minlength=width * height).reshape(width, height)) for row in cell]
    return _tau_b(v.shape[1], *np.array(found, float).reshape(-1, 3).T)


def _concordance(n: np.ndarray) -> tuple[int, int, int]:
    """Concordant less discordant pairs, pairs tied in the first and in the second value, of a table of counts."""
    pairs = lambda n: (n * (n - 1) // 2).sum()
    after = n[::-1].cumsum(axis=0)[::-1][1:]  # rows with a larger first value, by second value
    below = after.cumsum(axis=1)
    return (n[:-1] * (below[:, -1:] - below)).sum() - (n[:-1] * (below - after)).sum(), pairs(n.sum(axis=1)), pairs(n.sum(axis=0))


def _tau_b(n: int, s: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    n0 = n * (n - 1) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((n0 > tx) & (n0 > ty), s / np.sqrt((n0 - tx) * (n0 - ty)), np.nan)


def _kendall_by_pairs(v: np.ndarray) -> np.ndarray:
    """Works through the partners of one row after the other, so memory stays that of the rows."""
    s, tx, ty = (np.zeros(len(v)) for _ in range(3))
    for i in range(v.shape[1] - 1):
        a, b = np.sign(v[:, i + 1:, 0] - v[:, i:i + 1, 0]), np.sign(v[:, i + 1:, 1] - v[:, i:i + 1, 1])
        s += (a * b).sum(axis=1)
        tx += (a == 0).sum(axis=1)
        ty += (b == 0).sum(axis=1)
    return _tau_b(v.shape[1], s, tx, ty)


# the same of different rows ``values`` and how often each replicate has them, ``weights (replicates, rows)``

def _weighted_pearson(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    d = v - (v * w[..., None]).sum(axis=1, keepdims=True) / w.sum(axis=1)[:, None, None]
    xy, xx, yy = (w * d[..., 0] * d[..., 1]).sum(axis=1), (w * d[..., 0] ** 2).sum(axis=1), (w * d[..., 1] ** 2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((xx > 0) & (yy > 0), xy / np.sqrt(xx * yy), np.nan)


def _counted_ranks(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Average ranks ``(replicates, rows)``."""
    level = np.unique(x, return_inverse=True)[1]
    order = np.argsort(level, kind="stable")
    n = np.add.reduceat(w[:, order], np.flatnonzero(np.diff(level[order], prepend=-1)), axis=1)
    return (np.cumsum(n, axis=1) - (n - 1) / 2)[:, level]


def _counted_kendall(values: np.ndarray, w: np.ndarray) -> np.ndarray:
    (x, xi), (y, yi) = (np.unique(values[:, c], return_inverse=True) for c in (0, 1))
    n = w.sum(axis=1)
    if not np.isnan(values).any() and len(x) * len(y) <= max(1 << 16, 64 * len(values)):
        tables = (np.bincount(xi * len(y) + yi, weights=row, minlength=len(x) * len(y)).astype(np.int64).reshape(len(x), len(y)) for row in w)
        return _tau_b(n, *np.array([_concordance(t) for t in tables], float).reshape(-1, 3).T)
    s = np.zeros(len(w))
    tx, ty = ((w * (w - 1) / 2).sum(axis=1) for _ in range(2))
    for i in range(len(values) - 1):
        a, b = (np.sign(values[i + 1:, c] - values[i, c]) for c in (0, 1))
        pairs = w[:, i:i + 1] * w[:, i + 1:]
        s, tx, ty = s + (pairs * (a * b)).sum(axis=1), tx + (pairs * (a == 0)).sum(axis=1), ty + (pairs * (b == 0)).sum(axis=1)
    return _tau_b(n, s, tx, ty)


pearson.counted = lambda values, w: _weighted_pearson(values[None], w)
spearman.counted = lambda values, w: _weighted_pearson(np.stack([_counted_ranks(values[:, c], w) for c in (0, 1)], axis=-1), w)
kendall.counted = _counted_kendall


def counted(statistic: Statistic, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The statistic of each replicate: by its own ``counted``, or of all its rows."""
    if hasattr(statistic, "counted"):
        return statistic.counted(values, weights)
    return np.concatenate([statistic(np.repeat(values, w, axis=0)[None]) for w in weights])


# ---------------------------------------------------------------- replicates

def generator(seed: int, key: Sequence, block: int) -> np.random.Generator:
    return np.random.default_rng([seed, xxhash.xxh32_intdigest(repr(tuple(key)).encode()), block])


def replicated(rows: DataFrame, keys: Sequence[str], values: Sequence[str], statistic: Statistic, kind: str, replicates: int, seed: int, order: Sequence[str]) -> DataFrame:
    """``keys, rep, r``: the statistic of every replicate; ``kind``: ``bootstrap``, ``leave one out``, ``permutation`` (of the last column) or ``estimate``."""
    keys = list(keys)
    ok = rows.where(F.expr(" AND ".join(f"{v} IS NOT NULL" for v in values)))
    ok = settle(ok.select(*keys, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(v).cast("double").alias(v) for v in values]))
    most = ok.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > LOCAL_ROWS or kind == "leave one out":
        return _replicated_counts(ok, keys, values, statistic, kind, replicates, seed)
    cell = F.struct(*[f"_o{i}" for i in range(len(order))], F.array(*values).alias("v"))
    packed = ok.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("_v"))
    spread = packed.withColumn("_total", F.lit(1 if kind == "estimate" else replicates)).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_total") - 1) / BLOCK))))
    spread = spread.select(*keys, "_total", "_b", "_v").repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys, "_b")
    schema = T.StructType([*[spread.schema[k] for k in keys], T.StructField("rep", T.LongType()), T.StructField("r", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, total_, block, cells in zip(pdf[keys].itertuples(index=False, name=None), pdf["_total"], pdf["_b"], pdf["_v"], strict=True):
                v = np.array([np.asarray(c, float) for c in cells])
                count = int(min(BLOCK, total_ - block * BLOCK))
                draws, n = generator(seed, key, int(block)), len(v)
                found, step = [], max(1, CELLS // max(1, v.size))
                for at in range(0, count, step):
                    some = min(step, count - at)
                    if kind == "estimate":
                        found.append(statistic(v[None]))
                    elif kind == "permutation":
                        mixed = np.repeat(v[None], some, axis=0)
                        mixed[..., -1] = draws.permuted(mixed[..., -1], axis=1)
                        found.append(statistic(mixed))
                    else:
                        found.append(statistic(v[draws.integers(0, n, (some, n))]))
                r = np.concatenate(found) if found else np.zeros(0)
                yield pd.DataFrame({**{k: [x] * len(r) for k, x in zip(keys, key, strict=True)}, "rep": np.arange(len(r)) + int(block) * BLOCK, "r": r})

    return spread.mapInPandas(run, schema)


def _replicated_counts(ok: DataFrame, keys: list[str], values: Sequence[str], statistic: Statistic, kind: str, replicates: int, seed: int) -> DataFrame:
    """``replicated`` of the different rows of each key and their numbers; of leave-one-out values as many rows as the key has."""
    rows = settle(ok.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_w")))
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most > LOCAL_ROWS:
        raise ValueError(f"a key has {most} different rows; beyond {LOCAL_ROWS} use stats.bootstrap, which resamples by shuffles")
    columns = [*values, "_w"]
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_a"))
    arrays = [F.col("_a").getField(v).alias(f"_a{i}") for i, v in enumerate(columns)]
    total = F.size("_a") if kind == "leave one out" else F.lit(1 if kind == "estimate" else replicates)
    spread = packed.withColumn("_total", total).withColumn("_b", F.explode(F.sequence(F.lit(0), F.floor((F.col("_total") - 1) / BLOCK))))
    spread = spread.select(*keys, "_total", "_b", *arrays).repartition(2 * ok.sparkSession.sparkContext.defaultParallelism, *keys, "_b")
    schema = T.StructType([*[spread.schema[k] for k in keys], T.StructField("rep", T.LongType()), T.StructField("r", T.DoubleType())])

    def permuted(v: np.ndarray, w: np.ndarray, count: int, draws: np.random.Generator) -> np.ndarray:
        """The last column dealt anew over the others: tables with the same margins, or row by row where the tables are large."""
        (x, xi), (y, yi) = np.unique(v[:, :-1], axis=0, return_inverse=True), np.unique(v[:, -1], return_inverse=True)
        xi, yi = xi.ravel(), yi.ravel()
        nx, ny = (np.bincount(i, weights=w).astype(np.int64) for i in (xi, yi))
        if len(x) * len(y) <= CELLS // 64:
            cells = np.column_stack([np.repeat(x, len(y), axis=0), np.tile(y, len(x))])
            found, step = [], max(1, CELLS // cells.size)
            for at in range(0, count, step):
                tables = np.zeros((min(step, count - at), len(x), len(y)), np.int64)
                for table in tables:
                    left = ny.copy()
                    for i, n in enumerate(nx[:-1]):
                        table[i] = draws.multivariate_hypergeometric(left, n)
                        left -= table[i]
                    table[-1] = left
                found.append(counted(statistic, cells, tables.reshape(len(tables), -1)))
            return np.concatenate(found)
        fixed, mixed = np.repeat(v[:, :-1], w, axis=0), np.repeat(v[:, -1], w)
        return np.concatenate([statistic(np.column_stack([fixed, draws.permutation(mixed)])[None]) for _ in range(count)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, total_, block, *cells in zip(pdf[keys].itertuples(index=False, name=None), pdf["_total"], pdf["_b"], *[pdf[f"_a{i}"] for i in range(len(columns))], strict=True):
                v, w = np.column_stack([np.asarray(c, float) for c in cells[:-1]]), np.asarray(cells[-1], np.int64)
                first, count, n = int(block) * BLOCK, int(min(BLOCK, total_ - block * BLOCK)), int(w.sum())
                draws, found, step = generator(seed, key, int(block)), [], max(1, CELLS // max(1, v.size))
                for at in range(0, count, step) if kind != "permutation" else ():
                    some = min(step, count - at)
                    if kind == "estimate":
                        found.append(counted(statistic, v, w[None]))
                    elif kind == "bootstrap":
                        found.append(counted(statistic, v, draws.multinomial(n, w / n, some)))
                    elif n > 1:
                        less = np.repeat(w[None], some, axis=0)
                        less[np.arange(some), first + at + np.arange(some)] -= 1
                        found.append(counted(statistic, v, less))
                if kind == "permutation":
                    found.append(permuted(v, w, count, draws))
                r, rep = np.concatenate(found) if found else np.zeros(0), np.arange(first, first + count)
                if kind == "leave one out" and len(r):
                    r, rep = np.repeat(r, w[rep]), np.arange(w[:first].sum(), w[:first + count].sum())
                yield pd.DataFrame({**{k: [x] * len(r) for k, x in zip(keys, key, strict=True)}, "rep": rep[:len(r)], "r": r})

    return spread.mapInPandas(run, schema)


def bca_bounds(estimate: float, reps: np.ndarray, jack: np.ndarray, level: float) -> tuple[float | None, float | None, str]:
    """Interval of sorted finite replicates: bias-corrected and accelerated, or of percentiles where that is undefined."""
    reps, jack = np.sort(reps[np.isfinite(reps)]), jack[np.isfinite(jack)]
    if not len(reps):
        return None, None, "none"
    tails, kind = ((100 - level) / 200, 1 - (100 - level) / 200), "percentile"
    share, d = (reps < estimate).mean(), jack.mean() - jack if len(jack) else np.zeros(0)
    spread = (d**2).sum()
    if 0 < share < 1 and spread > 0:
        z, a = NormalDist().inv_cdf(share), (d**3).sum() / (6 * spread**1.5)
        q = [NormalDist().inv_cdf(t) for t in tails]
        if all(1 - a * (z + x) > 0 for x in q):
            tails, kind = tuple(NormalDist().cdf(z + (z + x) / (1 - a * (z + x))) for x in q), "bca"

    def cut(p: float) -> float:  # midpoint ranks
        k = min(max(p * len(reps) + 0.5, 1), len(reps))
        lo, hi = reps[math.floor(k) - 1], reps[math.ceil(k) - 1]
        return float(lo + (k - math.floor(k)) * (hi - lo))

    return cut(tails[0]), cut(tails[1]), kind


def bca(rows: DataFrame, keys: Sequence[str], values: Sequence[str], statistic: Statistic, replicates: int, seed: int, order: Sequence[str], level: float = 95.0) -> DataFrame:
    """``keys, estimate, ci_lo, ci_hi, interval``: the statistic with its bias-corrected accelerated bootstrap interval."""
    keys = list(keys)
    rows = settle(rows)
    part = lambda kind: replicated(rows, keys, values, statistic, kind, replicates, seed, order).select(*keys, F.lit(kind).alias("_kind"), "r")
    all_ = part("estimate").unionByName(part("bootstrap")).unionByName(part("leave one out"))
    schema = T.StructType([*[all_.schema[k] for k in keys], *[T.StructField(c, T.DoubleType()) for c in ("estimate", "ci_lo", "ci_hi")], T.StructField("interval", T.StringType())])

    def bounds(pdf: pd.DataFrame) -> pd.DataFrame:  # one number a replicate and row of the key
        of = lambda kind: pdf.loc[pdf["_kind"] == kind, "r"].to_numpy(float)
        estimate = of("estimate")[0]
        lo, hi, kind = bca_bounds(estimate, of("bootstrap"), of("leave one out"), level)
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in keys], estimate, lo, hi, kind]], columns=schema.names)

    return all_.groupBy(*keys).applyInPandas(bounds, schema)


def permutation_p(rows: DataFrame, keys: Sequence[str], values: Sequence[str], statistic: Statistic, replicates: int, seed: int, order: Sequence[str]) -> DataFrame:
    """``keys, estimate, p``: two-sided, (hits + 1) / (replicates + 1), hits within 1e-12 of the estimate counted."""
    keys = list(keys)
    rows = settle(rows)
    est = replicated(rows, keys, values, statistic, "estimate", 1, seed, order).select(*keys, F.col("r").alias("estimate"))
    mixed = replicated(rows, keys, values, statistic, "permutation", replicates, seed, order)
    hits = mixed.join(est, keys).groupBy(*keys).agg(F.first("estimate").alias("estimate"), F.count_if(F.abs("r") >= F.abs("estimate") - 1e-12).alias("_k"))
    return hits.select(*keys, "estimate", ((F.col("_k") + 1) / F.lit(replicates + 1)).alias("p"))
