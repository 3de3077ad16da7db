"""Nearest neighbours by largest inner product with a hash-prefix forest.

Vectors are extended by one component to a common length, so that the angle to a query orders them by inner product.
Each tree hashes them to strings of ``BITS`` signs of random projections and keeps the strings as a sorted array; all
vectors that share a prefix with a query are a range of it.  A search descends to the longest prefix that finds
anything, then ascends in all trees together, one bit at a time, until the ranges hold ``SHARE`` times the indexed
vectors (counted once a tree), and on until they hold ``LEAST`` distinct vectors or all there are; the distinct vectors
in them are scored exactly.  So ``k`` neighbours are found wherever there are as many, and all if there are fewer.

The index covers every vector, in shards of about ``SHARD`` dealt by hash, each with its own forest; blocks of the
stated query set meet every shard, and the best of all shards are merged.  Equal vectors are one entry with its
``k + 1`` smallest ids, which is all that ``k`` neighbours can need.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors whose
length is not the commonest (ties: the larger).  Rows that repeat an id and vector count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

TREES, BITS, SHARE, LEAST, SHARD, BLOCK, SEED = 48, 32, 1.6, 256, 8192, 4096, 7


class Forest:
    """Sorted arrays of hash strings of some vectors, one a tree."""

    def __init__(self, vectors: np.ndarray, longest: float, trees: int = TREES):
        rng = np.random.default_rng(SEED)
        self.vectors, self.longest = vectors, longest
        self.planes = rng.standard_normal((trees, vectors.shape[1] + 1, BITS))
        extra = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
        own = np.column_stack([vectors, extra])
        self.order, self.strings = [], []
        for plane in self.planes:
            codes = self._codes(own, plane)
            order = np.argsort(codes, kind="stable")
            self.order.append(order)
            self.strings.append(codes[order])

    @staticmethod
    def _codes(vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
        return ((vectors @ plane > 0) << np.arange(BITS, dtype=np.int64)[::-1]).sum(axis=1)

    def search(self, queries: np.ndarray, k: int, share: float = SHARE, least: int = LEAST):
        """For each query the places and scores of its best ``k`` candidates."""
        n, want = len(self.vectors), max(share * len(self.vectors), k)
        need = min(n, max(least, k))
        codes = np.array([self._codes(np.column_stack([queries, np.zeros(len(queries))]), plane) for plane in self.planes])
        lo, hi = np.zeros(codes.shape, np.int64), np.zeros(codes.shape, np.int64)
        level = np.zeros(len(queries), np.int64)  # bits given up by each query

        def ascend(rows: np.ndarray, shift: int) -> None:
            level[rows] = shift
            for t, (c, s) in enumerate(zip(codes, self.strings, strict=True)):
                prefix = c[rows] >> shift
                lo[t, rows] = np.searchsorted(s, prefix << shift)
                hi[t, rows] = np.searchsorted(s, (prefix + 1) << shift)

        def marked(i: int) -> np.ndarray:
            found = np.zeros(n, bool)
            for t, order in enumerate(self.order):
                found[order[lo[t, i]:hi[t, i]]] = True
            return found

        open_ = np.arange(len(queries))
        for shift in range(BITS + 1):  # all trees ascend together
            ascend(open_, shift)
            open_ = open_[(hi[:, open_] - lo[:, open_]).sum(axis=0) < want]
            if not len(open_):
                break
        for i, q in enumerate(queries):
            found = marked(i)
            while found.sum() < need:  # at the last level every range is the whole array
                ascend(np.array([i]), int(level[i]) + 1)
                found = marked(i)
            at = np.flatnonzero(found)
            scores = self.vectors[at] @ q
            if len(at) > 4 * k:  # keep all that tie with the k-th best
                good = scores >= np.partition(scores, len(at) - k)[len(at) - k]
                at, scores = at[good], scores[good]
            yield at, scores


def usable(column: Column) -> Column:
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(good & F.exists(column, lambda x: x != 0), F.lit(False))


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding",
               trees: int = TREES, share: float = SHARE, shard_rows: int = SHARD, distinct: int = LEAST) -> DataFrame:
    """The ``k`` nearest rows found for every query row: ``query_id, rank, vec_id, score``."""
    rows = vectors.where(usable(F.col(vector)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == size["d"]).withColumn("h", F.md5(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",")))
    few = rows.select("h", "id").distinct().withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1)
    ids = few.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    one = rows.groupBy("h").agg(F.min_by("v", "id").alias("v"), F.max("q").alias("q"))
    classes = written(one.join(ids, "h"), "vectors")
    total, longest = classes.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    shards, blocks = -(-total // shard_rows), max(1, -(-classes.where("q").count() // BLOCK))
    number = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    stored = classes.select("h", "v", F.element_at("ids", 1).alias("least"), F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard"), F.explode(number(blocks)).alias("block"))
    asked = classes.where("q").select("h", "v", F.explode(number(shards)).alias("shard"), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))

    def matrix(table: pa.Table) -> np.ndarray:
        return table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c, s, least = [], [], [], []
        if left.num_rows and right.num_rows:
            names, lows = left.column("h").combine_chunks(), left.column("least").to_numpy()
            forest = Forest(matrix(left), longest, trees)
            for name, (at, scores) in zip(right.column("h").to_pylist(), forest.search(matrix(right), k + 1, share, distinct), strict=True):
                best = np.lexsort((lows[at], -scores))[:k + 1]
                q += [name] * len(best)
                c += names.take(pa.array(at[best])).to_pylist()
                s += scores[best].tolist()
                least += lows[at[best]].tolist()
        return pa.table([pa.array(q, pa.string()), pa.array(c, pa.string()), pa.array(s, pa.float64()), pa.array(least, pa.int64())], ["asked", "h", "score", "least"])

    found = stored.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "asked string, h string, score double, least long")
    by = Window.partitionBy("asked").orderBy(F.desc("score"), "least")
    best = found.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)
    lists = best.join(classes.select("h", "ids"), "h").groupBy("asked").agg(F.flatten(F.collect_list(
        F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id"))))).alias("near"))
    lists = written(lists.withColumn("near", F.slice(F.array_sort("near"), 1, k + 1)), "nearest")
    own = rows.where("q").select(F.col("id").alias("query_id"), F.col("h").alias("asked")).distinct().join(lists, "asked")
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(near).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
