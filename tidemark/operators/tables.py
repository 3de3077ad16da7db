"""Table algebra over runs: schema-evolving unions, replacement, differences, audits, checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_runs(parts: Sequence[DataFrame], defaults: Mapping[str, object] | None = None,
               modes: Sequence[str] = ()) -> DataFrame:
    """Union by name with missing columns backfilled from ``defaults``.

    Type clashes fall back to text for the clashing columns.  ``modes`` are marker columns: parts that
    disagree about having one belong to incompatible modes and are refused.
    """
    for m in modes:
        if len({m in p.columns for p in parts}) > 1:
            raise ValueError(f"runs disagree on column {m!r}: incompatible modes")
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for name, kind in p.dtypes:
            kinds.setdefault(name, set()).add(kind)
    clash = [c for c, k in kinds.items() if len(k) > 1]
    out = None
    for p in parts:
        p = p.withColumns({c: F.col(c).cast("string") for c in clash if c in p.columns})
        p = p.withColumns({c: F.lit(v) for c, v in (defaults or {}).items() if c not in p.columns and c in kinds})
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def fill_like(df: DataFrame, model: DataFrame) -> DataFrame:
    """Lay rows out under another table's schema: missing text becomes '', other missing columns NULL."""
    cols = []
    for name, kind in model.dtypes:
        if name in df.columns:
            cols.append(F.col(name).cast(kind).alias(name))
        else:
            cols.append(F.lit("" if kind == "string" else None).cast(kind).alias(name))
    return df.select(*cols)


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], replaced: DataFrame | None = None) -> DataFrame:
    """Old rows of the replaced keys give way to the new rows; all other rows stay as they are."""
    gone = (replaced if replaced is not None else new).select(*keys).distinct()
    return old.join(gone, list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def row_diff(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: same, changed (with the names of the differing columns), only_a or only_b."""
    body = [c for c in a.columns if c not in keys and c in b.columns]
    l = a.select(*keys, F.struct(*body).alias("_a"))
    r = b.select(*keys, F.struct(*body).alias("_b"))
    both = l.join(r, list(keys), "full")
    diffs = F.array_join(F.array_compact(F.array(*[
        F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in body])), ",")
    status = (F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a")
               .when(diffs == "", "same").otherwise("changed"))
    return both.select(*keys, status.alias("status"), F.when(status == "changed", diffs).otherwise("").alias("columns"))


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one table but not the other, counting repeats: ``side`` and the row; empty when equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def set_signature(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free signature of a key's rows: count and two independent sums of row hashes.

    Equal multisets give equal signatures; the sums combine map-side, so nothing is collected.
    """
    big = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    agg = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), big(1).alias("_a"), big(2).alias("_b"))
    return agg.select(*keys, "n", F.sha2(F.concat_ws("|", "n", "_a", "_b"), 256).alias("signature"))


def reuse_plan(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reuse an earlier result iff its signature and code version equal the wanted ones; else the reason."""
    d = done.select(*keys, F.col("signature").alias("_s"), F.col("code_version").alias("_v"))
    out = wanted.join(d, list(keys), "left")
    why = (F.when(F.col("_s").isNull(), "new").when(F.col("_s") != F.col("signature"), "inputs changed")
            .when(F.col("_v") != F.col("code_version"), "code changed").otherwise("reuse"))
    return out.withColumn("decision", why).drop("_s", "_v")


def long_form(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every non-key column as ``(keys, name, value)`` text rows."""
    body = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("string").alias(c) for c in body]).unpivot(list(keys), body, "name", "value")


def key_figures(a: DataFrame, b: DataFrame, keys: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """Named figures of two runs that differ: text exactly, numbers beyond a relative tolerance."""
    l = long_form(a, keys).withColumnRenamed("value", "a")
    r = long_form(b, keys).withColumnRenamed("value", "b")
    both = l.join(r, [*keys, "name"], "full")
    x, y = F.expr("try_cast(a AS double)"), F.expr("try_cast(b AS double)")
    near = F.abs(x - y) <= F.lit(tol) * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return both.where(~(F.col("a").eqNullSafe(F.col("b")) | F.coalesce(near, F.lit(False))))


def checks(items: Sequence[tuple[str, DataFrame, bool]]) -> DataFrame:
    """Named checks from their violation rows: ``(name, n_bad, passes, stop)``."""
    out = None
    for name, bad, stop in items:
        n = bad.agg(F.count(F.lit(1)).alias("n_bad"))
        part = n.select(F.lit(name).alias("name"), "n_bad", (F.col("n_bad") == 0).alias("passes"),
                        (F.lit(stop) & (F.col("n_bad") > 0)).alias("stop"))
        out = part if out is None else out.unionByName(part)
    return out


def decided(flags: DataFrame, decisions: DataFrame, topic: str, detail: str) -> DataFrame:
    """Attach to every flag the decision recorded for its topic and the longest prefix of its detail; 'open' without one."""
    d = decisions.select(F.col(topic), F.col("prefix"), F.col("decision"), F.length("prefix").alias("_n"))
    lengths = [r["_n"] for r in d.select("_n").where("_n IS NOT NULL").distinct().collect()]  # as many as prefix lengths
    rows = flags.select(F.struct("*").alias("_row"), F.col(topic), F.col(detail).alias("_detail")).withColumn("_rid", F.monotonically_increasing_id())
    tries = rows.withColumn("_n", F.explode_outer(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"))).withColumn("prefix", F.substring("_detail", F.lit(1), F.col("_n")))
    hit = tries.join(d, [topic, "_n", "prefix"], "left")
    best = hit.groupBy("_rid").agg(F.first("_row").alias("_row"), F.max_by("decision", F.when(F.col("decision").isNotNull(), F.col("_n"))).alias("decision"))
    return best.select("_row.*", F.coalesce("decision", F.lit("open")).alias("decision"))
