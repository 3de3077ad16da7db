"""Nested values as rows of dotted paths, and the paths in which two of them differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def leaves(value: Column, kind: T.DataType, path: Column) -> Column:
    """Array of ``(path, value)`` of all leaves: fields by name, map entries by key, array elements by place from 1.

    Empty containers and missing ones are leaves of their own (``{}``, ``[]``, NULL), so that they differ from absent paths.
    """
    one = lambda text: F.array(F.struct(path.alias("path"), text.cast("string").alias("value")))
    below = lambda name: F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), name)
    if isinstance(kind, T.StructType):
        inner = F.concat(*[leaves(value[f.name], f.dataType, below(F.lit(f.name))) for f in kind.fields]) if kind.fields else one(F.lit("{}"))
    elif isinstance(kind, T.MapType):
        entries = F.flatten(F.transform(F.map_entries(value), lambda e: leaves(e["value"], kind.valueType, below(e["key"].cast("string")))))
        inner = F.when(F.size(value) == 0, one(F.lit("{}"))).otherwise(entries)
    elif isinstance(kind, T.ArrayType):
        parts = F.flatten(F.transform(value, lambda x, i: leaves(x, kind.elementType, below((i + 1).cast("string")))))
        inner = F.when(F.size(value) == 0, one(F.lit("[]"))).otherwise(parts)
    else:
        return one(value)
    return F.when(value.isNull(), one(F.lit(None))).otherwise(inner)


def flattened(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, path, value``: every leaf of the other columns of every row."""
    rest = [f for f in df.schema.fields if f.name not in keys]
    every = F.concat(*[leaves(F.col(f.name), f.dataType, F.lit(f.name)) for f in rest])
    return df.select(*keys, F.inline(every))


def path_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """``keys, path, before, after, change``: paths whose values differ, or that only one side has; ``ignore``: paths left out with all below them."""
    keys = list(keys)
    left = flattened(a, keys).select(*keys, "path", F.struct(F.col("value").alias("v")).alias("_a"))
    right = flattened(b, keys).select(*keys, "path", F.struct(F.col("value").alias("v")).alias("_b"))
    met = left.join(right, [*keys, "path"], "full")
    for p in ignore:
        met = met.where((F.col("path") != p) & ~F.col("path").startswith(f"{p}."))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return met.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys, "path", F.col("_a.v").alias("before"), F.col("_b.v").alias("after"), change.alias("change"))


def finite(c: Column) -> Column:
    """NULL for numbers that JSON cannot hold."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def jsonify(df: DataFrame, columns: Sequence[str], out: str = "json") -> DataFrame:
    """``df`` with ``columns`` of each row as one JSON object; numbers that are not finite become null, times ISO text."""
    number = lambda f: finite(F.col(f)).alias(f) if isinstance(df.schema[f].dataType, (T.DoubleType, T.FloatType)) else F.col(f)
    form = "yyyy-MM-dd'T'HH:mm:ss"
    return df.withColumn(out, F.to_json(F.struct(*[number(c) for c in columns]), {"timestampNTZFormat": form, "timestampFormat": form, "ignoreNullFields": "false"}))
