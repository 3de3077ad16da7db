"""Filter interaction audit by failing-id relations.

One id table per filter holds the rows that fail it.  Left-semi joins with the tables give each filter's candidates,
left-anti joins take a prefix's failing rows out of them: what is left are the survivors of the prefix (candidates: all
rows) and what the filter removes right after it (candidates: its failing rows).  What a filter removes depends on the
*set* of filters before it, so ``2 ** k`` prefixes answer all ``k!`` orders.  A prefix is a set of bits in a column; each
anti join takes one table and meets all prefixes at once, so ``k`` semi and ``k`` anti joins on the row key do the audit.

Texts are read once, for the id tables.  Null texts are empty, null parts the empty string.  Rows are told apart by a written
row key, so repeated and null ids are audited row by row; of rows with equal text all but those with the smallest id fail the
repeat filter (null ids count as largest and do not repeat each other).  Rows of an id without labels lose none; an id that is
labelled more than once has a label if any of its rows says so.  An empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import wide, written

WORD = r"([^\x20\x09-\x0D]+)"


def text_conditions(text: str) -> dict[str, Column]:
    """Failure conditions on whole texts: few words, few distinct words, many capitals, symbols."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(1))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(t, F.lit("[A-Z]")) > 2 * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def failing_ids(docs: DataFrame, conditions: Mapping[str, Column], repeats: str | None = None, *, id_column: str = "doc_id",
                part: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``rows (row, id, part)`` and ``failing (row, filter)``, both written; ``failing`` has one folder, that is one table, per filter.

    ``conditions``: filters by name, true where a row fails; ``repeats``: the name of the filter of repeated texts.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    fails = F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()])
    measured = written(wide(docs).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.filter(fails, lambda x: x.isNotNull()).alias("fails"), *([digest.alias("digest")] if repeats else [])), "measured")
    failing = measured.select("row", F.explode("fails").alias("filter"))
    if repeats:
        # The first id of each text, pre-aggregated where the rows are; every row that holds no first id repeats it.
        first = measured.groupBy("digest").agg(F.min("id").alias("first_id"))
        again = measured.join(first, (measured["digest"] == first["digest"]) & measured["id"].eqNullSafe(first["first_id"]), "left_anti")
        failing = failing.unionByName(again.select("row", F.lit(repeats).alias("filter")))
    return measured.select("row", "id", "part"), written(failing, "failing", by="filter")


def prefixes(rows: DataFrame, failing: DataFrame, names: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Counts by ``part, filter, prefix``: rows left by the prefix (``filter`` 0) or removed by the filter (its bit) right after it.

    ``names``: one character a filter; ``prefix``: sum of the bits of the filters before.  ``flags``: 0/1 columns of ``rows`` to be summed.
    """
    base = rows.select("row", "part", *flags)
    table = {name: failing.where(F.col("filter") == name).select(F.col("row").alias("failed")) for name in names}
    left = base.withColumn("filter", F.lit(0))
    for k, name in enumerate(names):
        its = base.join(table[name], base["row"] == table[name]["failed"], "left_semi")
        left = left.unionByName(its.withColumn("filter", F.lit(1 << k)))
    left = left.withColumn("prefix", F.lit(0))
    for k, name in enumerate(names):
        bit = 1 << k
        with_it = F.when(F.col("filter") == bit, F.array("prefix")).otherwise(F.array(F.col("prefix"), F.col("prefix") + bit))
        left = left.withColumn("prefix", F.explode(with_it))
        left = left.join(table[name], (left["row"] == table[name]["failed"]) & (left["prefix"].bitwiseAND(bit) > 0), "left_anti")
    return left.groupBy("part", "filter", "prefix").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in flags])


def audit(counts: DataFrame, names: str, flags: tuple[str, ...] = ()) -> DataFrame:
    """Every part, order of all filters and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, a ``<flag>_lost`` each, ``shapley``.

    ``shapley`` sums what the filter removes over all orders.  A part meets its at most ``(k + 2) * 2 ** (k - 1)`` counts in one row.
    """
    k, full = len(names), (1 << len(names)) - 1
    weights = F.array(*[F.lit(math.factorial(s) * math.factorial(k - 1 - s)) for s in range(k)], F.lit(0))
    share = F.when(F.col("filter") > 0, F.col("n") * F.get(weights, F.bit_count("prefix"))).otherwise(F.lit(0)).cast("long")
    entry = F.struct((F.col("filter") * (full + 1) + F.col("prefix")).alias("key"), F.struct("n", *flags).alias("value"))
    shares = F.struct("filter", share.alias("share"))
    parts = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("at"), F.collect_list(shares).alias("shares"))
    orders = F.array(*[F.lit("".join(o)) for o in itertools.permutations(names)])
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.call_function("instr", F.lit(names), letter) - 1)
    earlier = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit(x))
    steps = steps.withColumns({"own": bit(F.substring("filter_order", F.col("step"), F.lit(1))), "before": earlier})
    look = lambda f, prefix, field="n": F.coalesce(F.try_element_at(F.col("at"), f * (full + 1) + prefix)[field], F.lit(0).cast("long"))
    own, before = F.col("own"), F.col("before")
    return steps.select(
        "part", "filter_order", "step", look(F.lit(0), before + own).alias("kept"), look(own, before).alias("removed"),
        (look(own, F.lit(0)) - look(own, before)).alias("redundant"), look(own, full - own).alias("unique_fails"),
        *[look(own, before, c).alias(f"{c}_lost") for c in flags],
        F.aggregate(F.filter("shares", lambda x: x["filter"] == own), F.lit(0).cast("long"), lambda a, x: a + x["share"]).alias("shapley"))


def labelled(rows: DataFrame, labels: DataFrame, flags: Mapping[str, Column], id_column: str = "doc_id") -> DataFrame:
    """``rows`` with a 0/1 column per flag, a condition on ``labels``."""
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("labelled_id")).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(n) for n, c in flags.items()])
    joined = rows.join(known, rows["id"] == known["labelled_id"], "left")
    return joined.select("row", "part", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in flags])
