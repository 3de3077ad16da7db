"""Secret scans with DataFrame expressions only.

Base rules are regular expressions whose matches are located by ``\\G``-anchored extraction: each extracted piece is
the gap plus the match, so running lengths are the positions.  The method adds spans of high Shannon entropy: over
every candidate string of a character class a window slides one character at a time, and its entropy is kept up to
date from incremental counts (``H = log2 w - sum n log2 n / w``, of which only the terms of the character that
leaves and the one that enters change).  Candidates on the allow-list and spans that touch a base span are left out.

Null and empty texts have no spans; null ids and repeated rows are kept as they are.  Positions are code points,
ends exclusive.  Columns of the input that clash with the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern; with ``value``, its one group is the secret. Matches with fewer than ``least`` characters are dropped."""
    kind: str
    pattern: str
    least: int
    value: bool = False


@dataclass(frozen=True)
class CharClass:
    """Strings of ``alphabet`` with a digit and a letter, at least one window long."""
    kind: str
    alphabet: str
    pattern: str
    window: int
    threshold: float


# The base rules of the scan.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# The same matches for the two maximal runs with the length bound in the pattern, so that short runs are never listed.
_SEARCH = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
# Alphabets, windows and thresholds (bits; off any value that counts can give exactly).
CLASSES = (
    CharClass("entropy_hex", "0123456789abcdef", "[0-9a-f]", 20, 3.0007),
    CharClass("entropy_b64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "[A-Za-z0-9+/_-]", 24, 4.0007),
)
# Candidates that contain one of these (any case) or are a UUID are no secrets.
ALLOWED = ("example", "sample", "dummy", "placeholder", "changeme", "redacted", "abcdefgh", "01234567")
UUID = r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
#: Windows that are folded in one go.
STRETCH = 256
SPANS = "array<struct<start:int,end:int,rank:int,kind:string>>"


def _append(items: Column, one: Column) -> Column:
    return F.concat(items, F.array(one))


def _located(text: Column, pattern: str, value: bool, hint: str = "") -> Column:
    """``(start, end, match, value)`` of every leftmost non-overlapping match."""
    regex = F.lit(rf"\G[\s\S]*?({pattern})")
    piece = F.arrays_zip(F.regexp_extract_all(text, regex, 0).alias("piece"), F.regexp_extract_all(text, regex, 1).alias("match"),
                         F.regexp_extract_all(text, regex, 2 if value else 1).alias("value"))
    kind = "array<struct<start:int,end:int,match:string,value:string>>"

    def step(acc, x):
        end = acc["pos"] + F.length(x["piece"])
        found = F.struct((end - F.length(x["match"])).alias("start"), end.alias("end"), x["match"].alias("match"), x["value"].alias("value"))
        return F.struct(end.alias("pos"), _append(acc["out"], found).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(kind).alias("out"))
    spans = F.aggregate(piece, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(hint or pattern), spans).otherwise(F.array().cast(kind))


def base_spans(text: Column, rule: Rule, rank: int) -> Column:
    """Spans of one base rule; matches that are too short are dropped after matching."""
    long_enough = F.filter(_located(text, _SEARCH.get(rule.kind, rule.pattern), rule.value), lambda x: F.length(x["value"]) >= rule.least)
    return F.transform(long_enough, lambda x: F.struct(x["start"], x["end"], F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"))).cast(SPANS)


def _term(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _word(place: Column) -> Column:
    return F.shiftright(place, 3)


def _shift(place: Column) -> Column:
    return F.shiftleft(place.bitwiseAND(F.lit(7)), 3)


def _stretch(places: Column, first: Column, last: Column, cls: CharClass) -> Column:
    """Unions of hot windows among those that end at characters ``first`` to ``last`` (from 1) of a candidate, in order."""
    w, width = cls.window, len(cls.alphabet)
    least_sum = float(w) * (F.log2(F.lit(float(w))) - F.lit(cls.threshold))  # entropy >= threshold <=> sum <= this
    kind = "array<struct<start:int,end:int>>"

    def count(counts, place):
        """Count of the character at a place: eight counts share a number."""
        return F.call_function("shiftright", F.get(counts, _word(place)), _shift(place)).bitwiseAND(F.lit(255)).cast("int")

    def step(acc, i):
        enters = F.element_at(places, i) - 1
        leaves = F.when(i > first, F.element_at(places, i - w) - 1).otherwise(F.lit(-1))
        gained = count(acc["counts"], enters)
        lost = F.when(leaves >= 0, count(acc["counts"], leaves)).otherwise(F.lit(0))
        same = enters == leaves
        total = F.when(same, acc["total"]).otherwise(
            acc["total"] + _term(gained + 1) - _term(gained) - _term(lost) + _term(F.greatest(lost - 1, F.lit(0))))
        one = lambda place: F.call_function("shiftleft", F.lit(1).cast("long"), _shift(place))
        counts = F.when(same, acc["counts"]).otherwise(F.transform(
            acc["counts"], lambda n, k: n + F.when(k == _word(enters), one(enters)).otherwise(F.lit(0)) - F.when((leaves >= 0) & (k == _word(leaves)), one(leaves)).otherwise(F.lit(0))))
        hot = (i >= first) & (total <= least_sum)
        last_ = F.try_element_at(acc["out"], F.lit(-1))
        joins = hot & (F.coalesce(last_["end"], F.lit(-1)) >= i - w)
        out = (F.when(joins, _append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), F.struct(last_["start"].alias("start"), i.alias("end"))))
                .when(hot, _append(acc["out"], F.struct((i - w).alias("start"), i.alias("end")))).otherwise(acc["out"]))
        return F.struct(counts.alias("counts"), total.alias("total"), out.cast(kind).alias("out"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), (width + 7) // 8).alias("counts"), F.lit(0.0).alias("total"), F.array().cast(kind).alias("out"))
    return F.aggregate(F.sequence(first - w + 1, last), start, step, lambda acc: acc["out"])


def _joined(spans: Column) -> Column:
    """Spans in order, those that meet or overlap the one before made one with it."""
    gap = lambda i: F.get(spans, i)["start"] > F.get(spans, i - 1)["end"]
    edge = lambda name, opens: F.transform(F.filter(F.transform(spans, lambda x, i: F.when(opens(i), x[name])), lambda x: x.isNotNull()), lambda x: x)
    starts = edge("start", lambda i: (i == 0) | gap(i))
    ends = edge("end", lambda i: (i == F.size(spans) - 1) | gap(i + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def _windows(candidate: Column, cls: CharClass) -> Column:
    """``(start, end)`` within the candidate of the maximal unions of windows whose entropy reaches the threshold.

    The candidate is split into its characters' places once; windows are folded in stretches of ``STRETCH``, so the work grows with the
    candidate's length however long it is.
    """
    w = cls.window
    index = lambda c: F.call_function("instr", F.lit(cls.alphabet), c)

    def over(places):
        firsts = F.sequence(F.lit(w), F.size(places), F.lit(STRETCH))
        parts = F.transform(firsts, lambda first: _stretch(places, first, F.least(first + STRETCH - 1, F.size(places)), cls))
        return _bound(F.flatten(parts), _joined)

    return _bound(F.transform(F.split(candidate, ""), index), over)


def entropy_spans(text: Column, cls: CharClass, rank: int) -> Column:
    """Spans of one character class whose sliding entropy reaches the threshold, allow-listed candidates left out."""
    pattern = f"{cls.pattern}{{{cls.window},}}"
    found = F.filter(_located(text, pattern, False, f"(?<!{cls.pattern}){cls.pattern}{{{cls.window}}}"), lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]"))
    allowed = lambda m: reduce(lambda a, b: a | b, [F.lower(m).contains(a) for a in ALLOWED]) | m.rlike(UUID)
    found = F.filter(found, lambda x: ~allowed(x["match"]))
    return F.flatten(F.transform(found, lambda x: F.transform(_windows(x["match"], cls), lambda y: F.struct(
        (x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), F.lit(rank).alias("rank"),
        F.lit(cls.kind).alias("kind"))))).cast(SPANS)


def secret_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of ``(start, end, rank, kind)`` by start, then kind as listed."""
    source = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("base", F.array_sort(F.concat(*[base_spans(source, r, k) for k, r in enumerate(BASE)])))
    docs = docs.withColumn("added", F.concat(*[entropy_spans(source, c, len(BASE) + k) for k, c in enumerate(CLASSES)]))
    touches = lambda x: F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return docs.withColumn("added", F.array_sort(F.filter(F.col("added"), lambda x: ~touches(x))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with every span (sorted by start; they may overlap) replaced by ``mask``."""
    def step(acc, x):
        gap = F.substring(text, acc["pos"] + 1, F.greatest(x["start"] - acc["pos"], F.lit(0)))
        new = x["start"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], x["end"]).alias("pos"),
                        F.concat(acc["out"], gap, F.when(new, F.lit(mask)).otherwise(F.lit(""))).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text)))))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with base and added spans of ``text`` masked; same columns, texts without spans unchanged."""
    found = secret_spans(docs.select(F.struct("*").alias("row"), F.col(text).alias("text_")), "text_")
    spans = F.array_sort(F.concat("base", "added"))
    clean = found.withColumn("text_", masked(F.col("text_"), spans, mask))
    return clean.select(*[F.col("text_").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
