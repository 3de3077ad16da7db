"""Text, label, unit and file-name rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: unit spelling after lower/trim and micro sign -> factor to microvolts
UNIT_SCALES = {"uv": 1.0, "microv": 1.0, "mv": 1000.0, "v": 1000000.0}

# fixed values: comment spellings -> the four categories
COMMENT_SYNONYMS = {
    "iids": "IIDs", "iid": "IIDs",
    "disconnect": "disconnect", "disconnected": "disconnect", "disconnection": "disconnect",
    "grooming": "grooming/scratching", "scratching": "grooming/scratching", "grooming/scratching": "grooming/scratching",
    "grooming / scratching": "grooming/scratching", "grooming-scratching": "grooming/scratching", "scratching/grooming": "grooming/scratching",
    "other": "other", "others": "other",
}


def unit_scale(unit: Column, scales: Mapping[str, float] = UNIT_SCALES) -> tuple[Column, Column]:
    """(factor to microvolts, recognised); both micro signs count as u, unknown units stay unscaled."""
    key = F.translate(F.lower(F.trim(unit)), "µμ", "uu")
    table = F.create_map(*[x for k, v in scales.items() for x in (F.lit(k), F.lit(v))])
    hit = F.element_at(table, key)
    return F.coalesce(hit, F.lit(1.0)), hit.isNotNull()


def subject_id(name: Column, default: str = "unknown_subject") -> Column:
    clean = F.regexp_replace(F.trim(name), "[^A-Za-z0-9_-]", "_")
    return F.when(F.length(clean) == 0, default).otherwise(clean)


def channel_key(label: Column) -> Column:
    """Label without the 'EEG ' prefix and spaces, upper case: the fallback match of channel selection."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(label), "(?i)^EEG ", ""), " ", ""))


def file_parts(path: Column) -> Column:
    """``id_yyyyMMdd_hhmmss_region[_partN]`` -> struct(subject_id, start, region, part)."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    pat = r"^(.+)_(\d{8}_\d{6})_([A-Za-z0-9-]+?)(?:_part(\d+))?$"
    part = lambda i: F.nullif(F.regexp_extract(name, pat, i), F.lit(""))
    return F.struct(part(1).alias("subject_id"), F.try_to_timestamp(part(2), F.lit("yyyyMMdd_HHmmss")).alias("start"),
                    part(3).alias("region"), part(4).cast("int").alias("part"))


def label(text: Column) -> tuple[Column, Column]:
    """(TP, FP or '', recognised) of a reviewer's label."""
    t = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("TP", "FP"), t).otherwise(""), t.isin("TP", "FP", "")


def comment(text: Column, synonyms: Mapping[str, str] = COMMENT_SYNONYMS) -> Column:
    """Comment category by synonym, '' when blank, otherwise ``unrecognized:<text>``."""
    t = F.trim(F.coalesce(text, F.lit("")))
    table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
    return F.when(t == "", "").otherwise(F.coalesce(F.element_at(table, F.lower(t)), F.concat(F.lit("unrecognized:"), t)))


def exclusion_rule(comments: Column) -> tuple[Column, Column]:
    """(rule, mixed) of a false positive's comment set joined by ';'."""
    parts = F.filter(F.split(F.coalesce(comments, F.lit("")), ";"), lambda p: p != "")
    has = lambda v: F.array_contains(parts, v)
    odd = F.exists(parts, lambda p: p.startswith("unrecognized:"))
    rule = (F.when((F.size(parts) == 0) | odd, "R6").when(F.forall(parts, lambda p: p == "IIDs"), "R2").when(has("disconnect"), "R5")
             .when(has("grooming/scratching"), "R3").when(has("other"), "R4").otherwise("R6"))
    return rule, has("IIDs") & F.exists(parts, lambda p: p != "IIDs")


def hemisphere(region: Column, right: Sequence[str], left: Sequence[str]) -> Column:
    r = F.lower(F.trim(region))
    return F.when(r.isin(*[x.lower() for x in right]), "right").when(r.isin(*[x.lower() for x in left]), "left").otherwise("unknown")


def review_priority(category: Column) -> Column:
    return F.when(category == "Candidates", 1).when(category == "Candidates_in_band", 2).when(category == "Crisis", 3)


def band_status(score: Column, accept: float, reject: float) -> Column:
    return F.when(score >= accept, "accepted").when(score >= reject, "in_band").otherwise("rejected")


def header_value(headers: Column, key: str, kind: str = "string", default=None) -> Column:
    """Typed header field with a default when missing or unreadable."""
    raw = F.element_at(headers, key)
    value = raw if kind == "string" else raw.try_cast(kind)
    return F.coalesce(value, F.lit(default).cast(kind))
