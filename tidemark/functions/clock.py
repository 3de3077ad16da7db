"""Instants, local clocks and sample indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_FORMAT = "dd-MMM-yyyy HH:mm:ss.SSS"
REVIEW_FORMAT = "dd/MM/yyyy HH:mm:ss"
TRUTH_FORMAT = "yyyy-MM-dd HH:mm:ss"
HEADER_FORMAT = "dd.MM.yy HH.mm.ss"


def at_offset(start: Column, seconds: Column) -> Column:
    """Instant ``seconds`` after ``start`` (microsecond resolution)."""
    return F.timestamp_micros(F.unix_micros(start) + F.round(seconds * 1e6).cast("bigint"))


def posix(instant: Column) -> Column:
    return F.unix_micros(instant) / F.lit(1e6)


def local_text(instant: Column, tz: str, fmt: str = TRUTH_FORMAT) -> Column:
    return F.date_format(F.from_utc_timestamp(instant, tz), fmt)


def review_text(instant: Column) -> Column:
    """Review sheet clock: seconds truncated, blank when missing."""
    return F.coalesce(F.date_format(F.date_trunc("second", instant), REVIEW_FORMAT), F.lit(""))


def parse_local(text: Column, tz: str, fmt: str = TRUTH_FORMAT) -> Column:
    """Local wall-clock text -> instant; NULL when unreadable."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(text), F.lit(fmt)), tz)


def minute_of_day(instant: Column, tz: str) -> Column:
    t = F.from_utc_timestamp(instant, tz)
    return F.hour(t) * 60 + F.minute(t) + F.second(t) / 60


def local_date(instant: Column, tz: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, tz))


def sample_index(seconds: Column, fs: Column) -> Column:
    """1-based sample nearest to a time."""
    return (F.round(seconds * fs) + 1).cast("long")


def first_sample(seconds: Column, fs: Column) -> Column:
    """1-based first sample at or after a time."""
    return (F.ceil(seconds * fs) + 1).cast("long")
