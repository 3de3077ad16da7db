"""Queries against their SQL on events without length and on repeated rows."""
import math

import duckdb
import pytest

from tidemark.catalog import ENTRIES

EVENTS = "/root/testdata/sf0.001/events.parquet"


def norm(rows):
    return sorted(repr(tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)


def both(spark, folder, events, name):
    """Rows of a query and of its SQL over the events that a SQL text selects."""
    db = duckdb.connect()
    db.execute(f"COPY ({events}) TO '{folder}/events.parquet'")
    db.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    rel = db.execute(ENTRIES[name].sql)
    columns = [d[0] for d in rel.description]
    return norm(ENTRIES[name].run(spark, str(folder)).select(columns).collect()), norm(rel.fetchall())


def made(*rows):
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-01 {t}', 1::BIGINT, '{k}', {v}::DOUBLE, '{{}}')" for i, t, k, v in rows) + \
        ") AS v(event_id, ts, user_id, event_type, value, props)"


def test_segments_without_length(spark, tmp_path):
    got, want = both(spark, tmp_path, made((1, "01:00:00", "click", 0), (2, "00:30:00", "view", 60), (3, "02:00:00", "click", 10)), "flat_segment_report")
    assert got == want and len(got) == 2


def test_missed_events_without_length(spark, tmp_path):
    rows = [(1, "01:00:00", "click", 60), (2, "01:30:00", "purchase", 0), (3, "02:00:00", "purchase", 0), (4, "03:00:00", "purchase", 30),
            (5, "03:10:00", "click", 0), (6, "04:00:00", "purchase", 5), (7, "04:00:00", "click", 0), (8, "05:00:00", "click", 0), (9, "05:00:00", "purchase", 0)]
    got, want = both(spark, tmp_path, made(*rows), "final_events")
    assert got == want and len(got) == 4 + 3  # 2 lies inside 1, and 5 inside 4


@pytest.mark.parametrize("name", ["rule_summary", "channel_plan", "scope_asymmetry"])
def test_repeated_zones(spark, tmp_path, name):
    got, want = both(spark, tmp_path, f"SELECT * REPLACE (event_id + 100000 * r AS event_id) FROM '{EVENTS}', (SELECT unnest(range(40)) AS r)", name)
    assert got == want and got


def test_sides_without_length(spark, tmp_path):
    rows = [(2, "01:00:00", "click", 0), (4, "02:00:00", "view", 10), (1, "03:00:00", "view", 0), (3, "04:00:00", "click", 5), (5, "04:30:00", "click", 0)]
    got, want = both(spark, tmp_path, made(*rows), "scope_asymmetry")
    assert got == want and len(got) == 3
    assert sum("inf" in r and "nan" in r for r in got) == 2  # one side of each campaign has no time, all together both have some
