import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    expected = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, expected))


def test_pipeline_stages_keep_the_columns_and_all_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", None, "s", 0), (None, "the and of that is in to " * 9, None, None, None),
                                 (10_003, 'password = "hunter2hunter2" and the rest of it is ofthe thing', "en", "s", 1),
                                 (10_003, 'password = "hunter2hunter2" and the rest of it is ofthe thing', "en", "s", 1)], docs.schema)
    current, before = docs.union(odd), None
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, SF)
        if k < 4:
            assert out.columns == docs.columns
            out = spark.createDataFrame(out.collect(), docs.schema)
            rows = out.collect()
            if k == 0:
                assert {10_001, 10_002}.isdisjoint(r.doc_id for r in rows) and len(rows) >= docs.where("length(text) > 0").count()
            if k == 1:
                assert sum(r.doc_id == 10_003 for r in rows) == 1 and any(r.doc_id is None for r in rows)
            if k == 3:
                assert not any("hunter2hunter2" in r.text for r in rows) and len(rows) == before
            before = len(rows)
        current = out
    assert current.select("doc_id").distinct().count() > 0.7 * docs.count()
