"""The driver's contract: names, schemas and a few queries against their oracles."""

import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 75


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["tokenize", "bm25_topk", "rerank_order", "merge_pages", "metric_summary", "index_diff"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "labels", "conversations", "pages", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    rows = entry.queries()[name](spark, FOLDER)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(rows.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in rows.columns]
    assert sorted(repr(tuple(r)) for r in rows.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0
