"""Oracle queries of the training-data operators on the smallest tables."""

import os

import pytest

from millrace.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    rows = registry.QUERIES[name](spark, FOLDER)
    want = con.sql(registry.ORACLES[name])
    assert sorted(rows.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in rows.columns]
    assert sorted(repr(tuple(r)) for r in rows.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
def test_some_hosts_are_rejected(spark):
    rows = registry.QUERIES["host_verdicts_of_pages"](spark, "/root/testdata/sf0.01").collect()
    assert any(not r.kept and not r.base_failed for r in rows) and any(r.kept for r in rows)
