"""Driver contract: every registered query runs at sf0.001 with its oracle present."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from paylens.plans import parity

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "Total_USD" in df.columns


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_queries_match_oracle_at_smallest_scale(spark):
    from tools.compare import digest

    con = duckdb.connect()
    for t in ("orders", "pages", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    orc = E.oracle_sql()
    assert set(orc) >= set(parity.QUERIES) and set(E.queries()) >= set(parity.QUERIES)
    for name, fn in parity.QUERIES.items():
        df = fn(spark, SF)
        rows = [tuple(r) for r in df.collect()]
        res = con.sql(orc[name])
        assert sorted(df.columns) == sorted(res.columns), name
        assert digest(df.columns, rows)[0] == digest(res.columns, res.fetchall())[0], name
