"""Every registered query equals its DuckDB oracle (order-insensitive)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from souk.plans import load_all
from souk.sources.views import SOURCE_TABLES
from tools.check_oracle import table_hash

SF = "/root/testdata/sf0.001"
QS, ORC = E.queries(), E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_every_core_query_has_an_oracle():
    """Core keys come from the plans; whatever else is registered may lack SQL."""
    core_q, core_o = load_all()
    assert set(core_q) == set(core_o)
    assert set(ORC) <= set(QS)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 30
    assert df.columns[0] == "date"


@pytest.mark.parametrize("key", sorted(ORC))
def test_query_matches_oracle(spark, duck, key):
    df = QS[key](spark, SF)
    rows, cols = df.collect(), df.columns
    cur = duck.execute(ORC[key])
    drows, dcols = cur.fetchall(), [c[0] for c in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    pos = [dcols.index(c) for c in cols]
    assert table_hash(cols, rows)[0] == table_hash(cols, [[r[i] for i in pos] for r in drows])[0]
