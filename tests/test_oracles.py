"""Every SQL-expressible query equals its DuckDB oracle on the same parquet tables."""

import pytest

import __spark_entry__ as entry
from support import SF_SMALL
from tools.check_oracles import digest

ORACLES = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}  # tests/llm has the others


@pytest.fixture(scope="module")
def con(duck):
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLES[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert digest(sdf.columns, s_rows)[0] == digest(d_cols, d_rows)[0]


def test_every_query_registered_has_a_callable():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns[0] == "row_pos"
