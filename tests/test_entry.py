"""The driver contract and the DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from quizlake.plans.catalog import oracle_queries, spark_queries
from tools.oracle_check import duck, frame_rows

SF = "/root/testdata/sf0.001"
NO_ORACLE = set()  # the core queries: the training-data ones have their own tests


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["student_name", "topic", "total", "correct", "pct", "weak_raw"]


def test_every_query_has_an_oracle_or_is_listed():
    assert set(spark_queries()) - set(oracle_queries()) == NO_ORACLE
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(oracle_queries()))
def test_oracle_sf0001(spark, con, name):
    df = E.queries()[name](spark, SF)
    scols, srows = frame_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(E.oracle_sql()[name])
    dcols, drows = frame_rows([d[0] for d in cur.description], cur.fetchall())
    assert scols == dcols
    assert srows == drows
