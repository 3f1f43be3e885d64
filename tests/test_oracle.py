"""Every registered query against its DuckDB oracle SQL on the smallest driver tables."""
import pytest

import __spark_entry__ as E
from meterlake.catalog import ORACLE, QUERIES
from oracle_util import duck, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF).toPandas()
    dk = con.execute(ORACLE[name]).df()
    sc, sr = rows(sp)
    dc, dr = rows(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "alert_level" in df.columns
