"""Every registered Spark query against its DuckDB oracle SQL, on sf0.001
(tools/oracle_check.py runs them at other sizes)."""

import os

import pytest

from conftest import SF_SMALL

from quillspark.plans import registry

#: Every query of the library that has SQL (those of the training-data operators are tested beside them).
KEYS = sorted(registry.SQL)


@pytest.fixture(scope="module")
def duck():
    import duckdb
    from quillspark.session import TABLES
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    import __spark_entry__ as E
    from tools.oracle_check import digest
    sdf = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
