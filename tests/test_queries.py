"""Every query over the test tables against its SQL, on the smallest tables."""

import duckdb
import pytest

from docketry.plans.inputs import TABLES
from docketry.plans.queries_files import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(rows, columns):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE:
        assert rows
        return
    want = con.sql(ORACLE[name])
    assert canonical(rows, got.columns) == canonical(want.fetchall(), list(want.columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
