import datetime

import duckdb
import pytest

from tracewell.plans.catalog import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf01):
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf01}/events.parquet'")
    return con


def rows(dicts):
    return sorted((tuple(v for _, v in sorted(r.items())) for r in dicts), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf01, duck, name):
    out = [r.asDict() for r in QUERIES[name](spark, sf01).collect()]
    assert out
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in got.description]
        assert rows(out) == rows(dict(zip(names, r)) for r in got.fetchall())
