import os

import duckdb
import pytest

from strandline.oracles import SQL
from strandline.queries import QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, db, name):
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    if name not in SQL:
        assert got
        return
    result = db.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(dict(zip(names, r))[c] for c in columns)) for r in result.fetchall())
