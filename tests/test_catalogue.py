"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import re

import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(k for k in __spark_entry__.queries() if not re.match(r"op\d|pipeline$", k))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, DATA)
    rows = got.collect()
    if (sql := __spark_entry__.oracle_sql().get(name)) is None:
        assert rows
        return
    want = duck.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    place = [want.columns.index(c) for c in order]
    assert sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr) == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
