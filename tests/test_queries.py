"""Every operator over the smallest tables, against its SQL."""

import os

import duckdb
import pytest

from veridag.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(cols, data):
    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.OPERATORS))
def test_operator(spark, engine, name):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name in catalogue.SQL:
        out = engine.execute(catalogue.SQL[name])
        cols = [d[0] for d in out.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows(cols, out.fetchall())
    else:
        assert df.columns
