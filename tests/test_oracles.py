"""Every registered query against its DuckDB oracle on the smallest tables."""

import math

import duckdb
import pytest

from framelake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


def sortable(row):
    return tuple((x is None, str(type(x)), 0 if x is None else x) for x in row)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*names).collect()), key=sortable)
    if name not in catalogue.ORACLES:
        assert got
        return
    r = con.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == names
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert got == sorted((tuple(plain(row[k]) for k in order) for row in r.fetchall()), key=sortable)
