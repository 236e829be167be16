"""Every query against its SQL in DuckDB at the smallest size."""

import math

import duckdb
import pytest

from auditloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(catalog.oracle_sql())


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(catalog.oracle_sql()[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == want
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    r = __spark_entry__.entry(spark).collect()
    assert len(r) == 1 and 0 < r[0].f1 < 1
