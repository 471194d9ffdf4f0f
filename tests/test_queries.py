"""Every registered query of the core against its SQL on the smallest data."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v if v is None else str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


def core_names():
    import __spark_entry__
    from ledgerlens.plans import registry

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    return sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", core_names())
def test_query(spark, data, duck, name):
    from ledgerlens.plans import registry

    df = registry.QUERIES[name](spark, data)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in registry.ORACLE:
        assert got
        return
    r = duck.execute(registry.ORACLE[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, r.fetchall())
