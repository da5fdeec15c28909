"""Every registered query with SQL agrees with DuckDB on the smallest test tables."""

import os

import duckdb
import pytest

from conftest import SF_SMALL

TABLES = sorted(f.removesuffix(".parquet") for f in os.listdir(SF_SMALL) if f.endswith(".parquet"))


def _norm(v):
    import datetime as dt
    import decimal
    import math
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _key(row):
    return tuple((x is None, type(x).__name__, x if x is not None else 0) for x in row)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=_key)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t)}.parquet')")
    yield c
    c.close()


def _keys():
    import __spark_entry__ as E
    return sorted(E.oracle_sql())


@pytest.mark.parametrize("key", _keys())
def test_matches_sql(spark, con, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF_SMALL)
    srows = df.collect()
    res = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, srows) == _rows(dcols, res.fetchall())


def test_entry_flagship(spark):
    import __spark_entry__ as E
    rows = E.entry(spark).collect()
    assert len(rows) == 7
    top = max(rows, key=lambda r: r["total_min"])
    assert top["description"] == "Batch coding error" and top["total_min"] == 30720
