"""Every query of the catalogue on the smallest tables, against its SQL where it has one."""

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from spagyric.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return tuple(sorted((k, plain(x)) for k, x in v.items())) if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(repr(plain(list(r))) for r in df.select(columns).collect())
    if name not in SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    out = duck.execute(SQL[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == Counter(repr(plain([r[i] for i in at])) for r in out.fetchall())


def test_smoke(spark, sf):
    assert catalogue.flagship(spark, sf).count() > 0
