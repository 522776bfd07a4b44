"""Every query of the session engine against its SQL on the same tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

from threadloom import catalog

SF_DIR = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(SF_DIR).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _key(value):
    return (value is not None, f"{value:.6f}" if isinstance(value, float) else str(value))


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(_key, r)))


def _same(x, y):
    if isinstance(x, float) or isinstance(y, float):
        return x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)
    return x == y


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF_DIR)
    wanted = duck.execute(catalog.ORACLE_SQL[name])
    columns = sorted(found.columns)
    names = [c[0] for c in wanted.description]
    assert columns == sorted(names)
    order = [names.index(c) for c in columns]
    expected = _sorted([r[i] for i in order] for r in wanted.fetchall())
    actual = _sorted(found.select(*columns).collect())
    assert len(actual) == len(expected)
    assert len(actual) > 0 or name == "jn05_missing_pins"
    wrong = [(a, e) for a, e in zip(actual, expected) if not all(map(_same, a, e))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_query_without_sql_returns_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF_DIR).count() > 0
