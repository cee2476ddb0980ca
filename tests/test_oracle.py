"""Every registered query with oracle SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x


def rows(values):
    return sorted((tuple(plain(x) for x in r) for r in values), key=lambda r: tuple((x is not None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_duckdb(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(tuple(r) for r in df.select(*columns).collect())
    result = duck.execute(ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = rows(tuple(r[k] for k in at) for r in result.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-6)) for x, y in zip(a, b, strict=True)), (a, b)
