"""Every registered query of the library against its DuckDB twin on sf0.001."""

import os

import duckdb
import pytest

from conftest import SF001
from kernelspark.plans.registry import ORACLE_SQL, QUERIES
from kernelspark.sources.tables import TABLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF001}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, SF001)
    got = rows_of(df.columns, df.collect())
    twin = duck.execute(ORACLE_SQL[name])
    want = rows_of([d[0] for d in twin.description], twin.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in twin.description) and got == want and got
