"""Registered queries: names, and the SQL twins on sf0.01."""

import duckdb
import pytest

from kernelspark.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


def test_names():
    import __spark_entry__ as E
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = QUERIES[name](spark, DIR)
    twin = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in twin.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert got == sorted(twin.fetchall()) and len(got) == (100 if "conversation" in name else 1000)
