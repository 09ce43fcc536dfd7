"""Parts of the corpus operators' results against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from terrakern.llm.registry import ORACLE_SQL, QUERIES


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return str(value)
    return str(round(float(value), 4) + 0.0) if math.isfinite(float(value)) else str(value)



@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_check(spark, small, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = connection.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == want
