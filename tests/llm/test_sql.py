"""Operators that SQL can express, against DuckDB."""

import duckdb
import pytest

from mnemora.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    r = c.execute(queries.oracle_sql()[name])
    columns = [x[0] for x in r.description]
    assert sorted(columns) == names
    assert sorted(str(tuple(row[n] for n in names)) for row in df.collect()) == sorted(str(tuple(x[columns.index(n)] for n in names)) for x in r.fetchall())
