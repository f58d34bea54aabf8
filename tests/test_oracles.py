"""Each registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest
from cloakwork.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, sf, name):
    run, sql = queries.QUERIES[name]
    df = run(spark, sf)
    columns = sorted(df.columns)
    got = rows_of(df.select(*columns).collect())
    assert got or name.startswith("rule_kw_")  # some labels occur in none of these texts
    if sql:
        assert got == rows_of(duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
