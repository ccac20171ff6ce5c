"""Every query with SQL gives the same rows as DuckDB on the small tables."""

import math

import duckdb
import pytest

from tallyforge import fact_queries, listing_queries, profile_queries, report_queries  # noqa: F401  they add their queries
from tallyforge.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)) or isinstance(b, float) and isinstance(a, (int, float)):
        return math.isclose(float(a), float(b), rel_tol=1e-9, abs_tol=2e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    answer = duck.sql(ORACLE_SQL[name])
    assert sorted(answer.columns) == columns
    want = sorted((tuple(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w)), next((g, w) for g, w in zip(got, want) if not all(map(same, g, w)))
