"""Queries with SQL give DuckDB's rows, on a table and on odd rows."""

import os

import duckdb
import pytest

from tallyforge.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD, documents, odd_vectors

TABLES = ["documents", "embeddings"]


def compare(spark, folder, name):
    con = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{folder}/{table}.parquet"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'/*.parquet' if 'odd' in folder else ''}')")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    compare(spark, sf, name)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    documents(spark, ODD).repartition(3).write.parquet(f"{folder}/documents.parquet")
    odd_vectors(spark).repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


# in the SQL of operator 4 the windows of one text are quadratic, too slow for a text of 60,000 words
@pytest.mark.parametrize("name", ["op3_license_join", "op5_source_mix", "op6_jaccard_join", "op11_dictionary_kmeans", "op13_angular_negatives"])
def test_sql_of_odd_rows(spark, odd, name):
    compare(spark, odd, name)
