"""The training-data queries that have SQL, against it."""

import glob
import os

import duckdb
import pytest

from offerlake.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import SF, table


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, found = QUERIES[name](spark, SF), duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, found.fetchall())


def test_queries_without_sql_are_known():
    assert {name.split("_")[0] for name in QUERIES.keys() - ORACLE_SQL.keys()} == {"op3", "op4", "op5", "op6", "op7", "op8", "op11", "op12", "op13"}
