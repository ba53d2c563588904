"""Each registered query of the offer engine against its DuckDB SQL, and literal cases of the operators."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from offerlake import registry
from offerlake.operators import catalog as C

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return str(x)
    return x


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert table(got.columns, got.collect()) == table(columns, found.fetchall())


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_best_offer_prefers_known_discounts_then_lower_prices(spark):
    rows = [("a", 1, "active", None, 5.0), ("b", 1, "active", 10, 9.0), ("c", 1, "active", 10, 8.0), ("d", 1, "expired", 90, 1.0), ("e", 2, "active", None, None)]
    offers = spark.createDataFrame(rows, "id string, product_id long, status string, discount_percent int, current_price double")
    for name, kind in (("marketplace_id", "long"), ("original_price", "double"), ("free_shipping", "boolean"), ("last_seen_at", "timestamp")):
        offers = offers.withColumn(name, F.lit(None).cast(kind))
    assert {r.product_id: r.offer_id for r in C.best_offers(offers).collect()} == {1: "c", 2: "e"}


def test_pages_are_clamped(spark):
    df = spark.range(250)
    assert [r.id for r in C.page(df, [F.col("id")], 0, 3).collect()] == [0, 1, 2]
    assert C.page(df, [F.col("id")], 1, 1000).count() == 100
    assert C.page(df, [F.col("id")], 99, 20).count() == 0
