"""Literal cases of the column functions and operators that no query covers."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import offers as O
from offerlake.functions import text as X
from offerlake.operators import maintenance as H
from offerlake.operators import scoring as G


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column()).collect()]


def test_numbers_in_texts(spark):
    assert values(spark, [("1.234", "56"), ("999", None), ("1.234.567", "")], "a string, b string", lambda: X.price_of_parts(F.col("a"), F.col("b"))) == [1234.56, 999.0, None]
    assert values(spark, [("(1.234)",), ("(12)",), ("12",)], "a string", lambda: X.review_count_in(F.col("a"))) == [1234, 12, None]
    assert values(spark, [("4,7 de 5",), ("nada",)], "a string", lambda: X.rating_in(F.col("a"))) == [4.7, None]
    assert values(spark, [("25% OFF",), ("",)], "a string", lambda: X.percent_in(F.col("a"))) == [25, None]


def test_item_ids(spark):
    assert values(spark, [("https://x/MLB-123",), ("https://x/MLBU123",), ("nothing",)], "a string", lambda: X.item_id(F.col("a"))) == ["MLB123", "MLB123", None]


def test_redaction(spark):
    assert values(spark, [("https://u:p@h.test/a?x=1&y=2#f",)], "a string", lambda: X.redacted(F.col("a"))) == ["https://h.test/a?x=redacted&y=redacted"]


def test_discounts(spark):
    rows = [(0.0, 50.0, 100.0), (None, 50.0, 100.0), (33.5, 1.0, 2.0), (250.0, 1.0, 2.0), (None, 5.0, 5.0), (None, 9.0, 5.0)]
    assert values(spark, rows, "d double, c double, o double", lambda: O.effective_discount(F.col("d"), F.col("c"), F.col("o"))) == [50, 50, 34, 100, 0, 0]


def test_presence_counts_only_full_completed_runs(spark):
    batches = spark.createDataFrame([("s", 1, "completed", 40), ("s", 2, "failed", 40), ("s", 3, "completed", 10), ("s", 4, "completed", 40), ("s", 5, "completed", 40)], "source_id string, batch_no int, status string, total_collected int")
    seen = spark.createDataFrame([("s", 1, "a"), ("s", 4, "b"), ("s", 1, "c"), ("s", 5, "c")], "source_id string, batch_no int, external_item_id string")
    found = {r.external_item_id: (r.missed, r.is_active) for r in H.presence(seen, batches).collect()}
    assert found == {"a": (2, False), "b": (1, True), "c": (0, True)}


def test_analyzers(spark):
    engine = G.Analyzers()
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r.score for r in engine.decide(df).collect()} == {0.0}
    engine.add("x", lambda d: d.where("id = 'a'").select("id", F.lit(250).alias("score"), F.lit(float("inf")).alias("confidence"), F.lit("r").alias("reason")))
    assert {r.id: (r.score, r.confidence, r.reasons) for r in engine.decide(df).collect()} == {"a": (100.0, 0.0, ["r"]), "b": (0.0, 0.0, [])}
    with pytest.raises(ValueError):
        engine.add("x", lambda d: d)


def test_upsert_keeps_old_values_where_new_ones_are_unknown(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, slug string")
    new = spark.createDataFrame([(2, None), (3, "c")], "id int, name string")
    assert sorted(map(tuple, H.upserted(old, new, ["id"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]
