"""State from history: presence with anti-flapping, favourites, colours. New state is written as a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def presence(observations: DataFrame, batches: DataFrame, least_items: int = 30, misses: int = 2) -> DataFrame:
    """Per source and item: last_batch, missed, is_active.

    Only completed batches with enough items count as misses. The gap since an item was last seen is the
    source's number of such batches less that up to the item's last one, so no batch is paired with an item.
    """
    counts = F.when((F.col("status") == "completed") & (F.col("total_collected") >= least_items), 1).otherwise(0)
    w = Window.partitionBy("source_id")
    running = batches.withColumn("counts", counts).withColumn("so_far", F.sum("counts").over(w.orderBy("batch_no")))  # a row per run
    running = running.withColumn("total", F.sum("counts").over(w)).select("source_id", F.col("batch_no").alias("last_batch"), (F.col("total") - F.col("so_far")).alias("gap"))
    last = observations.groupBy("source_id", "external_item_id").agg(F.max("batch_no").alias("last_batch"))
    joined = last.join(running, ["source_id", "last_batch"], "left")
    gap = F.coalesce("gap", F.lit(0))
    return joined.select("source_id", "external_item_id", "last_batch", F.least(gap, F.lit(misses)).cast("int").alias("missed"), (gap < misses).alias("is_active"))


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where both have a key, the new values that are known replace the old."""
    values = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in values])
    b = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values if c in new.columns])
    joined = a.join(b, keys, "full")
    return joined.select(*keys, *[(F.coalesce(f"new_{c}", f"old_{c}") if c in new.columns else F.col(f"old_{c}")).alias(c) for c in values])


def patched(old: DataFrame, patch: DataFrame, keys: list[str], now: Column, stamp: str = "updated_at") -> DataFrame:
    """Rows of a table with the known values of a partial patch, and the time of the change where there is one. Keys that
    are not there make nothing."""
    values = [c for c in patch.columns if c not in keys]
    new = patch.select(*keys, *[F.col(c).alias(f"new_{c}") for c in values], F.lit(True).alias("_hit"))
    joined = old.join(new, keys, "left")
    told = {c: F.coalesce(f"new_{c}", c) for c in values} | {stamp: F.when(F.col("_hit"), now).otherwise(F.col(stamp))}
    return joined.select(*[told.get(c, F.col(c)).alias(c) for c in old.columns])


def importable(payload: DataFrame, products: DataFrame, saved: DataFrame) -> DataFrame:
    """(user_id, product_id) pairs of a payload that exist and that the user hasn't saved yet, once each."""
    known = products.select(F.col("id").alias("product_id"))
    return payload.select("user_id", "product_id").distinct().join(known, "product_id", "left_semi").join(saved, ["user_id", "product_id"], "left_anti").select("user_id", "product_id")
