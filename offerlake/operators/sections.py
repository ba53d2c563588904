"""Deal sections and triage: what is on offer now, once per title, and what waits for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_key
from .catalog import first_rows


def active_items(memberships: DataFrame, processed: DataFrame, sources: DataFrame) -> DataFrame:
    """Active memberships of active sources with the processed rows of their content; null hashes drop out."""
    m = memberships.where("is_active").select(F.col("id").alias("membership_id"), "source_id", "content_hash", "last_seen_at", "raw_title", "raw_url")
    live = sources.where("is_active").select(F.col("id").alias("source_id"))
    return m.join(live, "source_id", "left_semi").join(processed, "content_hash")


def approved(processed: DataFrame, triage: DataFrame) -> DataFrame:
    """Processed rows that were approved, or that share an external id with one that was.

    One pass: the approved ids and their external ids are two small sets, not one OR-join.
    """
    ids = triage.where("status = 'approved'").select(F.col("processed_id").alias("id")).distinct()
    items = processed.join(ids, "id", "left_semi").where("external_id is not null").select("external_id").distinct()
    marked = processed.join(ids.withColumn("by_id", F.lit(True)), "id", "left").join(items.withColumn("by_item", F.lit(True)), "external_id", "left")
    return marked.where("by_id or by_item").drop("by_id", "by_item")


def deals(items: DataFrame, promotion: str | None = None) -> DataFrame:
    """One item per title key: the highest discount, then the latest seen, then the lowest id."""
    chosen = items if promotion is None else items.where(F.col("promotion_type") == promotion)
    keyed = chosen.withColumn("title_key", title_key(F.col("normalized_title"), F.col("raw_title")))
    return first_rows(keyed, ["title_key"], deal_order())


def deal_order() -> list[Column]:
    return [F.col("discount_percent").desc_nulls_last(), F.desc("last_seen_at"), F.col("membership_id")]


def projected(items: DataFrame) -> DataFrame:
    """What a card shows, with fallbacks for empty titles and links; rows without a price go."""
    filled = lambda *cs: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cs])
    return items.where("price > 0").select("membership_id", F.coalesce(filled("normalized_title", "raw_title"), F.lit("Produto")).alias("title"), F.coalesce(filled("raw_url"), F.lit("")).alias("url"), "price", "original_price", "discount_percent", "free_shipping", "last_seen_at")


def not_yet_triaged(items: DataFrame, triage: DataFrame) -> DataFrame:
    """Items whose content and whose external id are both new to triage; a null id is new."""
    return items.join(triage.select("content_hash").distinct(), "content_hash", "left_anti").join(triage.select("external_id").where("external_id is not null").distinct(), "external_id", "left_anti")


def eligibility(now: Column, supported: Column) -> Column:
    """Whether a source may be collected, or the first reason why not; both ends of its period count."""
    url = F.col("url")
    return (
        F.when(~F.col("status").eqNullSafe("active"), "not_active").when(~F.coalesce(url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:[^ ]+$"), F.lit(False)), "bad_url")
        .when(~url.rlike("(?i)^https?:"), "bad_scheme").when(F.col("starts_at") > now, "not_started").when(F.col("ends_at") < now, "ended")
        .when(~supported, "unsupported_provider").otherwise("ok")
    )
