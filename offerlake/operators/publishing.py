"""Rows that publishing and review make: products, offers, images, triage, audit. Keys come from content, so a rerun makes the same rows.

One routing (or one outcome per triage row) is staged and projected to each table; nothing is decided twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.offers import section_of
from . import runs as R
from .catalog import staged

# Notes and default reasons.
SYSTEM, AUTO_NOTE, RUN_NOTE, BULK_REASON = "system", "Auto-aprovado: ", "Coleta automática: ", "Rejeitado em lote"
CARRIED = ("external_id", "source_id", "title", "image", "url", "price", "original_price", "discount", "free_shipping")


def key_of(kind: str, *parts: Column) -> Column:
    """32 hexadecimal digits that name a row of a kind."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), *parts), 256), 1, 32)


def product_rows(rows: DataFrame) -> DataFrame:
    """Published products of rows with product_id, name, slug, brand_slug, category_slug, image, section."""
    return rows.select(F.col("product_id").alias("id"), F.col("name").alias("main_name"), "slug", "brand_slug", F.col("category_slug").alias("main_category_slug"), F.col("image").alias("main_image_url"), F.lit("published").alias("catalog_status"), F.col("name").alias("short_description"), "section")


def offer_rows(rows: DataFrame) -> DataFrame:
    columns = ["marketplace_id", F.col("price").alias("current_price"), "original_price", F.col("discount").alias("discount_percent"), F.col("url").alias("original_url"), "affiliate_url", "free_shipping", "external_id"]
    return rows.select(F.col("offer_id").alias("id"), "product_id", *columns, F.lit("active").alias("status"))


def image_rows(rows: DataFrame) -> DataFrame:
    """The first image of each product that has one."""
    have = rows.where("image <> ''")
    return have.select(key_of("image", F.col("product_id")).alias("id"), "product_id", F.col("image").alias("url"), F.col("name").alias("alt"), F.lit(0).alias("sort_order"), F.lit(True).alias("is_primary"))


@dataclass
class Published:
    """What a run publishes, a DataFrame a table; every product_id and processed_id resolves."""

    products: DataFrame
    offers: DataFrame
    images: DataFrame
    triage: DataFrame


def published(items: DataFrame, triage: DataFrame, sources: DataFrame, parameters: str, marketplace_id: int = 1, publish_all: bool = False) -> Published:
    """Untriaged items as product, offer, image and approved triage row, or as a pending triage row with its issues.

    sources: id, name. An item without a known source keeps an empty name in its note.
    """
    routed = R.routed(items, triage, publish_all, CARRIED)
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    passes = F.col("route") == "published"
    routed = routed.join(names, "source_id", "left").withColumn("product_id", F.when(passes, key_of("product", F.col("content_hash")))).withColumn("offer_id", F.when(passes, key_of("offer", F.col("content_hash"))))
    routed = staged(routed, "routing")
    made = routed.where(F.col("product_id").isNotNull()).withColumn("name", F.col("title")).withColumn("section", F.lit(None).cast("string"))
    made = made.withColumn("affiliate_url", X.tracked(F.col("url"), parameters)).withColumn("marketplace_id", F.lit(marketplace_id).cast("long"))
    sure = F.floor(F.col("confidence") * 100 + 0.5).cast("string")
    auto = F.concat(F.lit(AUTO_NOTE), F.coalesce("brand_detected", F.lit("")), F.lit(" ("), sure, F.lit("% confiança)"))
    note = F.when(passes, auto).otherwise(F.concat(F.lit(RUN_NOTE), F.coalesce("source_name", F.lit(""))))
    waiting = routed.select(
        key_of("triage", F.col("content_hash")).alias("id"), F.col("content_hash").alias("processed_id"), F.when(passes, "approved").otherwise("pending").alias("status"), "priority",
        F.when(~passes, F.col("source_id")).alias("collection_source_id"), note.alias("admin_notes"), F.when(passes, SYSTEM).alias("approved_by"), passes.alias("auto_approved"),
        F.when(passes, F.col("decision")).alias("auto_approved_reason"), "brand_detected", F.col("confidence").alias("brand_confidence"), F.when(~passes, F.col("issues")).alias("issues"), "product_id",
    )
    return Published(product_rows(made), offer_rows(made), image_rows(made), waiting)


@dataclass
class Reviewed:
    """What review decisions make, a DataFrame a table; ``audit`` is appended to, never changed."""

    products: DataFrame
    offers: DataFrame
    images: DataFrame
    statuses: DataFrame
    audit: DataFrame


def reviewed(triage: DataFrame, processed: DataFrame, decisions: DataFrame, default_reason: str = BULK_REASON, marketplace_id: int = 1) -> Reviewed:
    """Decisions (decision_id, at, triage_id, action, name, brand, category, reason) as rows of each table.

    Of several decisions on a triage row the last by time and id has effect, once; all are audited. Overrides that are
    empty count as none; a brand or category comes from the decision, else the triage row's suggestion, else detection.
    Decisions on rows that aren't there make nothing.
    """
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = triage.select(F.col("id").alias("triage_id"), "processed_id", "suggested_brand", "suggested_category").join(processed.withColumnRenamed("id", "processed_id"), "processed_id")
    told = staged(decisions.where(F.col("action").isin("approve", "reject")).join(rows, "triage_id"), "decisions")
    last = told.groupBy("triage_id").agg(F.max_by("decision_id", F.struct("at", "decision_id")).alias("decision_id"))
    marked = told.join(last.withColumn("effective", F.lit(True)), ["triage_id", "decision_id"], "left").withColumn("effective", F.coalesce("effective", F.lit(False)))
    approve = F.col("action") == "approve"
    makes = F.col("effective") & approve
    marked = marked.withColumn("product_id", F.when(makes, key_of("reviewed-product", F.col("triage_id")))).withColumn("offer_id", F.when(makes, key_of("reviewed-offer", F.col("triage_id"))))
    made = marked.where(makes).withColumn("name", F.coalesce(some("name"), "normalized_title"))
    made = made.withColumn("slug", X.published_slug(F.col("name"), F.col("triage_id"), 100)).withColumn("section", section_of(F.col("promotion_type"))).withColumn("marketplace_id", F.lit(marketplace_id).cast("long"))
    made = made.withColumn("brand_slug", F.coalesce(some("brand"), some("suggested_brand"), "detected_brand")).withColumn("category_slug", F.coalesce(some("category"), some("suggested_category"), "detected_category"))
    statuses = marked.where("effective").select(F.col("triage_id").alias("id"), F.when(approve, "approved").otherwise("rejected").alias("status"), F.col("at").alias("resolved_at"))
    audit = marked.select(key_of("action", F.col("decision_id").cast("string")).alias("id"), "triage_id", "action", "at", "effective", F.when(~approve, F.coalesce(some("reason"), F.lit(default_reason))).alias("rejection_reason"), F.col("product_id").alias("result_product_id"), F.col("offer_id").alias("result_offer_id"))
    return Reviewed(product_rows(made), offer_rows(made), image_rows(made), statuses, audit)


def with_statuses(triage: DataFrame, statuses: DataFrame) -> DataFrame:
    """Triage rows with what review made of them."""
    new = statuses.select("id", F.col("status").alias("_status"))
    return triage.join(new, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
