"""A collection run as set operations: memberships, raw and processed rows, publishing, review decisions.

State is never updated in place: every operator returns the new rows. Of several items for one key, the last by
position counts, as if they had come one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import titles as T

MISSES, AUTO_DISCOUNT = 2, 30


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def first_rows_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def upserted_memberships(members: DataFrame, items: DataFrame, batch: str) -> DataFrame:
    """Memberships after a run: items match by source and external id, those without one by source and hash; a match is refreshed,
    active and not missed; what matches nothing is new, once a key."""
    by_id = members.where("external_item_id is not null").groupBy("source_id", F.col("external_item_id").alias("external_id")).agg(F.min("id").alias("member"))
    by_hash = members.groupBy("source_id", "content_hash").agg(F.min("id").alias("member"))
    named = items.where("external_id is not null").join(by_id, ["source_id", "external_id"], "left")
    loose = items.where("external_id is null").join(by_hash, ["source_id", "content_hash"], "left")
    met = named.unionByName(loose)
    order = ["position", "item_id"]
    seen = last_rows(met.where("member is not null"), ["member"], order).select(F.col("member").alias("id"), F.col("content_hash").alias("_hash"), F.col("title").alias("_title"), F.lit(True).alias("_seen"))
    old = members.join(seen, "id", "left")
    hit = F.coalesce("_seen", F.lit(False))
    old = old.select("id", "source_id", "external_item_id", F.coalesce("_hash", "content_hash").alias("content_hash"), F.coalesce("_title", "raw_title").alias("raw_title"), (hit | F.col("is_active")).alias("is_active"), F.when(hit, batch).otherwise(F.col("last_batch")).alias("last_batch"), F.when(hit, 0).otherwise(F.col("missed")).alias("missed"))
    key = F.coalesce(F.concat(F.lit("e:"), "external_id"), F.concat(F.lit("h:"), "content_hash"))
    new = last_rows(met.where("member is null").withColumn("_key", key), ["source_id", "_key"], order)
    new = new.select(F.concat_ws("-", F.lit("new"), "source_id", "_key").alias("id"), "source_id", F.col("external_id").alias("external_item_id"), "content_hash", F.col("title").alias("raw_title"), F.lit(True).alias("is_active"), F.lit(batch).alias("last_batch"), F.lit(0).alias("missed"))
    return old.unionByName(new)


def with_misses(members: DataFrame, batch: str, sources: DataFrame) -> DataFrame:
    """Active members of the run's sources that it didn't see miss once more and go at MISSES; one never in a batch is let be.
    ``left`` says which go in this run."""
    ran = sources.select("source_id").distinct().withColumn("_ran", F.lit(True))
    gone = F.coalesce(F.col("_ran") & F.col("is_active") & (F.col("last_batch") != batch), F.lit(False))
    joined = members.join(ran, "source_id", "left").withColumn("_gone", gone)
    joined = joined.withColumn("left", F.col("_gone") & (F.col("missed") + 1 >= MISSES))
    missed = F.when(F.col("_gone"), F.col("missed") + 1).otherwise(F.col("missed"))
    return joined.withColumn("is_active", F.col("is_active") & ~F.col("left")).withColumn("missed", missed).drop("_ran", "_gone")


def missed_memberships(members: DataFrame, batch: str, sources: DataFrame) -> DataFrame:
    """The states of ``with_misses``."""
    return with_misses(members, batch, sources).select("id", "source_id", "is_active", "missed")


def known_items(items: DataFrame, processed: DataFrame) -> DataFrame:
    """Items with ``known`` and the latest processed row of their hash."""
    latest = processed.groupBy("content_hash").agg(F.max_by("id", F.struct("processed_at", "id")).alias("processed_id"))
    return items.join(latest, "content_hash", "left").withColumn("known", F.col("processed_id").isNotNull())


def new_items(items: DataFrame, processed: DataFrame) -> DataFrame:
    """The first item of each hash that was never processed."""
    return first_rows_by(items.join(processed.select("content_hash"), "content_hash", "left_anti"), ["content_hash"], ["position", "item_id"])


def raw_rows(items: DataFrame, batch: str) -> DataFrame:
    payload = F.to_json(F.struct(F.coalesce("brand", F.lit("N/A")).alias("brand"), "free_shipping", F.col("source_id").alias("source")))
    return items.select("content_hash", F.lit(batch).alias("batch_id"), "external_id", F.col("title").alias("raw_title"), F.col("price").cast("string").alias("raw_price"), F.col("original_price").cast("string").alias("raw_original_price"), F.col("image").alias("raw_image"), F.col("url").alias("raw_url"), F.col("discount").alias("raw_discount"), payload.alias("raw_data"))


def processed_rows(items: DataFrame, parameters: str) -> DataFrame:
    title = F.col("title")
    return items.select("content_hash", "external_id", title.alias("normalized_title"), T.brand_of(title, F.col("brand")).alias("detected_brand"), T.attribute(title, "category").alias("detected_category"), "price", "original_price", "discount", X.tracked(F.col("url"), parameters).alias("affiliate_url"), "promotion_type", "free_shipping")


def refreshed(processed: DataFrame, items: DataFrame) -> DataFrame:
    """Processed rows whose hash came again take the promotion and shipping of the last such item."""
    last = last_rows(items, ["content_hash"], ["position", "item_id"]).select("content_hash", F.col("promotion_type").alias("_promotion"), F.col("free_shipping").alias("_free"))
    joined = processed.join(last, "content_hash", "left")
    return joined.select("id", F.coalesce("_promotion", "promotion_type").alias("promotion_type"), F.coalesce("_free", "free_shipping").alias("free_shipping"))


def refreshed_offers(offers: DataFrame, items: DataFrame, processed: DataFrame) -> DataFrame:
    """Offers take the shipping of the last known item with their external id."""
    again = items.where("external_id is not null").join(processed.select("content_hash").distinct(), "content_hash", "left_semi")
    last = last_rows(again, ["external_id"], ["position", "item_id"]).select("external_id", F.col("free_shipping").alias("_free"))
    return offers.join(last, "external_id", "left").select("id", F.coalesce("_free", "free_shipping").alias("free_shipping"), (~F.coalesce("_free", "free_shipping").eqNullSafe(F.col("free_shipping"))).alias("changed"))


def judged(items: DataFrame, publish_all: bool = False) -> tuple[DataFrame, Column, Column, Column]:
    """Items with their brands and confidence; their issues, the decision on them, and whether they are published."""
    title = F.col("title")
    items = items.withColumn("_brands", T.trusted_brands(title, F.col("brand"))).withColumn("confidence", T.brand_confidence(title, F.col("brand"), F.col("_brands")))
    issues = T.card_issues(title, F.col("url"), F.col("image"), F.col("price"), F.col("discount"))
    decision = T.approval(F.col("_brands"), F.col("confidence"), issues)
    passes = F.lit(publish_all) | ((decision == "auto_approved") & (F.coalesce("discount", F.lit(0)) >= AUTO_DISCOUNT))
    return items, issues, decision, passes


def routed(items: DataFrame, triage: DataFrame, publish_all: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Untriaged items (by hash and by external id), the first of each hash, with what becomes of them: published or pending.
    Columns of the items may be carried, then with ``brand_detected``."""
    seen_hash, seen_id = triage.select("content_hash").distinct(), triage.where("external_id is not null").select("external_id").distinct()
    fresh = items.join(seen_hash, "content_hash", "left_anti").join(seen_id, "external_id", "left_anti")
    fresh, issues, decision, passes = judged(first_rows_by(fresh, ["content_hash"], ["position", "item_id"]), publish_all)
    title = F.col("title")
    return fresh.select(
        "content_hash", "item_id", F.when(passes, "published").otherwise("pending").alias("route"), decision.alias("decision"), F.array_join(issues, ",").alias("issues"), "confidence",
        F.when(F.col("discount") >= 20, 1).otherwise(0).alias("priority"), F.when(passes, X.published_slug(title, F.col("content_hash"))).alias("slug"),
        F.when(passes, X.slug(T.brand_of(title, F.col("brand")))).alias("brand_slug"), F.when(passes, T.attribute(title, "category")).alias("category_slug"),
        *([F.get("_brands", F.lit(0)).alias("brand_detected"), *carry] if carry else []),
    )


def decided(triage: DataFrame, processed: DataFrame, decisions: DataFrame, default_reason: str = "Rejeitado em lote") -> DataFrame:
    """Decisions (id, action, name, reason) on triage rows: found, new status, the product that an approval makes, the reason of a rejection."""
    from ..functions.offers import section_of

    rows = triage.select("id", "processed_id").join(processed.select(F.col("id").alias("processed_id"), "normalized_title", "promotion_type", "detected_brand"), "processed_id")
    joined = decisions.join(rows, "id", "left")
    found, approve = F.col("processed_id").isNotNull(), F.col("action") == "approve"
    name = F.coalesce(F.nullif("name", F.lit("")), "normalized_title")
    return joined.select(
        "id", "action", found.alias("found"), F.when(found, F.when(approve, "approved").otherwise("rejected")).alias("status"), F.when(found & approve, name).alias("product_name"),
        F.when(found & approve, X.published_slug(name, F.col("id"), 100)).alias("slug"), F.when(found & approve, section_of(F.col("promotion_type"))).alias("section"),
        F.when(found & ~approve, F.coalesce("reason", F.lit(default_reason))).alias("reason"),
    )


def upserted_colors(old: DataFrame, new: DataFrame) -> DataFrame:
    """product_id, value, label, confidence: the new label replaces the old, the greater confidence stays."""
    fresh = new.where(F.col("confidence").between(0, 1) & F.col("value").isNotNull())
    a = old.select("product_id", "value", F.col("label").alias("_old"), F.col("confidence").alias("_sure"))
    b = fresh.groupBy("product_id", "value").agg(F.max_by("label", "at").alias("label"), F.max_by("confidence", "at").alias("confidence"))
    return a.join(b, ["product_id", "value"], "full").select("product_id", "value", F.coalesce("label", "_old").alias("label"), F.greatest("confidence", "_sure").alias("confidence"))


def resolved_brands(names: DataFrame, brands: DataFrame) -> DataFrame:
    """Distinct brand names with the slug that they have or get; ``created`` for those that no row had."""
    wanted = names.select(F.trim("name").alias("name")).where("name <> ''").withColumn("slug", X.slug(F.col("name"))).where("slug is not null")
    wanted = wanted.groupBy("slug").agg(F.min("name").alias("name"))
    known = brands.select("slug", F.col("name").alias("known"))
    return wanted.join(known, "slug", "left").select("slug", F.coalesce("known", X.display_name(F.col("name"))).alias("name"), F.col("known").isNull().alias("created"))


def seeded(dimension: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows and, of the seeds, those whose slug is not there."""
    return dimension.select("slug", "name").unionByName(seeds.select("slug", "name").join(dimension.select("slug"), "slug", "left_anti"))


def subscriptions(events: DataFrame) -> DataFrame:
    """Per e-mail key: whether it is active, since when, and when it left. Subscribing while active changes nothing."""
    w = Window.partitionBy("email").orderBy("at", "id")
    steps = events.withColumn("_before", F.lag("subscribes").over(w))
    turns = steps.where(F.col("_before").isNull() & F.col("subscribes") | (F.col("_before") != F.col("subscribes")))
    last = F.max(F.struct("at", "id", "subscribes")).alias("last")
    return turns.groupBy("email").agg(last).select("email", F.col("last.subscribes").alias("is_active"), F.when(F.col("last.subscribes"), F.col("last.at")).alias("since"), F.when(~F.col("last.subscribes"), F.col("last.at")).alias("left_at"))


def violations(rows: DataFrame, rules: dict[str, Column], row_id: str = "id") -> DataFrame:
    """A row per broken rule."""
    broken = F.array_compact(F.array(*[F.when(~holds, name) for name, holds in rules.items()]))
    return rows.select(F.col(row_id).cast("string").alias("row_id"), F.explode(broken).alias("rule"))


# Limits and names that a source's columns keep to.
NAME_LENGTH, NOTES_LENGTH = 200, 5000
STATUSES = ("active", "inactive", "ended")
SOURCE_TYPES = ("promotion", "brand", "category", "outlet", "campaign", "other")


def source_rules() -> dict[str, Column]:
    """The rules of a source's row; ``_market`` tells that its marketplace is there. Null dates and notes break none."""
    known = lambda c: F.coalesce(c, F.lit(False))
    return {
        "name_length": known(F.length(F.trim("name")).between(1, NAME_LENGTH)), "url_pattern": known(F.col("url").rlike(r"(?i)^https?://\S+$")), "priority_negative": known(F.col("priority") >= 0),
        "ends_before_start": F.coalesce(F.col("ends_at") >= F.col("starts_at"), F.lit(True)), "notes_length": F.coalesce(F.length(F.trim("notes")) <= NOTES_LENGTH, F.lit(True)),
        "status_value": known(F.col("status").isin(*STATUSES)), "source_type_value": known(F.col("source_type").isin(*SOURCE_TYPES)), "unknown_marketplace": F.col("_market").isNotNull(),
    }
