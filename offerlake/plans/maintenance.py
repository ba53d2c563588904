"""Queries of state: presence, favourites, colours, patches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import titles as T
from ..functions.text import slug
from ..operators import maintenance as H
from ..registry import query
from .attributes import LABEL_SQL, normal_sql


@query("membership_history_state", """
    WITH l AS (SELECT source_id, external_item_id, max(batch_no) AS last_batch FROM v_observations GROUP BY ALL),
    g AS (SELECT l.*, (SELECT count(*) FROM v_batches b WHERE b.source_id = l.source_id AND b.batch_no > l.last_batch AND b.status = 'completed' AND b.total_collected >= 50) AS gap FROM l)
    SELECT source_id, external_item_id, last_batch, CAST(least(gap, 2) AS INT) AS missed, gap < 2 AS is_active FROM g""")
def membership_history_state(v):
    return H.presence(v.v_observations, v.v_batches, least_items=50)


@query("membership_stale", "SELECT id, is_active AND last_seen_at >= timestamp '1996-01-01 00:00:00' AS is_active FROM v_memberships")
def membership_stale(v):
    return v.v_memberships.select("id", (F.col("is_active") & (F.col("last_seen_at") >= F.expr("timestamp '1996-01-01 00:00:00'"))).alias("is_active"))


@query("favorites_union", "SELECT user_id, product_id FROM v_favorites UNION SELECT user_id, product_id + 1 FROM v_favorites")
def favorites_union(v):
    more = v.v_favorites.select("user_id", (F.col("product_id") + 1).alias("product_id"))
    return v.v_favorites.select("user_id", "product_id").unionByName(more).dropDuplicates(["user_id", "product_id"])


@query("favorites_merge", """SELECT DISTINCT f.user_id, f.product_id + 2 AS product_id FROM v_favorites f WHERE f.product_id + 2 IN (SELECT id FROM v_products)
    AND NOT EXISTS (SELECT 1 FROM v_favorites g WHERE g.user_id = f.user_id AND g.product_id = f.product_id + 2)""")
def favorites_merge(v):
    payload = v.v_favorites.select("user_id", (F.col("product_id") + 2).alias("product_id"))
    return H.importable(payload, v.v_products, v.v_favorites.select("user_id", "product_id"))


@query("distinct_ids", "SELECT DISTINCT external_id FROM v_processed")
def distinct_ids(v):
    return v.v_processed.select("external_id").distinct()


@query("published_external_ids", "SELECT DISTINCT p.id AS product_id, o.external_id FROM v_products p JOIN v_offers o ON o.product_id = p.id WHERE p.catalog_status = 'published' AND trim(o.external_id) <> ''")
def published_external_ids(v):
    published = v.v_products.where("catalog_status = 'published'").select(F.col("id").alias("product_id"))
    return v.v_offers.where("trim(external_id) <> ''").select("product_id", "external_id").join(published, "product_id", "left_semi").distinct()


_NAMES = "(SELECT product_id, name, 1 AS kind FROM v_colors UNION ALL SELECT product_id, variation_name, 2 FROM v_colors) q"
_SLUG = f"nullif(replace({normal_sql('label')}, ' ', '-'), '')"


@query("official_colors", f"""
    WITH l AS (SELECT product_id, kind, CASE WHEN length(trim(name)) BETWEEN 1 AND 120 THEN {LABEL_SQL} END AS label FROM {_NAMES}), s AS (SELECT *, {_SLUG} AS value FROM l)
    SELECT product_id, value, max_by(label, kind) AS label FROM s WHERE value IS NOT NULL GROUP BY product_id, value""")
def official_colors(v):
    both = v.v_colors.select("product_id", F.explode(F.array(F.struct("name", F.lit(1).alias("kind")), F.struct(F.col("variation_name").alias("name"), F.lit(2).alias("kind")))).alias("c"))
    labels = both.select("product_id", "c.kind", T.color_label(T.clean_color(F.col("c.name"))).alias("label")).withColumn("value", slug(F.col("label")))
    return labels.where("value is not null").groupBy("product_id", "value").agg(F.max_by("label", "kind").alias("label"))


@query("primary_color", f"""
    WITH l AS (SELECT product_id, CASE WHEN length(trim(name)) BETWEEN 1 AND 120 THEN {LABEL_SQL} END AS label FROM {_NAMES}), s AS (SELECT DISTINCT product_id, {_SLUG} AS value FROM l)
    SELECT product_id, CASE WHEN count(value) = 1 THEN min(value) END AS color FROM s GROUP BY product_id""")
def primary_color(v):
    both = v.v_colors.select("product_id", F.explode(F.array("name", "variation_name")).alias("name"))
    values = both.select("product_id", slug(T.color_label(T.clean_color(F.col("name")))).alias("value")).distinct()
    return values.groupBy("product_id").agg(F.when(F.count("value") == 1, F.min("value")).alias("color"))


@query("dimension_update", "SELECT id, CASE WHEN id % 3 = 0 THEN 'renamed ' || CAST(id AS VARCHAR) ELSE name END AS name, slug FROM v_marketplaces")
def dimension_update(v):
    patch = v.v_marketplaces.where("id % 3 = 0").select("id", F.concat(F.lit("renamed "), F.col("id").cast("string")).alias("name"))
    return H.upserted(v.v_marketplaces, patch, ["id"])


@query("cascade_delete", "SELECT user_id, product_id FROM v_favorites WHERE product_id % 10 <> 0")
def cascade_delete(v):
    deleted = v.v_products.where("id % 10 = 0").select(F.col("id").alias("product_id"))
    return v.v_favorites.join(deleted, "product_id", "left_anti").select("user_id", "product_id")
