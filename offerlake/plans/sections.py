"""Queries of deal sections, triage, sources and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import sections as S
from ..registry import query

_ACTIVE = """a AS (SELECT m.id AS membership_id, m.source_id, m.last_seen_at, m.raw_title, m.raw_url, p.* FROM v_memberships m JOIN v_processed p ON p.content_hash = m.content_hash
    JOIN v_sources s ON s.id = m.source_id WHERE m.is_active AND s.is_active)"""
_OK = """ok AS (SELECT p.* FROM v_processed p WHERE EXISTS (SELECT 1 FROM v_triage t WHERE t.processed_id = p.id AND t.status = 'approved')
    OR (p.external_id IS NOT NULL AND EXISTS (SELECT 1 FROM v_triage t JOIN v_processed q ON q.id = t.processed_id WHERE q.external_id = p.external_id AND t.status = 'approved')))"""
_KEY = r"lower(substring(regexp_replace(coalesce(normalized_title, raw_title, ''), '\s+', ' ', 'g'), 1, 60))"
_ORDER = "discount_percent DESC NULLS LAST, last_seen_at DESC, membership_id"


def _active(v):
    return S.active_items(v.v_memberships, v.v_processed, v.v_sources)


@query("active_deal_items", f"WITH {_ACTIVE} SELECT membership_id, id, price, discount_percent FROM a")
def active_deal_items(v):
    return _active(v).select("membership_id", "id", "price", "discount_percent")


@query("approval_continuity", f"WITH {_OK} SELECT id, external_id FROM ok")
def approval_continuity(v):
    return S.approved(v.v_processed, v.v_triage).select("id", "external_id")


@query("deal_section", f"""
    WITH {_ACTIVE}, d AS (SELECT DISTINCT ON ({_KEY}) {_KEY} AS title_key, membership_id, price, discount_percent, last_seen_at FROM a WHERE promotion_type = 'lightning' ORDER BY {_KEY}, {_ORDER})
    SELECT * FROM d ORDER BY {_ORDER} LIMIT 20""")
def deal_section(v):
    return S.deals(_active(v), "lightning").orderBy(*S.deal_order()).limit(20).select("title_key", "membership_id", "price", "discount_percent", "last_seen_at")


@query("deal_section_gated", f"""
    WITH {_ACTIVE}, {_OK}, d AS (SELECT DISTINCT ON ({_KEY}) {_KEY} AS title_key, membership_id, price, discount_percent, last_seen_at FROM a WHERE id IN (SELECT id FROM ok) ORDER BY {_KEY}, {_ORDER})
    SELECT * FROM d ORDER BY {_ORDER} LIMIT 20 OFFSET 3""")
def deal_section_gated(v):
    items = S.active_items(v.v_memberships, S.approved(v.v_processed, v.v_triage), v.v_sources)
    return S.deals(items).orderBy(*S.deal_order()).offset(3).limit(20).select("title_key", "membership_id", "price", "discount_percent", "last_seen_at")


_SUPPORTED = ("Brand#1", "Brand#2", "Brand#3", "Brand#999")


@query("brand_section", f"""
    WITH {_ACTIVE}, d AS (SELECT DISTINCT ON ({_KEY}) {_KEY} AS title_key, membership_id, price, discount_percent, last_seen_at FROM a WHERE detected_brand = 'Brand#1' ORDER BY {_KEY}, {_ORDER})
    SELECT * FROM d ORDER BY {_ORDER} LIMIT 20""")
def brand_section(v):
    return S.deals(_active(v).where("detected_brand = 'Brand#1'")).orderBy(*S.deal_order()).limit(20).select("title_key", "membership_id", "price", "discount_percent", "last_seen_at")


@query("section_total", f"WITH {_ACTIVE} SELECT promotion_type, count(DISTINCT {_KEY}) AS total FROM a GROUP BY promotion_type")
def section_total(v):
    return _active(v).groupBy("promotion_type").agg(F.count_distinct(S.title_key(F.col("normalized_title"), F.col("raw_title"))).alias("total"))


@query("brand_counts", f"""
    WITH {_ACTIVE}, n AS (SELECT detected_brand, count(DISTINCT {_KEY}) AS total FROM a GROUP BY detected_brand)
    SELECT b.place, b.slug, coalesce(n.total, 0) AS total FROM (VALUES {', '.join(f"({i}, '{b}')" for i, b in enumerate(_SUPPORTED))}) b(place, slug) LEFT JOIN n ON n.detected_brand = b.slug""")
def brand_counts(v):
    counts = _active(v).where(F.col("detected_brand").isin(*_SUPPORTED)).groupBy("detected_brand").agg(F.count_distinct(S.title_key(F.col("normalized_title"), F.col("raw_title"))).alias("total"))
    listed = v.spark.createDataFrame(list(enumerate(_SUPPORTED)), "place int, slug string")
    return listed.join(counts, F.col("slug") == F.col("detected_brand"), "left").select("place", "slug", F.coalesce("total", F.lit(0).cast("long")).alias("total")).orderBy("place")


@query("previous_offers", f"""
    WITH {_OK}, d AS (SELECT DISTINCT ON (coalesce(ok.external_id, ok.content_hash)) coalesce(ok.external_id, ok.content_hash) AS item_key, m.id AS membership_id, m.last_seen_at, ok.price, ok.discount_percent
        FROM v_memberships m JOIN ok ON ok.content_hash = m.content_hash WHERE m.source_id = 1 AND NOT m.is_active ORDER BY coalesce(ok.external_id, ok.content_hash), m.last_seen_at DESC, m.id)
    SELECT membership_id, price, discount_percent FROM (SELECT * FROM d ORDER BY item_key LIMIT 24) x WHERE price > 0""")
def previous_offers(v):
    gone = v.v_memberships.where("source_id = 1 and not is_active").select(F.col("id").alias("membership_id"), "content_hash", "last_seen_at")
    items = gone.join(S.approved(v.v_processed, v.v_triage), "content_hash").withColumn("item_key", F.coalesce("external_id", "content_hash"))
    first = C.first_rows(items, ["item_key"], [F.desc("last_seen_at"), F.col("membership_id")]).orderBy("item_key").limit(24)
    return first.where("price > 0").orderBy(F.coalesce("discount_percent", F.lit(0)).desc(), "membership_id").select("membership_id", "price", "discount_percent")


@query("deal_projection", f"""WITH {_ACTIVE} SELECT membership_id, coalesce(nullif(normalized_title, ''), nullif(raw_title, ''), 'Produto') AS title, coalesce(nullif(raw_url, ''), '') AS url, price FROM a WHERE price > 0""")
def deal_projection(v):
    return S.projected(_active(v)).select("membership_id", "title", "url", "price")


@query("triage_by_brand", "SELECT t.id, p.detected_brand, t.status FROM v_triage t JOIN v_processed p ON p.id = t.processed_id WHERE p.detected_brand ILIKE '%brand#1%' AND t.status = 'pending'")
def triage_by_brand(v):
    brands = v.v_processed.where(F.col("detected_brand").ilike("%brand#1%")).select(F.col("id").alias("processed_id"), "detected_brand")
    return v.v_triage.where("status = 'pending'").join(brands, "processed_id").select("id", "detected_brand", "status")


@query("triage_enriched", """
    SELECT t.id, p.normalized_title, p.price, s.name AS source_name FROM v_triage t LEFT JOIN v_processed p ON p.id = t.processed_id
    LEFT JOIN (SELECT content_hash, min(source_id) AS source_id FROM v_memberships GROUP BY content_hash) m ON m.content_hash = t.content_hash LEFT JOIN v_sources s ON s.id = m.source_id""")
def triage_enriched(v):
    found = v.v_processed.select(F.col("id").alias("processed_id"), "normalized_title", "price")
    where = v.v_memberships.groupBy("content_hash").agg(F.min("source_id").alias("source_id"))
    names = v.v_sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return v.v_triage.join(found, "processed_id", "left").join(where, "content_hash", "left").join(names, "source_id", "left").select("id", "normalized_title", "price", "source_name")


_SEEN = "t AS (SELECT * FROM v_triage WHERE status = 'rejected')"


@query("not_yet_triaged", f"WITH {_SEEN} SELECT p.id FROM v_processed p WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.content_hash = p.content_hash) AND NOT EXISTS (SELECT 1 FROM t WHERE t.external_id = p.external_id)")
def not_yet_triaged(v):
    return S.not_yet_triaged(v.v_processed, v.v_triage.where("status = 'rejected'")).select("id")


@query("pending_by_hash", "SELECT m.id FROM v_memberships m WHERE m.content_hash IN (SELECT content_hash FROM v_triage WHERE status = 'pending')")
def pending_by_hash(v):
    return v.v_memberships.join(v.v_triage.where("status = 'pending'").select("content_hash"), "content_hash", "left_semi").select("id")


@query("membership_stats", "SELECT source_id, count(*) AS total, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE NOT is_active) AS inactive FROM v_memberships GROUP BY source_id")
def membership_stats(v):
    return v.v_memberships.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"))


@query("last_updated", "SELECT source_id, max(finished_at) FILTER (WHERE status = 'completed') AS finished_at FROM v_batches GROUP BY source_id")
def last_updated(v):
    return v.v_batches.groupBy("source_id").agg(F.max(F.when(F.col("status") == "completed", F.col("finished_at"))).alias("finished_at"))


@query("recent_batches", "SELECT source_id, batch_no, status, total_collected FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY day DESC) AS n FROM v_batches) x WHERE n <= 3")
def recent_batches(v):
    return C.first_rows(v.v_batches, ["source_id"], [F.desc("day")], 3).select("source_id", "batch_no", "status", "total_collected")


@query("batch_summary", "SELECT source_id, count(*) AS runs, sum(total_collected)::BIGINT AS collected, count(*) FILTER (WHERE status = 'failed') AS failed FROM v_batches GROUP BY source_id")
def batch_summary(v):
    return v.v_batches.groupBy("source_id").agg(F.count(F.lit(1)).alias("runs"), F.sum("total_collected").alias("collected"), F.count_if(F.col("status") == "failed").alias("failed"))


_NOW = "timestamp '2024-01-20 00:00:00'"


@query("source_eligibility", f"""SELECT id, CASE WHEN status <> 'active' THEN 'not_active' WHEN url = 'no url' THEN 'bad_url' WHEN url LIKE 'ftp%' THEN 'bad_scheme' WHEN starts_at > {_NOW} THEN 'not_started'
    WHEN ends_at < {_NOW} THEN 'ended' WHEN source_type <> 'listing' THEN 'unsupported_provider' ELSE 'ok' END AS code FROM v_sources""")
def source_eligibility(v):
    return v.v_sources.select("id", S.eligibility(F.expr(_NOW), F.col("source_type").isin("listing")).alias("code"))


@query("validity_window", f"SELECT id FROM v_sources WHERE (starts_at IS NULL OR starts_at <= {_NOW}) AND (ends_at IS NULL OR ends_at >= {_NOW})")
def validity_window(v):
    return v.v_sources.where(f"(starts_at is null or starts_at <= {_NOW}) and (ends_at is null or ends_at >= {_NOW})").select("id")


@query("active_sources", "SELECT id, url FROM v_sources WHERE is_active AND url <> ''")
def active_sources(v):
    return v.v_sources.where("is_active and url <> ''").select("id", "url")


@query("sources_filtered", "SELECT s.id, s.name, m.name AS marketplace FROM v_sources s JOIN v_marketplaces m ON m.id = s.marketplace_id WHERE s.status = 'active' AND s.source_type = 'listing'")
def sources_filtered(v):
    names = v.v_marketplaces.select(F.col("id").alias("marketplace_id"), F.col("name").alias("marketplace"))
    return v.v_sources.where("status = 'active' and source_type = 'listing'").join(names, "marketplace_id").select("id", "name", "marketplace")


@query("active_source_count", "SELECT count(*) FILTER (WHERE status = 'active') AS active, count(*) AS listed FROM v_sources")
def active_source_count(v):
    return v.v_sources.agg(F.count_if(F.col("status") == "active").alias("active"), F.count(F.lit(1)).alias("listed"))


@query("source_status", """SELECT s.id, b.finished_at, coalesce(n.total, 0) AS total FROM v_sources s
    LEFT JOIN (SELECT source_id, max(last_seen_at) AS finished_at, count(*) AS total FROM v_memberships GROUP BY source_id) n ON n.source_id = s.id
    LEFT JOIN (SELECT source_id, max(last_seen_at) AS finished_at FROM v_memberships WHERE is_active GROUP BY source_id) b ON b.source_id = s.id""")
def source_status(v):
    stats = v.v_memberships.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.max(F.when(F.col("is_active"), F.col("last_seen_at"))).alias("finished_at"))
    return v.v_sources.join(stats, F.col("id") == F.col("source_id"), "left").select("id", "finished_at", F.coalesce("total", F.lit(0).cast("long")).alias("total"))
