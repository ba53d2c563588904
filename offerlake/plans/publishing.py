"""Queries of the rows that publishing, review, deletion and registries make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascades as D
from ..operators import maintenance as H
from ..operators import pages as P
from ..operators import publishing as B
from ..operators.registries import Collectors, Criteria
from ..registry import query
from .attributes import BRAND_SQL, normal_sql
from .pages import _PARSED
from .runs import _CATEGORY_SQL, _ROUTED
from .sections import _NOW

PARAMETERS = "tool=1&word="


def _key(kind: str, *parts: str) -> str:
    return f"substring(sha256('{kind}:' || {(chr(39) + ':' + chr(39)).join(parts)}), 1, 32)"


_SEEN = "status = 'rejected' AND CAST(substring(external_id, 4) AS bigint) % 5 = 0"
_MADE = f"""{_ROUTED.replace('v_items', 'v_fresh_items').replace("status = 'rejected'", _SEEN)}, made AS (SELECT * REPLACE ({_key('product', 'content_hash')} AS product_id), {_key('offer', 'content_hash')} AS offer_id FROM routed WHERE passes)"""


def _published(v) -> B.Published:
    return B.published(v.v_fresh_items, v.v_triage.where(_SEEN), v.v_sources, PARAMETERS)


@query("published_products", f"""WITH {_MADE} SELECT product_id AS id, title AS main_name, substring(replace(plain, ' ', '-'), 1, 80) || '-' || content_hash AS slug, replace({BRAND_SQL.replace('main_name', 'title')}, ' ', '-') AS brand_slug,
    {_CATEGORY_SQL.replace('main_name', 'title')} AS main_category_slug, image AS main_image_url, 'published' AS catalog_status, title AS short_description, NULL::VARCHAR AS section FROM made""")
def published_products(v):
    return _published(v).products


@query("published_offers", f"""WITH {_MADE} SELECT offer_id AS id, product_id, 1::BIGINT AS marketplace_id, price AS current_price, original_price, discount AS discount_percent, url AS original_url, url || '?{PARAMETERS}' AS affiliate_url, free_shipping, external_id, 'active' AS status FROM made""")
def published_offers(v):
    return _published(v).offers


@query("published_images", f"WITH {_MADE} SELECT {_key('image', 'product_id')} AS id, product_id, image AS url, title AS alt, 0 AS sort_order, true AS is_primary FROM made WHERE image <> ''")
def published_images(v):
    return _published(v).images


@query("published_triage", f"""WITH {_MADE} SELECT {_key('triage', 'content_hash')} AS id, content_hash AS processed_id, CASE WHEN passes THEN 'approved' ELSE 'pending' END AS status, CASE WHEN discount >= 20 THEN 1 ELSE 0 END AS priority,
    CASE WHEN NOT passes THEN source_id END AS collection_source_id,
    CASE WHEN passes THEN 'Auto-aprovado: ' || coalesce(named, '') || ' (' || CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '% confiança)' ELSE 'Coleta automática: ' || coalesce(s.name, '') END AS admin_notes,
    CASE WHEN passes THEN 'system' END AS approved_by, passes AS auto_approved, CASE WHEN passes THEN decision END AS auto_approved_reason, named AS brand_detected, confidence AS brand_confidence, CASE WHEN NOT passes THEN issues END AS issues,
    CASE WHEN passes THEN {_key('product', 'content_hash')} END AS product_id
    FROM routed r LEFT JOIN v_sources s ON s.id = r.source_id""")
def published_triage(v):
    return _published(v).triage


# Two decisions on every third row and three on every fifteenth; half of the later ones turn the first around.
_REVIEW = f"""base AS (SELECT 't' || id AS triage_id, quantity, product_id FROM v_processed),
    d AS (SELECT triage_id || '/' || n AS decision_id, timestamp '2024-02-01 00:00:00' + to_minutes(CAST((n * 7) % 10 AS INT)) AS stamp, triage_id, CASE WHEN (quantity + n) % 5 < 3 THEN 'approve' ELSE 'reject' END AS action,
                 CASE WHEN quantity % 7 = 0 THEN 'Nome Novo ' || product_id WHEN quantity % 7 = 1 THEN '' END AS name, CASE WHEN quantity % 6 = 0 THEN 'marca-' || n END AS brand, CASE WHEN quantity % 8 = 0 THEN 'categoria' END AS category,
                 CASE WHEN quantity % 2 = 0 THEN 'foto ruim' WHEN quantity % 9 = 1 THEN '' END AS reason
          FROM base, range(0, 3) r(n) WHERE n = 0 OR quantity % 3 = 0 AND n = 1 OR quantity % 15 = 0),
    told AS (SELECT d.*, p.normalized_title, p.detected_brand, p.detected_category, p.promotion_type, p.price, p.original_price, p.discount_percent, p.free_shipping, p.external_id, t.suggested, p.image, p.url
             FROM d JOIN (SELECT id, processed_id, CASE WHEN priority = 1 THEN 'sugerida' END AS suggested FROM v_triage) t ON t.id = d.triage_id
             JOIN (SELECT *, CASE WHEN quantity % 4 <> 1 THEN 'https://img.example.test/' || product_id || '.jpg' END AS image, 'https://shop.example.test/p/' || product_id AS url FROM v_processed) p ON p.id = t.processed_id),
    marked AS (SELECT *, row_number() OVER (PARTITION BY triage_id ORDER BY stamp DESC, decision_id DESC) = 1 AS effective FROM told),
    made AS (SELECT *, {_key('reviewed-product', 'triage_id')} AS pid, {_key('reviewed-offer', 'triage_id')} AS oid, coalesce(nullif(name, ''), normalized_title) AS full_name FROM marked WHERE effective AND action = 'approve')"""


def _reviewed(v) -> B.Reviewed:
    q, n = F.col("quantity"), F.col("n")
    base = v.v_processed.select(F.concat(F.lit("t"), "id").alias("triage_id"), "quantity", "product_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
    base = base.where((n == 0) | ((q % 3 == 0) & (n == 1)) | (q % 15 == 0))
    minute = F.expr("timestamp '2024-02-01 00:00:00' + make_interval(0, 0, 0, 0, 0, (n * 7) % 10, 0)")
    decisions = base.select(
        F.concat("triage_id", F.lit("/"), n.cast("string")).alias("decision_id"), minute.alias("at"), "triage_id", F.when((q + n) % 5 < 3, "approve").otherwise("reject").alias("action"),
        F.when(q % 7 == 0, F.concat(F.lit("Nome Novo "), F.col("product_id").cast("string"))).when(q % 7 == 1, "").alias("name"), F.when(q % 6 == 0, F.concat(F.lit("marca-"), n.cast("string"))).alias("brand"),
        F.when(q % 8 == 0, "categoria").alias("category"), F.when(q % 2 == 0, "foto ruim").when(q % 9 == 1, "").alias("reason"),
    )
    suggested = F.when(F.col("priority") == 1, "sugerida")
    triage = v.v_triage.select("id", "processed_id", suggested.alias("suggested_brand"), suggested.alias("suggested_category"))
    link = lambda head, tail: F.concat(F.lit(head), F.col("product_id").cast("string"), F.lit(tail))
    processed = v.v_processed.select(
        "id", "normalized_title", "detected_brand", "detected_category", "promotion_type", "price", "original_price", F.col("discount_percent").alias("discount"), "free_shipping", "external_id",
        F.when(q % 4 != 1, link("https://img.example.test/", ".jpg")).alias("image"), link("https://shop.example.test/p/", "").alias("url"), link("https://shop.example.test/p/", "").alias("affiliate_url"),
    )
    return B.reviewed(triage, processed, decisions)


@query("reviewed_products", f"""WITH {_REVIEW} SELECT pid AS id, full_name AS main_name, substring(replace({normal_sql('full_name')}, ' ', '-'), 1, 100) || '-' || triage_id AS slug, coalesce(nullif(brand, ''), suggested, detected_brand) AS brand_slug,
    coalesce(nullif(category, ''), suggested, detected_category) AS main_category_slug, image AS main_image_url, 'published' AS catalog_status, full_name AS short_description,
    CASE promotion_type WHEN 'lightning' THEN 'relampago' WHEN 'deal_of_day' THEN 'dia' WHEN 'general' THEN 'geral' END AS section FROM made""")
def reviewed_products(v):
    return _reviewed(v).products


@query("reviewed_offers", f"WITH {_REVIEW} SELECT oid AS id, pid AS product_id, 1::BIGINT AS marketplace_id, price AS current_price, original_price, discount_percent, url AS original_url, url AS affiliate_url, free_shipping, external_id, 'active' AS status FROM made")
def reviewed_offers(v):
    return _reviewed(v).offers


@query("reviewed_images", f"WITH {_REVIEW} SELECT {_key('image', 'pid')} AS id, pid AS product_id, image AS url, full_name AS alt, 0 AS sort_order, true AS is_primary FROM made WHERE image <> ''")
def reviewed_images(v):
    return _reviewed(v).images


@query("reviewed_statuses", f"WITH {_REVIEW} SELECT t.id, coalesce(CASE m.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' END, t.status) AS status FROM v_triage t LEFT JOIN marked m ON m.triage_id = t.id AND m.effective")
def reviewed_statuses(v):
    return B.with_statuses(v.v_triage.select("id", "status"), _reviewed(v).statuses)


@query("review_audit", f"""WITH {_REVIEW} SELECT {_key('action', 'decision_id')} AS id, triage_id, action, stamp AS at, effective, CASE WHEN action = 'reject' THEN coalesce(nullif(reason, ''), 'Rejeitado em lote') END AS rejection_reason,
    CASE WHEN effective AND action = 'approve' THEN {_key('reviewed-product', 'triage_id')} END AS result_product_id, CASE WHEN effective AND action = 'approve' THEN {_key('reviewed-offer', 'triage_id')} END AS result_offer_id FROM marked""")
def review_audit(v):
    return _reviewed(v).audit.withColumn("at", F.col("at").cast("timestamp_ntz"))


_GONE = """p AS (SELECT id FROM v_products WHERE id % 10 = 0), u AS (SELECT DISTINCT user_id AS id FROM v_favorites WHERE user_id % 9 = 0),
    gone AS (SELECT 'products' AS table_name, id::VARCHAR AS row_key FROM p UNION ALL SELECT 'users', id::VARCHAR FROM u
        UNION ALL SELECT 'product_images', i.id::VARCHAR FROM v_products i JOIN p USING (id) WHERE i.main_image_url IS NOT NULL
        UNION ALL SELECT 'product_colors', c.product_id::VARCHAR FROM v_colors c JOIN p ON p.id = c.product_id
        UNION ALL SELECT 'user_favorites', f.user_id || '/' || f.product_id FROM v_favorites f WHERE f.product_id IN (SELECT id FROM p) OR f.user_id IN (SELECT id FROM u))"""


def _tables(v):
    users = v.v_favorites.select(F.col("user_id").alias("id")).distinct()
    images = v.v_products.where("main_image_url is not null").select(F.col("id").alias("image_id"), F.col("id").alias("product_id"))
    return {"products": v.v_products.select("id"), "users": users, "product_images": images, "product_colors": v.v_colors.select("product_id"), "user_favorites": v.v_favorites.select("user_id", "product_id"), "offers": v.v_offers.select("id", "product_id")}


_KEYS = {"products": "id", "users": "id"}


@query("cascade_deletions", f"WITH {_GONE} SELECT * FROM gone")
def cascade_deletions(v):
    tables = _tables(v)
    gone = D.deletions(tables, _KEYS, D.RETAIL, {"products": tables["products"].where("id % 10 = 0"), "users": tables["users"].where("id % 9 = 0")})
    keys = {"products": ["id"], "users": ["id"], "product_images": ["image_id"], "product_colors": ["product_id"], "user_favorites": ["user_id", "product_id"]}
    told = [rows.select(F.lit(name).alias("table_name"), F.concat_ws("/", *[F.col(c).cast("string") for c in keys[name]]).alias("row_key")) for name, rows in gone.items()]
    out = told[0]
    for rows in told[1:]:
        out = out.unionByName(rows)
    return out


@query("cascade_held_back", "SELECT DISTINCT p.id FROM v_products p JOIN v_offers o ON o.product_id = p.id WHERE p.id % 10 = 0")
def cascade_held_back(v):
    tables = _tables(v)
    return D.held_back(tables, _KEYS, D.RETAIL, {"products": tables["products"].where("id % 10 = 0")})["products"]


_STAMP = "timestamp '2024-03-01 00:00:00'"


@query("patched_products", f"SELECT id, CASE WHEN id % 4 = 0 THEN 'novo ' || id ELSE main_name END AS main_name, CASE WHEN id % 6 = 0 THEN 'draft' ELSE catalog_status END AS catalog_status, CASE WHEN id % 4 = 0 OR id % 6 = 0 THEN {_STAMP} ELSE created_at END AS updated_at FROM v_products")
def patched_products(v):
    patch = v.v_products.where("id % 4 = 0 or id % 6 = 0").select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("novo "), F.col("id").cast("string"))).alias("main_name"), F.when(F.col("id") % 6 == 0, "draft").alias("catalog_status"))
    return H.patched(v.v_products.select("id", "main_name", "catalog_status", F.col("created_at").alias("updated_at")), patch, ["id"], F.expr(_STAMP))


@query("patched_offers", f"SELECT id, CASE WHEN product_id % 5 = 0 THEN 'expired' ELSE status END AS status, free_shipping, CASE WHEN product_id % 5 = 0 THEN {_STAMP} ELSE last_seen_at END AS updated_at FROM v_offers")
def patched_offers(v):
    patch = v.v_offers.where("product_id % 5 = 0").select("id", F.lit("expired").alias("status"), F.lit(None).cast("boolean").alias("free_shipping"))
    return H.patched(v.v_offers.select("id", "status", "free_shipping", F.col("last_seen_at").alias("updated_at")), patch, ["id"], F.expr(_STAMP))


@query("patched_sources", f"SELECT id, name, CASE WHEN id % 3 = 1 THEN 'ended' ELSE status END AS status, priority, CASE WHEN id % 3 = 1 THEN {_STAMP} END AS updated_at FROM v_sources")
def patched_sources(v):
    patch = v.v_sources.where("id % 3 = 1").select("id", F.lit("ended").alias("status"))
    return H.patched(v.v_sources.select("id", "name", "status", "priority", F.lit(None).cast("timestamp_ntz").alias("updated_at")), patch, ["id"], F.expr(_STAMP))


def _collectors() -> Collectors:
    known = Collectors()
    known.register(["Listing ", "list"], lambda pages: P.parsed_cards(pages))
    known.register(["grid"], lambda pages: P.parsed_cards(pages, least_discount=None, derive=False))
    return known


_PROVIDERS = "CASE source_id % 3 WHEN 0 THEN ' LISTING' WHEN 1 THEN 'Grid ' ELSE 'loja' END"


@query("collected_by_provider", f"""{_PARSED},
    gg AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_no, coalesce(external_id, content_hash) ORDER BY position) AS nth FROM (SELECT h.*, g.content_hash FROM h JOIN g USING (source_id, page_no, position)) x)
    SELECT source_id, page_no, position, title, content_hash FROM parsed WHERE source_id % 3 = 0 UNION ALL SELECT source_id, page_no, position, title, content_hash FROM gg WHERE nth = 1 AND source_id % 3 = 1""")
def collected_by_provider(v):
    pages = v.v_listing_pages.withColumn("provider", F.expr(_PROVIDERS))
    return _collectors().collected(pages, ["source_id", "page_no", "position", "title", "content_hash"])


@query("collectable_by_provider", f"""SELECT id, CASE WHEN status <> 'active' THEN 'not_active' WHEN url = 'no url' THEN 'bad_url' WHEN url LIKE 'ftp%' THEN 'bad_scheme' WHEN starts_at > {_NOW} THEN 'not_started'
    WHEN ends_at < {_NOW} THEN 'ended' WHEN id % 3 = 2 OR id % 3 = 0 AND id % 2 = 0 THEN 'unsupported_provider' ELSE 'ok' END AS code FROM v_sources""")
def collectable_by_provider(v):
    provider = F.expr("CASE id % 3 WHEN 0 THEN CASE id % 2 WHEN 0 THEN NULL ELSE ' LISTING' END WHEN 1 THEN 'Grid ' ELSE 'loja' END")
    return _collectors().collectable(v.v_sources.withColumn("provider", provider), F.expr(_NOW)).select("id", "code")


@query("criteria_scores", """WITH s AS (SELECT id AS subject, 'price' AS c, CASE WHEN current_price IS NOT NULL THEN least(100.0, current_price::DOUBLE / 20) END AS score FROM v_catalog
        UNION ALL SELECT id, 'rating', average_rating::DOUBLE * 20 FROM v_catalog UNION ALL SELECT id, 'reviews', least(100.0, total_reviews / 10.0)::DOUBLE FROM v_catalog UNION ALL SELECT id, 'unknown', 50.0 FROM v_catalog),
    w AS (SELECT subject, CASE WHEN c = 'price' THEN 100 - score ELSE score END AS value, CASE c WHEN 'price' THEN 0.5 WHEN 'rating' THEN 0.3 ELSE 0.2 END::DOUBLE AS weight FROM s WHERE score IS NOT NULL AND c <> 'unknown')
    SELECT subject, sum(value * weight) / sum(weight) AS score, count(*) AS criteria FROM w GROUP BY subject""")
def criteria_scores(v):
    known = Criteria()
    known.register("price", "Preço", 0.5, higher_is_better=False)
    known.register("rating", "Avaliação", 0.3)
    known.register("reviews", "Avaliações", 0.2)
    told = F.array(
        F.struct(F.lit("price").alias("criterion_id"), F.least(F.lit(100.0), F.col("current_price").cast("double") / 20).alias("score")), F.struct(F.lit("rating").alias("criterion_id"), (F.col("average_rating").cast("double") * 20).alias("score")),
        F.struct(F.lit("reviews").alias("criterion_id"), F.least(F.lit(100.0), F.col("total_reviews") / 10).alias("score")), F.struct(F.lit("unknown").alias("criterion_id"), F.lit(50.0).alias("score")),
    )
    priced = F.when(F.col("x.criterion_id") != "price", True).otherwise(F.col("current_price").isNotNull())
    long = v.v_catalog.select(F.col("id").alias("subject"), "current_price", F.explode(told).alias("x")).select("subject", "x.criterion_id", F.when(priced, F.col("x.score")).alias("score"))
    return known.weighted(long)
