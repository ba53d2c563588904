"""Scans, filters, joins and pages of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..registry import query


@query("scan_catalog", "SELECT 'brand' AS kind, slug, name FROM v_brands UNION ALL SELECT 'category', slug, name FROM v_categories UNION ALL SELECT 'marketplace', slug, name FROM v_marketplaces")
def scan_catalog(v):
    parts = [df.select(F.lit(kind).alias("kind"), "slug", "name") for kind, df in (("brand", v.v_brands), ("category", v.v_categories), ("marketplace", v.v_marketplaces))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("kind", "name")


@query("catalog_best_offers", """
    SELECT p.id, p.main_name, b.offer_id, m.name AS marketplace_name, b.original_price, b.current_price, b.discount_percent
    FROM v_products p LEFT JOIN (SELECT DISTINCT ON (product_id) product_id, id AS offer_id, marketplace_id, original_price, current_price, discount_percent FROM v_offers
        WHERE status = 'active' ORDER BY product_id, discount_percent DESC NULLS LAST, current_price ASC NULLS LAST, id) b ON b.product_id = p.id
    LEFT JOIN v_marketplaces m ON m.id = b.marketplace_id""")
def catalog_best_offers(v):
    names = v.v_marketplaces.select(F.col("id").alias("marketplace_id"), F.col("name").alias("marketplace_name"))
    joined = v.v_products.join(C.best_offers(v.v_offers), F.col("id") == F.col("product_id"), "left").join(names, "marketplace_id", "left")
    return joined.select("id", "main_name", "offer_id", "marketplace_name", "original_price", "current_price", "discount_percent").orderBy(F.col("discount_percent").desc_nulls_last(), "id")


@query("catalog_dims", "SELECT p.id, p.main_name, b.name AS brand_name, c.name AS category_name FROM v_products p LEFT JOIN v_brands b ON b.slug = p.brand_slug LEFT JOIN v_categories c ON c.slug = p.category_slug")
def catalog_dims(v):
    return C.with_dimensions(v.v_products, v.v_brands, v.v_categories).select("id", "main_name", "brand_name", "category_name")


@query("catalog_offer_counts", "SELECT p.id, count(o.id) AS offer_count FROM v_products p LEFT JOIN v_offers o ON o.product_id = p.id AND o.status = 'active' GROUP BY p.id")
def catalog_offer_counts(v):
    return v.v_products.select("id").join(C.offer_counts(v.v_offers), F.col("id") == F.col("product_id"), "left").select("id", F.coalesce("offer_count", F.lit(0).cast("long")).alias("offer_count"))


@query("products_filtered", """SELECT id, main_name, category_slug, brand_slug, catalog_status, created_at FROM v_products
    WHERE category_slug = 'ECONOMY' AND catalog_status = 'published' AND main_name LIKE '%Nike%' ORDER BY created_at DESC, id LIMIT 50 OFFSET 5""")
def products_filtered(v):
    kept = v.v_products.where(C.product_filter(category="ECONOMY", status="published", like="Nike"))
    return kept.orderBy(F.col("created_at").desc(), "id").offset(5).limit(50).select("id", "main_name", "category_slug", "brand_slug", "catalog_status", "created_at")


@query("search_like", "SELECT id, main_name FROM v_products WHERE main_name LIKE '%nike_air%' OR main_name LIKE '%Nike%Air%'")
def search_like(v):
    return v.v_products.where(C.product_filter(like="nike_air") | C.product_filter(like="Nike%Air")).select("id", "main_name")


@query("search_ilike", "SELECT id, main_name FROM v_products WHERE main_name ILIKE '%nike%' OR main_name ILIKE '%ADIDAS_MASC%'")
def search_ilike(v):
    return v.v_products.where(C.product_filter(ilike="nike") | C.product_filter(ilike="ADIDAS_MASC")).select("id", "main_name")


@query("min_discount", "SELECT id, discount_percent, discount_percent >= 30 AS above_floor FROM v_offers WHERE discount_percent >= 25")
def min_discount(v):
    return v.v_offers.where("discount_percent >= 25").select("id", "discount_percent", (F.col("discount_percent") >= 30).alias("above_floor"))


@query("valid_price", "SELECT id, normalized_title, price FROM v_processed WHERE normalized_title <> '' AND price > 0")
def valid_price(v):
    return v.v_processed.where("normalized_title <> '' and price > 0").select("id", "normalized_title", "price")


@query("discounted_products", "SELECT id, main_name, discount_percent FROM v_catalog WHERE offer_id IS NOT NULL AND discount_percent > 0")
def discounted_products(v):
    return v.v_catalog.where("offer_id is not null and discount_percent > 0").select("id", "main_name", "discount_percent").orderBy(F.desc("discount_percent"), "id")


@query("brand_in_list", "SELECT id, brand_slug FROM v_products WHERE brand_slug IN ('Brand#1', 'Brand#3', 'Brand#17')")
def brand_in_list(v):
    return v.v_products.where(F.col("brand_slug").isin("Brand#1", "Brand#3", "Brand#17")).select("id", "brand_slug")


@query("product_detail", """
    SELECT p.id, p.main_name, b.name AS brand_name, c.name AS category_name, count(o.id) AS n_offers, first(o.id ORDER BY o.last_seen_at DESC, o.id) AS newest_offer, min(o.current_price) AS lowest_price
    FROM v_products p LEFT JOIN v_brands b ON b.slug = p.brand_slug LEFT JOIN v_categories c ON c.slug = p.category_slug LEFT JOIN v_offers o ON o.product_id = p.id AND o.status = 'active'
    GROUP BY ALL""")
def product_detail(v):
    return _detail(C.product_detail(C.with_dimensions(v.v_products, v.v_brands, v.v_categories), v.v_offers))


def _detail(nested):
    return nested.select("id", "main_name", "brand_name", "category_name", F.coalesce(F.when(F.col("offers").isNotNull(), F.size("offers")), F.lit(0)).cast("long").alias("n_offers"), F.get("offers", F.lit(0)).offer_id.alias("newest_offer"), F.array_min(F.transform("offers", lambda o: o.current_price)).alias("lowest_price"))


@query("catalog_total", "SELECT count(*) AS total FROM v_products WHERE catalog_status = 'published' AND main_name ILIKE '%tênis%'")
def catalog_total(v):
    return v.v_products.where(C.product_filter(status="published", ilike="tênis")).agg(F.count(F.lit(1)).alias("total"))


@query("catalog_page", """
    SELECT p.id, p.main_name, b.name AS brand_name, c.name AS category_name, coalesce(n.offer_count, 0) AS offer_count, o.discount_percent,
           CASE WHEN o.current_price IS NULL THEN '-' ELSE 'R$ ' || replace(CAST(o.current_price AS string), '.', ',') END AS price_label
    FROM v_products p LEFT JOIN v_brands b ON b.slug = p.brand_slug LEFT JOIN v_categories c ON c.slug = p.category_slug LEFT JOIN v_best o ON o.product_id = p.id
    LEFT JOIN (SELECT product_id, count(*) AS offer_count FROM v_offers WHERE status = 'active' GROUP BY 1) n ON n.product_id = p.id
    WHERE p.catalog_status = 'published' ORDER BY o.discount_percent DESC NULLS LAST, p.created_at DESC, p.id LIMIT 5000""")
def catalog_page(v):
    df = C.with_offers(C.with_dimensions(v.v_products.where("catalog_status = 'published'"), v.v_brands, v.v_categories), v.v_offers)
    ordered = df.orderBy(F.col("discount_percent").desc_nulls_last(), F.desc("created_at"), "id").limit(5000)
    return ordered.select("id", "main_name", "brand_name", "category_name", "offer_count", "discount_percent", C.labels_brl(F.col("current_price")).alias("price_label"))


_RANKED = "SELECT *, row_number() OVER (ORDER BY discount_percent DESC NULLS LAST, created_at DESC, id) AS api_rank FROM v_catalog"


@query("sort_modes_top", f"""
    WITH r AS ({_RANKED}) SELECT * FROM (
      SELECT 'highest_discount' AS mode, id, row_number() OVER (ORDER BY discount_percent DESC NULLS LAST, api_rank) AS place FROM r UNION ALL
      SELECT 'relevance', id, row_number() OVER (ORDER BY api_rank) FROM r UNION ALL
      SELECT 'lowest_price', id, row_number() OVER (ORDER BY current_price ASC NULLS LAST, api_rank) FROM r UNION ALL
      SELECT 'most_recent', id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, api_rank) FROM r) x WHERE place <= 40""")
def sort_modes_top(v):
    out = None
    base = [F.col("discount_percent").desc_nulls_last(), F.desc("created_at"), F.col("id")]
    for mode in C.SORTS:
        keys = C.sort_keys(mode)
        first = v.v_catalog.orderBy(*keys, *base).limit(40)
        part = first.select(F.lit(mode).alias("mode"), "id", F.row_number().over(Window.orderBy(*keys, *base)).cast("long").alias("place"))  # 40 rows
        out = part if out is None else out.unionByName(part)
    return out


@query("sort_modes", f"""
    WITH r AS ({_RANKED})
      SELECT 'highest_discount' AS mode, id, row_number() OVER (ORDER BY discount_percent DESC NULLS LAST, api_rank) AS place FROM r UNION ALL
      SELECT 'relevance', id, row_number() OVER (ORDER BY api_rank) FROM r UNION ALL
      SELECT 'lowest_price', id, row_number() OVER (ORDER BY current_price ASC NULLS LAST, api_rank) FROM r UNION ALL
      SELECT 'most_recent', id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, api_rank) FROM r""")
def sort_modes(v):
    base = [F.col("discount_percent").desc_nulls_last(), F.desc("created_at"), F.col("id")]
    narrow = C.staged(v.v_catalog.select("id", "discount_percent", "current_price", "created_at"), "sort-keys")  # the view is read once
    parts = [C.placed(narrow, [*C.sort_keys(mode), *base]).select(F.lit(mode).alias("mode"), "id", "place") for mode in C.SORTS]
    return reduce(DataFrame.unionByName, parts)


@query("pagination", """
    WITH f AS (SELECT id, discount_percent, current_price FROM v_catalog ORDER BY discount_percent DESC NULLS LAST, id LIMIT 20 OFFSET 40)
    SELECT id, discount_percent, (SELECT CAST(ceil(count(*) / 20.0) AS bigint) FROM v_catalog) AS pages FROM f WHERE current_price > 0""")
def pagination(v):
    rows = C.page(v.v_catalog, [F.col("discount_percent").desc_nulls_last(), F.col("id")], 3, 20).where("current_price > 0")
    pages = v.v_catalog.agg(C.page_count(F.count(F.lit(1)), 20).alias("pages"))
    return rows.join(F.broadcast(pages)).select("id", "discount_percent", "pages")  # one row of totals


@query("triage_order_top", "SELECT id, priority, created_at FROM v_triage ORDER BY priority DESC, created_at, id LIMIT 100")
def triage_order_top(v):
    return v.v_triage.orderBy(F.col("priority").desc_nulls_first(), F.col("created_at").asc_nulls_last(), "id").limit(100).select("id", "priority", "created_at")


@query("triage_order", "SELECT id, priority, created_at, row_number() OVER (ORDER BY priority DESC NULLS FIRST, created_at ASC NULLS LAST, id) AS place FROM v_triage")
def triage_order(v):
    return C.placed(v.v_triage, [F.col("priority").desc_nulls_first(), F.col("created_at").asc_nulls_last(), F.col("id")]).select("id", "priority", "created_at", "place")


@query("source_order", "SELECT id, name, priority, starts_at, row_number() OVER (ORDER BY priority DESC NULLS FIRST, starts_at ASC NULLS LAST, name, id) AS place FROM v_sources")
def source_order(v):
    order = [F.col("priority").desc_nulls_first(), F.col("starts_at").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("id")]
    return C.placed(v.v_sources, order).select("id", "name", "priority", "starts_at", "place")


@query("collected_order_top", "SELECT id, discount_percent, quantity FROM v_processed ORDER BY coalesce(discount_percent, 0) DESC, coalesce(quantity, 0) DESC, id LIMIT 200")
def collected_order_top(v):
    return v.v_processed.orderBy(F.coalesce("discount_percent", F.lit(0)).desc(), F.coalesce("quantity", F.lit(0)).desc(), "id").limit(200).select("id", "discount_percent", "quantity")


@query("collected_order", "SELECT id, discount_percent, quantity, row_number() OVER (ORDER BY coalesce(discount_percent, 0) DESC, coalesce(quantity, 0) DESC, id) AS place FROM v_processed")
def collected_order(v):
    order = [F.coalesce("discount_percent", F.lit(0)).desc(), F.coalesce("quantity", F.lit(0)).desc(), F.col("id")]
    return C.placed(v.v_processed, order).select("id", "discount_percent", "quantity", "place")


@query("review_sorts_top", """
    SELECT * FROM (SELECT 'discount' AS mode, id FROM v_processed ORDER BY coalesce(discount_percent, 0) DESC, id LIMIT 30) UNION ALL
    SELECT * FROM (SELECT 'reviews', id FROM v_processed ORDER BY coalesce(quantity, 0) DESC, id LIMIT 30) UNION ALL
    SELECT * FROM (SELECT 'price', id FROM v_processed ORDER BY price ASC NULLS LAST, id LIMIT 30)""")
def review_sorts_top(v):
    modes = {"discount": F.coalesce("discount_percent", F.lit(0)).desc(), "reviews": F.coalesce("quantity", F.lit(0)).desc(), "price": F.col("price").asc_nulls_last()}
    parts = [v.v_processed.orderBy(key, "id").limit(30).select(F.lit(mode).alias("mode"), "id") for mode, key in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("review_sorts", """
    SELECT 'discount' AS mode, id, row_number() OVER (ORDER BY coalesce(discount_percent, 0) DESC, id) AS place FROM v_processed UNION ALL
    SELECT 'reviews', id, row_number() OVER (ORDER BY coalesce(quantity, 0) DESC, id) FROM v_processed UNION ALL
    SELECT 'price', id, row_number() OVER (ORDER BY price ASC NULLS LAST, id) FROM v_processed""")
def review_sorts(v):
    modes = {"discount": F.coalesce("discount_percent", F.lit(0)).desc(), "reviews": F.coalesce("quantity", F.lit(0)).desc(), "price": F.col("price").asc_nulls_last()}
    narrow = C.staged(v.v_processed.select("id", "discount_percent", "quantity", "price"), "review-keys")
    parts = [C.placed(narrow, [key, F.col("id")]).select(F.lit(mode).alias("mode"), "id", "place") for mode, key in modes.items()]
    return reduce(DataFrame.unionByName, parts)


@query("top_products", "SELECT id, discount_percent, row_number() OVER (ORDER BY discount_percent DESC NULLS LAST, id) AS place FROM v_catalog ORDER BY discount_percent DESC NULLS LAST, id LIMIT 16")
def top_products(v):
    order = [F.col("discount_percent").desc_nulls_last(), F.col("id")]
    first = v.v_catalog.orderBy(*order).limit(16)
    return first.select("id", "discount_percent", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # 16 rows


@query("image_order", """
    SELECT product_id, string_agg(url, '|' ORDER BY sort_order, url) AS images FROM
      (SELECT product_id, 'https://img.example.test/' || CAST(marketplace_id AS string) AS url, marketplace_id % 5 AS sort_order FROM (SELECT DISTINCT product_id, marketplace_id FROM v_offers) d) i GROUP BY product_id""")
def image_order(v):
    images = v.v_offers.select("product_id", "marketplace_id").distinct().select("product_id", F.struct((F.col("marketplace_id") % 5).alias("sort_order"), F.concat(F.lit("https://img.example.test/"), F.col("marketplace_id").cast("string")).alias("url")).alias("image"))
    nested = images.groupBy("product_id").agg(F.array_sort(F.collect_list("image")).alias("images"))
    return nested.select("product_id", F.array_join(F.transform("images", lambda x: x.url), "|").alias("images"))


@query("favorites_list", """
    SELECT f.user_id, f.product_id, f.created_at, p.main_name, b.name AS brand_name, o.current_price, m.name AS marketplace_name
    FROM v_favorites f JOIN v_products p ON p.id = f.product_id LEFT JOIN v_brands b ON b.slug = p.brand_slug
    LEFT JOIN (SELECT DISTINCT ON (product_id) product_id, marketplace_id, current_price FROM v_offers WHERE status = 'active' ORDER BY product_id, current_price NULLS LAST, last_seen_at DESC, id) o ON o.product_id = p.id
    LEFT JOIN v_marketplaces m ON m.id = o.marketplace_id""")
def favorites_list(v):
    cheapest = C.first_rows(v.v_offers.where("status = 'active'"), ["product_id"], [F.col("current_price").asc_nulls_last(), F.desc("last_seen_at"), F.col("id")]).select("product_id", "marketplace_id", "current_price")
    names = v.v_marketplaces.select(F.col("id").alias("marketplace_id"), F.col("name").alias("marketplace_name"))
    products = v.v_products.select(F.col("id").alias("product_id"), "main_name", "brand_slug")
    brands = v.v_brands.select(F.col("slug").alias("brand_slug"), F.col("name").alias("brand_name"))
    joined = v.v_favorites.join(products, "product_id").join(brands, "brand_slug", "left").join(cheapest, "product_id", "left").join(names, "marketplace_id", "left")
    return joined.select("user_id", "product_id", "created_at", "main_name", "brand_name", "current_price", "marketplace_name")


@query("popular_searches", "SELECT query, count(*) AS n FROM v_searches GROUP BY query ORDER BY n DESC, query LIMIT 20")
def popular_searches(v):
    return v.v_searches.groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query("click_log", "SELECT c.id, c.offer_key, c.clicked_at, o.id AS offer_id FROM v_clicks c JOIN v_best b ON b.product_id = c.offer_key JOIN v_offers o ON o.id = b.offer_id WHERE o.affiliate_url IS NOT NULL")
def click_log(v):
    best = C.best_offers(v.v_offers).select(F.col("product_id").alias("offer_key"), "offer_id")
    linked = v.v_offers.where("affiliate_url is not null").select(F.col("id").alias("offer_id"))
    return v.v_clicks.join(best, "offer_key").join(linked, "offer_id", "left_semi").select("id", "offer_key", "clicked_at", "offer_id")


@query("search_log", "SELECT session_id, query, count(*) AS n, min(searched_at) AS first_at FROM v_searches GROUP BY session_id, query")
def search_log(v):
    return v.v_searches.groupBy("session_id", "query").agg(F.count(F.lit(1)).alias("n"), F.min("searched_at").alias("first_at"))
