"""Queries of listing pages. Their SQL reads the values that the pages were written from, never the pages' markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import pages as P
from ..registry import query

# The card hash, as the 31-multiplier string hash.
_HASH = """printf('%08x', CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END)"""
_SUM = "list_reduce(list_prepend(0::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(lower(trim(title)) || '::' || CAST(CAST(current_price AS DECIMAL(18, 2)) AS VARCHAR), '')]), lambda h, c: (h * 31 + c) & 4294967295)"
_PARSED = f"""
    WITH h AS (SELECT *, {_SUM} AS h FROM v_cards WHERE current_price > 0),
    g AS (SELECT *, {_HASH} AS content_hash, CASE WHEN coalesce(discount_percent, 0) <> 0 THEN discount_percent
             WHEN original_price > current_price THEN CAST(floor((1 - current_price::DOUBLE / original_price::DOUBLE) * 100 + 0.5) AS INT) END AS discount FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_no, coalesce(external_id, content_hash) ORDER BY position) AS nth FROM g WHERE discount >= 25),
    parsed AS (SELECT * FROM n WHERE nth = 1)"""
_FIELDS = """source_id, page_no, position, title, url, external_id, image, current_price::DOUBLE AS price, original_price::DOUBLE AS original_price, discount, coalesce(brand, 'N/A') AS brand,
    average_rating::DOUBLE AS rating, total_reviews::INT AS reviews, coalesce(free_shipping, false) AS free_shipping, '' AS installments, promotion AS promotion_type, content_hash"""


@query("parse_listing_cards", f"{_PARSED} SELECT {_FIELDS} FROM parsed")
def parse_listing_cards(v):
    return P.parsed_cards(v.v_listing_pages)


@query("parse_offer_grid", f"""
    WITH h AS (SELECT *, {_SUM} AS h FROM v_cards WHERE current_price > 0), g AS (SELECT *, {_HASH} AS content_hash, discount_percent AS discount FROM h),
    n AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_no, coalesce(external_id, content_hash) ORDER BY position) AS nth FROM g)
    SELECT {_FIELDS} FROM n WHERE nth = 1""")
def parse_offer_grid(v):
    return P.parsed_cards(v.v_listing_pages, least_discount=None, derive=False)


@query("parse_brand_store", f"""
    WITH c AS (SELECT *, page_no % 3 AS kind, CASE WHEN page_no % 3 = 0 THEN current_price::DOUBLE ELSE floor(current_price)::DOUBLE END AS price, CASE WHEN page_no % 3 = 0 THEN coalesce(original_price, current_price)::DOUBLE ELSE floor(original_price)::DOUBLE END AS old
               FROM v_cards WHERE current_price > 0 AND length(title) >= 5 AND (page_no % 3 <> 0 OR external_id IS NOT NULL)),
    h AS (SELECT * REPLACE (CAST(price AS DECIMAL(18, 2)) AS current_price) FROM c), g AS (SELECT *, {_SUM} AS h FROM h), k AS (SELECT *, {_HASH} AS content_hash FROM g WHERE price > 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY source_id, page_no, CASE WHEN kind = 0 THEN content_hash ELSE coalesce(external_id, content_hash) END ORDER BY position) AS nth FROM k)
    SELECT source_id, page_no, CASE kind WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 5 END AS tried, position, title, url, external_id, price, old AS original_price,
           CASE WHEN kind = 0 THEN nullif(discount_percent, 0) ELSE coalesce(nullif(discount_percent, 0), CASE WHEN old > price THEN CAST(floor((old - price) / old * 100 + 0.5) AS INT) END) END AS discount, coalesce(free_shipping, false) AS free_shipping, content_hash
    FROM n WHERE nth = 1""")
def parse_brand_store(v):
    return P.store_items(v.v_store_pages)


_AUDIT = f"""{_PARSED},
    r AS (SELECT source_id, page_no, count(*)::INT AS raw_cards FROM v_cards GROUP BY ALL), q AS (SELECT source_id, page_no, count(*)::INT AS parsed_cards, list(content_hash ORDER BY position)[1:5] AS signature FROM parsed GROUP BY ALL),
    audit AS (SELECT s.source_id, s.page_no, length(l.html) < 5000 AS blocked, s.kind = 'empty' AS empty_state, s.has_next, coalesce(r.raw_cards, 0) AS raw_cards, coalesce(q.parsed_cards, 0) AS parsed_cards,
                     CASE WHEN coalesce(r.raw_cards, 0) = 0 AND s.kind <> 'empty' THEN 'unrecognised_markup' END AS error, q.signature
              FROM v_page_slots s JOIN v_listing_pages l USING (source_id, page_no) LEFT JOIN r USING (source_id, page_no) LEFT JOIN q USING (source_id, page_no))"""


@query("page_audit", f"{_AUDIT} SELECT * EXCLUDE (signature) FROM audit")
def page_audit(v):
    return P.audited(v.v_listing_pages)


@query("crawl_prefix", f"""{_AUDIT},
    a AS (SELECT *, coalesce(signature = last_value(signature IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again FROM audit),
    e AS (SELECT *, raw_cards = 0 OR again AS gone FROM a)
    SELECT source_id, page_no, raw_cards, parsed_cards FROM e WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM e b WHERE b.source_id = e.source_id AND b.page_no < e.page_no AND (b.gone OR NOT b.has_next))""")
def crawl_prefix(v):
    return P.crawl_prefix(v.v_listing_pages)


@query("first_card_per_key", f"""{_PARSED}, f AS (SELECT *, row_number() OVER (PARTITION BY source_id, coalesce(external_id, content_hash) ORDER BY page_no, position) AS first FROM parsed)
    SELECT source_id, coalesce(external_id, content_hash) AS item_key, page_no, position, title FROM f WHERE first = 1""")
def first_card_per_key(v):
    found = P.first_cards(P.parsed_cards(v.v_listing_pages), ["source_id"])
    return found.select("source_id", F.coalesce("external_id", "content_hash").alias("item_key"), "page_no", "position", "title")


@query("page_urls", "SELECT id, page_no::INT AS page_no, url || CASE WHEN page_no > 1 THEN CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'page=' || page_no ELSE '' END AS url FROM v_sources, range(1, 26) r(page_no) WHERE url LIKE 'http%'")
def page_urls(v):
    many = v.v_sources.where("url like 'http%'").select("id", "url", F.explode(F.sequence(F.lit(1), F.lit(P.MAX_PAGES))).alias("page_no"))
    return many.select("id", "page_no", P.page_url(F.col("url"), F.col("page_no")).alias("url"))


def _cards(v):
    return P.raw_cards(v.v_listing_pages)


_AT = ("source_id", "page_no", "position")


@query("price_from_parts", "SELECT source_id, page_no, position, current_price::DOUBLE AS price, original_price::DOUBLE AS original_price FROM v_cards")
def price_from_parts(v):
    price = lambda a, b: X.price_of_parts(F.nullif(F.col(a), F.lit("")), F.col(b))
    return _cards(v).select(*_AT, price("fraction", "cents").alias("price"), price("old_fraction", "old_cents").alias("original_price"))


@query("parse_discount", "SELECT source_id, page_no, position, discount_percent AS discount FROM v_cards")
def parse_discount(v):
    return _cards(v).select(*_AT, X.percent_in(F.col("label")).alias("discount"))


@query("parse_rating", "SELECT source_id, page_no, position, average_rating::DOUBLE AS rating FROM v_cards")
def parse_rating(v):
    return _cards(v).select(*_AT, X.rating_in(F.col("rating")).alias("rating"))


@query("parse_review_count", "SELECT source_id, page_no, position, total_reviews::INT AS reviews FROM v_cards")
def parse_review_count(v):
    return _cards(v).select(*_AT, X.review_count_in(F.col("reviews")).alias("reviews"))


@query("free_shipping_flag", "SELECT source_id, page_no, position, coalesce(free_shipping, false) AS free_shipping FROM v_cards")
def free_shipping_flag(v):
    return _cards(v).select(*_AT, P.free_shipping(F.col("shipping"), F.col("plain")).alias("free_shipping"))


@query("promotion_type", "SELECT source_id, page_no, position, promotion AS promotion_type FROM v_cards")
def promotion_type(v):
    return _cards(v).select(*_AT, P.promotion(F.col("countdown"), F.col("highlight")).alias("promotion_type"))
