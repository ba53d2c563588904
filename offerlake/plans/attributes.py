"""Queries of the column functions: what titles, links, prices and scores reveal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import offers as O
from ..functions import text as X
from ..functions import titles as T
from ..registry import query


def terms_sql(text: str, rules, default: str | None = None) -> str:
    """Rules as a CASE, for the oracles."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = [f"WHEN {' OR '.join(f'contains(lower({text}), {quoted(t)})' for t in terms)} THEN {quoted(label)}" for label, terms in rules]
    return f"CASE {' '.join(cases)} ELSE {'NULL' if default is None else quoted(default)} END"


def normal_sql(text: str) -> str:
    return rf"trim(regexp_replace(lower(strip_accents(coalesce({text}, ''))), '[^a-z0-9]+', ' ', 'g'))"


def listed(values) -> str:
    return ", ".join("'" + v + "'" for v in values)


def _title():
    return F.col("main_name")


_TOKENS = f"[t FOR t IN string_split({normal_sql('main_name')}, ' ') IF t <> '']"
_MEANING = f"[t FOR t IN {_TOKENS} IF t NOT IN ({listed(X.STOP_WORDS)}) AND NOT regexp_full_match(t, '[0-9]+')]"
_COLOR_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in T.COLOR_OF.items()) + "}"
COLORS_SQL = rf"[{_COLOR_MAP}[a] FOR a IN regexp_extract_all(array_to_string({_MEANING}, ' '), '{T.COLOR_PATTERN}')]"


@query("normalize_attribute_text", f"SELECT id, {normal_sql('main_name')} AS plain FROM v_products")
def normalize_attribute_text(v):
    return v.v_products.select("id", X.attribute_text(_title()).alias("plain"))


@query("slugify_value", f"SELECT product_id, nullif(replace({normal_sql('name')}, ' ', '-'), '') AS slug FROM v_colors")
def slugify_value(v):
    return v.v_colors.select("product_id", X.slug(F.col("name")).alias("slug"))


@query("tokenize_title", f"SELECT id, array_to_string({_TOKENS}, '|') AS tokens, array_to_string({_MEANING}, '|') AS meaningful FROM v_products")
def tokenize_title(v):
    return v.v_products.select("id", F.array_join(X.tokens(_title()), "|").alias("tokens"), F.array_join(X.meaningful_tokens(_title()), "|").alias("meaningful"))


@query("token_ngrams", f"""
    WITH t AS (SELECT id, {_TOKENS} AS w FROM v_products)
    SELECT id, array_to_string(list_concat(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] ELSE [] END, w), '|') AS grams FROM t""")
def token_ngrams(v):
    return v.v_products.select("id", F.array_join(X.ngrams(X.tokens(_title()), 2), "|").alias("grams"))


@query("normalize_search_text", "SELECT id, lower(strip_accents(main_name)) AS plain FROM v_products")
def normalize_search_text(v):
    return v.v_products.select("id", X.search_text(_title()).alias("plain"))


@query("text_search", """
    SELECT p.id FROM v_products p LEFT JOIN v_brands b ON b.slug = p.brand_slug
    WHERE contains(lower(strip_accents(concat_ws(' ', main_name, b.name))), 'tenis') AND contains(lower(strip_accents(concat_ws(' ', main_name, b.name))), 'brand#1')""")
def text_search(v):
    brands = v.v_brands.select(F.col("slug").alias("brand_slug"), F.col("name").alias("brand_name"))
    return v.v_products.join(brands, "brand_slug", "left").where(X.matches_all("Tênis brand#1", _title(), F.col("brand_name"))).select("id")


@query("title_dedup_key", r"SELECT id, lower(substring(regexp_replace(coalesce(main_name, ''), '\s+', ' ', 'g'), 1, 60)) AS title_key FROM v_products")
def title_dedup_key(v):
    return v.v_products.select("id", X.title_key(_title()).alias("title_key"))


@query("slug_published", f"SELECT id, substring(replace({normal_sql('main_name')}, ' ', '-'), 1, 80) || '-' || CAST(id AS VARCHAR) AS slug FROM v_products")
def slug_published(v):
    return v.v_products.select("id", X.published_slug(_title(), F.col("id").cast("string")).alias("slug"))


@query("affiliate_url", "SELECT id, CASE WHEN url = '' THEN url ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'tool=1&word=' END AS url FROM v_sources")
def affiliate_url(v):
    return v.v_sources.select("id", X.tracked(F.col("url"), "tool=1&word=").alias("url"))


_ITEM_LINKS = ("https://shop.example.test/MLB-{}-title?x=1", "https://x.test/MLBU{}", "https://x.test/p?item=mlb{}#z", "https://x.test/none/{}", "")


@query("external_id", "SELECT id, [concat('MLB', product_id), concat('MLB', product_id), concat('mlb', product_id), NULL, NULL][product_id % 5 + 1] AS item_id FROM v_offers")
def external_id(v):
    links = F.array(*[F.format_string(x.replace("{}", "%d"), "product_id") if "{}" in x else F.lit(x) for x in _ITEM_LINKS])
    return v.v_offers.select("id", X.item_id(F.get(links, (F.col("product_id") % 5).cast("int"))).alias("item_id"))


@query("redact_url", "SELECT id, CASE WHEN contains(url, '?s=') THEN string_split(url, '?s=')[1] || '?s=redacted' ELSE url END AS url FROM v_sources")
def redact_url(v):
    return v.v_sources.select("id", X.redacted(F.concat("url", F.lit("#top"))).alias("url"))


_FRAGMENTS = ("#x#y", "", "#", "?a=1#b?c")


@query("strip_fragment", "SELECT id, url || ['', '', '', '?a=1'][CAST(id % 4 AS INT) + 1] AS url FROM v_sources")
def strip_fragment(v):
    ends = F.array(*[F.lit(x) for x in _FRAGMENTS])
    return v.v_sources.select("id", F.substring_index(F.concat("url", F.get(ends, (F.col("id") % 4).cast("int"))), "#", 1).alias("url"))


@query("content_sha256", r"""SELECT id, sha256(normalized_title || '::' || regexp_replace(regexp_replace(CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR), '(\.\d*?)0+$', '\1'), '\.$', '')) AS hash FROM v_processed""")
def content_sha256(v):
    return v.v_processed.select("id", X.content_sha256(F.col("normalized_title"), F.col("price")).alias("hash"))


@query("content_hash32", """
    WITH h AS (SELECT id, list_reduce(list_prepend(0::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(lower(trim(normalized_title)) || '::' || CAST(CAST(price AS DECIMAL(18, 2)) AS VARCHAR), '')]), lambda h, c: (h * 31 + c) & 4294967295) AS h FROM v_processed)
    SELECT id, printf('%08x', CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END) AS hash FROM h""")
def content_hash32(v):
    return v.v_processed.select("id", X.content_hash32(F.col("normalized_title"), F.col("price")).alias("hash"))


_NAMED = [(b, (b,)) for b in T.BRANDS]
BRAND_SQL = f"coalesce({terms_sql('main_name', _NAMED)}, {terms_sql('main_name', T.BRAND_LINES)}, 'outra')"


@query("detect_brand", f"SELECT id, {BRAND_SQL} AS brand FROM v_products")
def detect_brand(v):
    return v.v_products.select("id", T.brand_of(_title(), F.col("brand_slug")).alias("brand"))


def _attribute(name: str, rule: str) -> None:
    @query(name, f"SELECT id, {terms_sql('main_name', *T.RULES[rule])} AS {rule} FROM v_products")
    def plan(v):
        return v.v_products.select("id", T.attribute(_title(), rule).alias(rule))


for _name, _rule in (("detect_category", "category"), ("gender_of", "gender"), ("age_of", "age"), ("sport_of", "sport"), ("type_of", "type")):
    _attribute(_name, _rule)

SIZE_SQL = r"""CASE WHEN TRY_CAST(regexp_extract(lower(main_name), '\b(\d{2})(?:[.,]0)?\s+br\b', 1) AS INT) BETWEEN 16 AND 48 THEN regexp_extract(lower(main_name), '\b(\d{2})(?:[.,]0)?\s+br\b', 1)
    ELSE [s FOR s IN regexp_extract_all(main_name, '\b\d{2}\b') IF CAST(s AS INT) BETWEEN 16 AND 48][-1] END"""


@query("size_of", f"SELECT id, {SIZE_SQL} AS size FROM v_products")
def size_of(v):
    return v.v_products.select("id", T.size_of(_title()).alias("size"))


_FOUND_SQL = "[b FOR b IN [" + ", ".join(["CASE WHEN regexp_matches(main_name, '\\bair\\s+jordan\\b', 'i') THEN 'jordan' END"] + [f"CASE WHEN regexp_matches(main_name, '\\b{b.replace(' ', chr(92) + 's+')}\\b', 'i') THEN '{b}' END" for b in T.TRUSTED_BRANDS]) + "] IF b IS NOT NULL]"
_CONFIDENCE_SQL = f"""
    WITH f AS (SELECT id, main_name, main_image_url, {_FOUND_SQL} AS found, {normal_sql('main_name')} AS plain FROM v_products),
    c AS (SELECT *, found[1] AS brand, CAST(CASE WHEN len(found) = 0 THEN 0.0 WHEN len(list_distinct(found)) > 1 THEN 0.3 WHEN starts_with(plain, found[1]) THEN 0.9 WHEN contains(plain, found[1]) THEN 0.82 ELSE 0.7 END AS DOUBLE) AS confidence FROM f)"""


def _sure(v):
    found = v.v_products.withColumn("brands", T.trusted_brands(_title(), F.col("brand_slug")))
    return found.withColumn("confidence", T.brand_confidence(_title(), F.col("brand_slug"), F.col("brands")))


@query("brand_confidence", f"{_CONFIDENCE_SQL} SELECT id, brand, confidence FROM c")
def brand_confidence(v):
    return _sure(v).select("id", F.get("brands", F.lit(0)).alias("brand"), "confidence")


_ISSUES_SQL = """array_to_string([i FOR i IN [CASE WHEN length(trim(main_name)) < 10 THEN 'title_too_short' END, CASE WHEN NOT regexp_matches(coalesce(main_image_url, ''), '^https?://', 'i') THEN 'missing_image' END,
    CASE WHEN coalesce(current_price, 0) <= 0 THEN 'invalid_price' END, CASE WHEN discount_percent NOT BETWEEN 0 AND 90 THEN 'discount_out_of_range' END] IF i IS NOT NULL], ',')"""


def _card():
    return T.card_issues(_title(), F.lit("https://example.test/"), F.col("main_image_url"), F.col("current_price"), F.col("discount_percent"))


@query("card_quality", f"SELECT id, {_ISSUES_SQL} AS issues FROM v_catalog")
def card_quality(v):
    return v.v_catalog.select("id", F.array_join(_card(), ",").alias("issues"))


@query("auto_approval", f"""{_CONFIDENCE_SQL},
    j AS (SELECT k.id, c.found, c.confidence, {_ISSUES_SQL.replace('main_name', 'k.main_name').replace('main_image_url', 'k.main_image_url')} AS issues FROM v_catalog k JOIN c ON c.id = k.id)
    SELECT id, CASE WHEN len(found) = 0 THEN 'brand_not_in_whitelist' WHEN confidence < 0.85 THEN 'confidence_below_threshold' WHEN issues <> '' THEN 'incomplete_card' ELSE 'auto_approved' END AS decision FROM j""")
def auto_approval(v):
    brands = T.trusted_brands(_title(), F.col("brand_slug"))
    return v.v_catalog.select("id", T.approval(brands, T.brand_confidence(_title(), F.col("brand_slug"), brands), _card()).alias("decision"))


@query("title_colors", f"SELECT id, array_to_string(list_sort(list_distinct(c)), ',') AS colors, c[1] AS first_color FROM (SELECT id, {COLORS_SQL} AS c FROM v_products) x")
def title_colors(v):
    found = T.title_colors(_title())
    return v.v_products.select("id", F.array_join(F.array_sort(found), ",").alias("colors"), F.get(found, F.lit(0)).alias("first_color"))


LABEL_SQL = f"""(SELECT upper(j[1]) || substring(j, 2) FROM (SELECT array_to_string([coalesce({_COLOR_MAP}[{normal_sql('q')}], trim(q)) FOR q IN regexp_extract_all(trim(name), '[/+,&]|[^/+,&]+')], '') AS j) z)"""


@query("translate_color", f"SELECT product_id, CASE WHEN trim(name) <> '' THEN {LABEL_SQL} END AS label FROM v_colors")
def translate_color(v):
    return v.v_colors.select("product_id", T.color_label(F.col("name")).alias("label"))


@query("clean_official_color", rf"SELECT product_id, CASE WHEN length(trim(regexp_replace(name, '\s+', ' ', 'g'))) BETWEEN 1 AND 120 AND {normal_sql('name')} <> '' THEN trim(regexp_replace(name, '\s+', ' ', 'g')) END AS color FROM v_colors")
def clean_official_color(v):
    return v.v_colors.select("product_id", T.clean_color(F.col("name")).alias("color"))


DISCOUNT_SQL = """least(100, CASE WHEN discount_percent > 0 THEN discount_percent
    WHEN current_price > 0 AND original_price > current_price THEN CAST(floor((original_price::DOUBLE - current_price::DOUBLE) / original_price::DOUBLE * 100 + 0.5) AS INT) ELSE 0 END)"""


@query("effective_discount", f"SELECT id, {DISCOUNT_SQL} AS discount FROM v_offers")
def effective_discount(v):
    return v.v_offers.select("id", O.effective_discount(F.col("discount_percent"), F.col("current_price"), F.col("original_price")).alias("discount"))


@query("collected_discount", """SELECT id, CASE WHEN discount_percent <> 0 THEN discount_percent WHEN original_price > current_price THEN CAST(floor((1 - current_price::DOUBLE / original_price::DOUBLE) * 100 + 0.5) AS INT) END AS discount FROM v_offers""")
def collected_discount(v):
    return v.v_offers.select("id", O.collected_discount(F.col("discount_percent"), F.col("current_price"), F.col("original_price")).alias("discount"))


BUCKET_SQL = "CASE WHEN d >= 50 THEN '50% ou mais' WHEN d >= 40 THEN '40% - 49%' WHEN d >= 30 THEN '30% - 39%' WHEN d >= 20 THEN '20% - 29%' WHEN d > 0 THEN 'Até 19%' END"


@query("discount_buckets", f"SELECT {BUCKET_SQL} AS bucket, count(*) AS n FROM (SELECT {DISCOUNT_SQL} AS d FROM v_offers) x GROUP BY 1")
def discount_buckets(v):
    found = v.v_offers.select(O.discount_bucket(O.effective_discount(F.col("discount_percent"), F.col("current_price"), F.col("original_price"))).alias("bucket"))
    return found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


RATINGS_SQL = "[l.label FOR l IN [{'label': '4 estrelas ou mais', 'low': 4}, {'label': '3 estrelas ou mais', 'low': 3}, {'label': '2 estrelas ou mais', 'low': 2}, {'label': '1 estrela ou mais', 'low': 1}] IF average_rating >= l.low]"


@query("rating_buckets", f"SELECT bucket, count(*) AS n FROM (SELECT unnest({RATINGS_SQL}) AS bucket FROM v_products) x GROUP BY bucket")
def rating_buckets(v):
    return v.v_products.select(F.explode(O.rating_buckets(F.col("average_rating"))).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query("price_of", "SELECT id, CAST(coalesce(current_price, 0) AS DOUBLE) AS price FROM v_catalog")
def price_of(v):
    return v.v_catalog.select("id", F.coalesce(F.col("current_price").try_cast("double"), F.lit(0.0)).alias("price"))


@query("product_badges", """
    SELECT r.id, array_to_string([b FOR b IN [CASE WHEN r.promotion_type = 'lightning' THEN 'lightning-offer' END, CASE WHEN p.average_rating >= 4.5 THEN 'highly-rated' END, CASE WHEN p.total_reviews >= 1000 THEN 'most-reviewed' END] IF b IS NOT NULL], ',') AS badges
    FROM v_processed r JOIN v_products p ON p.id = r.product_id""")
def product_badges(v):
    rated = v.v_products.select(F.col("id").alias("product_id"), "average_rating", "total_reviews")
    joined = v.v_processed.join(rated, "product_id")
    return joined.select("id", F.array_join(O.badges(F.col("promotion_type"), F.col("average_rating"), F.col("total_reviews")), ",").alias("badges"))


@query("section_of_promotion", "SELECT id, CASE promotion_type WHEN 'lightning' THEN 'relampago' WHEN 'deal_of_day' THEN 'dia' WHEN 'general' THEN 'geral' END AS section FROM v_processed")
def section_of_promotion(v):
    return v.v_processed.select("id", O.section_of(F.col("promotion_type")).alias("section"))


@query("triage_priority", "SELECT id, CASE WHEN discount_percent >= 20 THEN 1 ELSE 0 END AS priority FROM v_processed")
def triage_priority(v):
    return v.v_processed.select("id", F.when(F.col("discount_percent") >= 20, 1).otherwise(0).alias("priority"))


@query("freshness_label", """
    WITH m AS (SELECT id, clicked_at, CAST(floor((epoch_us(timestamp '2024-01-30 12:00:00') - epoch_us(clicked_at)) / 60000000) AS BIGINT) AS m FROM v_clicks)
    SELECT id, CASE WHEN m < 1 THEN 'agora' WHEN m < 60 THEN m || 'min atrás' WHEN m < 1440 THEN (m // 60) || 'h atrás' ELSE strftime(clicked_at, '%H:%M') END AS label FROM m""")
def freshness_label(v):
    seen = F.to_timestamp_ntz(F.col("clicked_at").cast("string")).cast("timestamp")
    return v.v_clicks.select("id", O.freshness(seen, F.expr("timestamp '2024-01-30 12:00:00'")).alias("label"))


@query("brand_display_name", f"SELECT id, array_to_string([upper(w[1]) || substring(w, 2) FOR w IN string_split({BRAND_SQL}, ' ')], ' ') AS name FROM v_products")
def brand_display_name(v):
    return v.v_products.select("id", X.display_name(T.brand_of(_title())).alias("name"))


@query("hq_image_url", "SELECT id, replace(main_image_url, '-I.jpg', '-O.jpg') AS url FROM v_products")
def hq_image_url(v):
    return v.v_products.select("id", X.large_image(F.col("main_image_url")).alias("url"))


@query("offer_source_label", "SELECT k.id, concat_ws(' · ', m.name, nullif(k.brand_slug, '')) AS label FROM v_catalog k LEFT JOIN v_marketplaces m ON m.id = k.marketplace_id")
def offer_source_label(v):
    names = v.v_marketplaces.select(F.col("id").alias("marketplace_id"), "name")
    return v.v_catalog.join(names, "marketplace_id", "left").select("id", X.joined_label(F.col("name"), F.col("brand_slug")).alias("label"))
