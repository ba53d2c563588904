"""Queries of nested documents, their parts and the streams of snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import offers as O
from ..functions import text as X
from ..functions.titles import RULES
from ..operators import documents as D
from ..operators import facets as A
from ..operators import scoring as G
from ..registry import query
from ..streaming import snapshots as S
from .attributes import COLORS_SQL, DISCOUNT_SQL, LABEL_SQL, SIZE_SQL, normal_sql, terms_sql
from .facets import _TESTS, FILTERS, PRICE, _counts_sql, _faceted
from .scores import _SCORED

_SLUG = lambda x: f"nullif(replace({normal_sql(x)}, ' ', '-'), '')"


@query("normalize_brand_text", f"SELECT id, {normal_sql('brand_slug')} AS plain FROM v_products")
def normalize_brand_text(v):
    return v.v_products.select("id", X.attribute_text(F.col("brand_slug")).alias("plain"))


@query("normalize_brand_alias", "SELECT id, ['olympikus', 'olympikus', 'nike', 'olimpikus 2'][CAST(id % 4 AS INT) + 1] AS brand FROM v_products")
def normalize_brand_alias(v):
    names = F.array(*[F.lit(x) for x in ("Olimpikus", "Ólympikus", "NIKE", "Olimpikus 2")])
    return v.v_products.select("id", D.brand_alias(F.get(names, (F.col("id") % 4).cast("int"))).alias("brand"))


@query("brand_of_attributes", f"""SELECT id, CASE WHEN id % 3 = 0 AND brand_slug IS NOT NULL THEN brand_slug ELSE
    {terms_sql('main_name', [(b[:1].upper() + b[1:], (b,)) for b in ('nike', 'adidas', 'puma', 'mizuno', 'asics', 'olympikus', 'fila', 'reebok', 'new balance', 'under armour', 'vans', 'converse')], 'Outra')} END AS brand FROM v_products""")
def brand_of_attributes(v):
    attributes = F.array(F.struct(F.lit("COLOR").alias("id"), F.lit("Cor").alias("name"), F.lit("Preto").alias("value_name")), F.struct(F.when(F.col("id") % 3 == 0, "BRAND").otherwise("X").alias("id"), F.lit("y").alias("name"), F.col("brand_slug").alias("value_name")))
    return v.v_products.select("id", D.item_brand(attributes, F.col("main_name")).alias("brand"))


_ODD = "CASE id % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) WHEN 2 THEN -5.0 WHEN 3 THEN 250.0 ELSE CAST(discount_percent AS DOUBLE) END"


@query("clamp_metric", "SELECT id, CASE id % 5 WHEN 3 THEN 100.0::DOUBLE WHEN 4 THEN coalesce(discount_percent, 0)::DOUBLE ELSE 0.0::DOUBLE END AS metric FROM v_catalog")
def clamp_metric(v):
    return v.v_catalog.select("id", O.clamped(F.expr(_ODD)).alias("metric"))


_INFORMED = "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 250 ELSE discount_percent END"
_PRICED = "CASE WHEN original_price > current_price THEN floor((original_price::DOUBLE - current_price::DOUBLE) / original_price::DOUBLE * 100 + 0.5)::DOUBLE END"


@query("adapter_discounts", f"""WITH i AS (SELECT *, {_INFORMED} AS informed, {_PRICED} AS priced FROM v_catalog)
    SELECT id, CASE WHEN informed BETWEEN 0 AND 100 THEN informed::DOUBLE ELSE priced END AS card, CASE WHEN informed BETWEEN 0 AND 100 THEN 'informed' WHEN priced IS NOT NULL THEN 'calculated' END AS card_source,
           CASE WHEN informed <> 0 THEN informed::DOUBLE ELSE coalesce(priced, 0) END AS favorite FROM i""")
def adapter_discounts(v):
    informed = F.expr(_INFORMED)
    card, source = D.card_discount(informed, F.col("current_price"), F.col("original_price"))
    return v.v_catalog.select("id", card.alias("card"), source.alias("card_source"), D.favorite_discount(informed, F.col("current_price"), F.col("original_price")).alias("favorite"))


@query("extract_attributes", f"SELECT id, 'color' AS attribute, array_to_string(list_sort(list_distinct(c)), ',') AS labels FROM (SELECT id, {COLORS_SQL} AS c FROM v_products) x WHERE len(c) > 0")
def extract_attributes(v):
    found = v.v_products.select("id", F.explode(D.extracted(F.col("main_name"))).alias("attribute", "values"))
    return found.select("id", "attribute", F.array_join(F.array_sort(F.col("values.label")), ",").alias("labels"))


_RAW = """concat('{"marketplace_colors":[{"name":', coalesce(concat('"', name, '"'), 'null'), ',"source":"marketplace_attribute"},{"name":"Roxo","source":"guess"},{"name":', coalesce(concat('"', variation_name, '"'), 'null'), ',"source":"marketplace_variation"}]}')"""
_TWO = "(SELECT product_id, name, 1 AS kind FROM v_colors UNION ALL SELECT product_id, variation_name, 2 FROM v_colors) q"


@query("raw_json_colors", f"""WITH c AS (SELECT product_id, kind, CASE WHEN length(trim(name)) BETWEEN 1 AND 120 THEN trim(regexp_replace(name, '\\s+', ' ', 'g')) END AS label FROM {_TWO}), s AS (SELECT *, {_SLUG('label')} AS value FROM c)
    SELECT product_id, value, max_by(label, kind) AS label, max_by(CASE kind WHEN 1 THEN 'marketplace_attribute' ELSE 'marketplace_variation' END, kind) AS source FROM s WHERE value IS NOT NULL GROUP BY product_id, value""")
def raw_json_colors(v):
    found = v.v_colors.select("product_id", F.explode(D.raw_colors(F.expr(_RAW))).alias("c"))
    return found.select("product_id", "c.value", F.col("c.name").alias("label"), "c.source")


_SET = f"""l AS (SELECT product_id, kind, CASE WHEN trim(name) <> '' THEN {LABEL_SQL} END AS label FROM {_TWO}), s AS (SELECT *, {_SLUG('label')} AS value FROM l),
    own AS (SELECT product_id, value, max_by(label, kind) AS label FROM s WHERE value IS NOT NULL AND product_id % 3 <> 0 GROUP BY product_id, value),
    colors AS (SELECT * FROM own UNION ALL SELECT product_id, 'vinho', 'Vinho' FROM v_colors WHERE product_id % 2 = 0 AND product_id NOT IN (SELECT product_id FROM own))"""


def _names():
    return F.when(F.col("product_id") % 3 != 0, F.array("name", "variation_name")).otherwise(F.array().cast("array<string>"))


def _primary():
    return F.when(F.col("product_id") % 2 == 0, "vinho")


@query("product_color_set", f"WITH {_SET} SELECT * FROM colors")
def product_color_set(v):
    found = v.v_colors.select("product_id", F.explode(D.color_set(_names(), _primary())).alias("c"))
    return found.select("product_id", "c.value", "c.label")


_SPORT = terms_sql("main_name", *RULES["sport"])


@query("comparable_attributes", f"""WITH {_SET}, n AS (SELECT product_id, string_agg(value || '=' || label, ',' ORDER BY value) AS colors FROM colors GROUP BY product_id)
    SELECT p.id, n.colors, {SIZE_SQL} AS size, {terms_sql('main_name', *RULES['gender'])} AS gender, CASE WHEN {terms_sql('main_name', *RULES['age'])} = 'Infantil' THEN 'Infantil' END AS age_group,
           CASE WHEN {_SPORT} <> 'Casual' THEN {_SPORT} END AS sport, CASE WHEN {_SPORT} = 'Casual' THEN 'Casual' END AS usage, CASE WHEN {terms_sql('main_name', *RULES['gender'])} IS NOT NULL THEN 'title_inference' END AS gender_from
    FROM v_products p LEFT JOIN n ON n.product_id = p.id""")
def comparable_attributes(v):
    joined = v.v_products.join(v.v_colors, F.col("id") == F.col("product_id"), "left")
    a = joined.select("id", D.comparable_attributes(F.col("main_name"), _names(), _primary()).alias("a"))
    told = F.array_join(F.array_sort(F.transform("a.colors", lambda c: F.concat(c.value, F.lit("="), c.label))), ",")
    return a.select("id", told.alias("colors"), F.col("a.size.value").alias("size"), F.col("a.gender.value").alias("gender"), F.col("a.age_group.value").alias("age_group"), F.col("a.sport.value").alias("sport"), F.col("a.usage.value").alias("usage"), F.col("a.gender.provenance").alias("gender_from"))


@query("comparable_product", f"""SELECT id, main_name AS title, nullif(trim(brand_slug), '') AS brand, CASE WHEN average_rating > 0 THEN average_rating::DOUBLE END AS rating, total_reviews::BIGINT AS reviews, offer_id IS NOT NULL AS has_offer,
    current_price::DOUBLE AS price, CASE WHEN offer_id IS NOT NULL THEN CASE WHEN discount_percent BETWEEN 0 AND 100 THEN discount_percent::DOUBLE ELSE {_PRICED} END END AS discount,
    CASE WHEN discount_percent BETWEEN 0 AND 100 THEN 'informed' WHEN {_PRICED} IS NOT NULL THEN 'calculated' END AS discount_source FROM v_catalog""")
def comparable_product(v):
    d = D.comparable(v.v_catalog)
    return d.select("id", "product.title", "product.brand", "product.rating", "product.reviews", F.col("offer").isNotNull().alias("has_offer"), "offer.price", "offer.discount", "offer.discount_source")


@query("favorite_card", f"""SELECT c.id, main_name AS name, coalesce(b.name, 'Outras') AS brand, coalesce(current_price::DOUBLE, 0) AS price, original_price::DOUBLE AS old_price, {DISCOUNT_SQL} AS discount, coalesce(main_image_url, '') AS image,
    coalesce(o.link, '#') AS link, coalesce(free_shipping, false) AS free_shipping, average_rating, total_reviews FROM v_catalog c LEFT JOIN v_brands b ON b.slug = c.brand_slug LEFT JOIN (SELECT id, affiliate_url AS link FROM v_offers) o ON o.id = c.offer_id""")
def favorite_card(v):
    brands = v.v_brands.select(F.col("slug").alias("brand_slug"), F.col("name").alias("brand_name"))
    links = v.v_offers.select(F.col("id").alias("offer_id"), "affiliate_url")
    return D.favorite_cards(v.v_catalog.join(brands, "brand_slug", "left").join(links, "offer_id", "left"))


_LINKS = ("?marca=Nike, Adidas,,&cor=preta,, Azul Marinho&busca=tenis&q=x", "cor=&tamanho=40,41&q=bota", "genero=Feminino")


def _links(v):
    texts = F.array(*[F.lit(x) for x in _LINKS])
    return v.v_searches.select("id", "k", D.filters_of(F.get(texts, (F.col("k") % 3).cast("int"))).alias("f"))


@query("filters_from_query", "SELECT id, ['Nike|Adidas', '', ''][k % 3 + 1] AS brands, ['preto|azul-marinho', '', ''][k % 3 + 1] AS colors, ['', '40|41', ''][k % 3 + 1] AS sizes, ['tenis', 'bota', ''][k % 3 + 1] AS text FROM v_searches")
def filters_from_query(v):
    return _links(v).select("id", F.array_join("f.marca", "|").alias("brands"), F.array_join("f.cor", "|").alias("colors"), F.array_join("f.tamanho", "|").alias("sizes"), "f.text")


@query("active_filter_count", "SELECT id, [4, 2, 1][k % 3 + 1] + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS active FROM v_searches")
def active_filter_count(v):
    return _links(v).select("id", D.active_filters(F.col("f"), F.when(F.col("k") % 2 == 0, 10.0)).alias("active"))


@query("merge_id_cleanup", "SELECT id, id % 50 = 0 AS rejected, CASE WHEN id % 50 <> 0 THEN id || '|abc' END AS ids FROM v_products")
def merge_id_cleanup(v):
    own = F.col("id").cast("string")
    messy = F.array(F.concat(F.lit(" "), own, F.lit(" ")), own, F.lit(None).cast("string"), F.lit(""), F.lit("x" * 37), F.lit("abc"))
    payload = F.when(F.col("id") % 50 == 0, F.array_repeat(own, 1001)).otherwise(messy)
    ids = D.cleaned_ids(payload)
    return v.v_products.select("id", ids.isNull().alias("rejected"), F.array_join(ids, "|").alias("ids"))


@query("valid_favorite_refs", "SELECT user_id, product_id::VARCHAR AS ref, min(created_at) AS saved_at FROM v_favorites WHERE product_id % 7 <> 0 AND product_id % 5 <> 0 GROUP BY user_id, product_id")
def valid_favorite_refs(v):
    from ..operators.runs import first_rows_by

    saved = F.when(F.col("product_id") % 5 == 0, "not a date").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    refs = v.v_favorites.select("user_id", F.when(F.col("product_id") % 7 == 0, "").otherwise(F.col("product_id").cast("string")).alias("ref"), saved.alias("saved"), F.lit(0).alias("place"))
    again = refs.withColumn("place", F.lit(1)).withColumn("saved", F.lit("2030-01-01 00:00:00")).where("saved is not null and ref <> '' and pmod(cast(ref as int), 5) <> 0")
    valid = refs.unionByName(again).withColumn("saved_at", F.try_to_timestamp("saved").cast("timestamp_ntz")).where("ref <> '' and saved_at is not null")
    return first_rows_by(valid, ["user_id", "ref"], ["place"]).select("user_id", "ref", "saved_at")


@query("demo_masking", "SELECT id, main_name, NULL::VARCHAR AS affiliate_url, NULL::BIGINT AS marketplace_id, current_price, 'Dados demonstrativos' AS label FROM v_catalog")
def demo_masking(v):
    return v.v_catalog.select("id", "main_name", F.lit(None).cast("string").alias("affiliate_url"), F.lit(None).cast("long").alias("marketplace_id"), "current_price", F.lit("Dados demonstrativos").alias("label"))


_CRITERIA = ("discount", "rating", "reviews", "shipping")


@query("worth_paying", f"""WITH {_SCORED}, t AS (SELECT *, round(score, 6) AS q FROM s), l AS (SELECT *, abs(q - max(q) OVER c) <= 0.1 AS leads, coalesce(abs(current_price - min(current_price) OVER c) <= 0.000001, false) AS cheap FROM t WINDOW c AS (PARTITION BY cohort_id)),
    won AS (SELECT * FROM l WHERE leads QUALIFY count(*) OVER (PARTITION BY cohort_id) = 1), low AS (SELECT * FROM l WHERE cheap QUALIFY count(*) OVER (PARTITION BY cohort_id) = 1),
    j AS (SELECT k.cohort_id, w.product_id AS wid, c.product_id AS cid, w.q AS wq, c.q AS cq, CASE WHEN w.current_price > 0 AND c.current_price > 0 THEN greatest(0, w.current_price::DOUBLE - c.current_price::DOUBLE) END AS more, c.current_price::DOUBLE AS lowest,
          {', '.join(f'w.n_{x} - c.n_{x} AS d_{x}' for x in _CRITERIA)} FROM (SELECT DISTINCT cohort_id FROM v_cohorts) k LEFT JOIN won w USING (cohort_id) LEFT JOIN low c USING (cohort_id)),
    x AS (SELECT *, more / lowest * 100 AS share, [z FOR z IN [{', '.join(f"CASE WHEN more IS NOT NULL AND d_{y} > 0.000001 THEN '{y}' END" for y in _CRITERIA)}] IF z IS NOT NULL] AS better,
          [z FOR z IN [{', '.join(f"CASE WHEN more IS NOT NULL AND d_{y} < -0.000001 THEN '{y}' END" for y in _CRITERIA)}] IF z IS NOT NULL] AS worse, {' + '.join(f'CASE WHEN more IS NOT NULL AND d_{y} IS NOT NULL THEN 1 ELSE 0 END' for y in _CRITERIA)} AS comparable FROM j)
    SELECT cohort_id, CASE WHEN more IS NULL THEN 'DEPENDS' WHEN wid = cid OR more <= 0.000001 THEN 'NO' WHEN comparable < 2 THEN 'DEPENDS'
             WHEN len(worse) = 0 AND wq - cq >= 0.5 AND ((more <= 50 AND share <= 15 AND len(better) >= 3) OR (more <= 100 AND share <= 10 AND len(better) >= 2)) THEN 'YES'
             WHEN (more > 200 OR share > 30) AND len(better) <= 1 THEN 'NO' ELSE 'DEPENDS' END AS verdict, round(more, 4) AS more, round(share, 4) AS share, array_to_string(better, ',') AS better, array_to_string(worse, ',') AS worse, comparable FROM x""")
def worth_paying(v):
    df = G.scored(v.v_cohorts).withColumn("rounded", F.round("score", 6))
    df = G.leaders(G.leaders(df, F.col("rounded"), "score", 0.1), F.col("current_price"), "price", 1e-6, highest=False)
    return D.worth_paying(df).select("cohort_id", "verdict", F.round("more", 4).alias("more"), F.round("share", 4).alias("share"), F.array_join("better", ",").alias("better"), F.array_join("worse", ",").alias("worse"), "comparable")


_ANCHORS = ("brand#1", "brand#2", "olympikus")
_SHOWN = f"h AS (SELECT id, brand_slug AS brand, {DISCOUNT_SQL} AS discount FROM v_catalog WHERE main_image_url IS NOT NULL AND offer_id IS NOT NULL), a AS (SELECT * FROM h WHERE discount > 0)"


@query("hero_products", f"""WITH {_SHOWN},
    p1 AS (SELECT * FROM a WHERE contains(lower(coalesce(brand, '')), 'brand#1') ORDER BY discount DESC, id LIMIT 1), p2 AS (SELECT * FROM a WHERE contains(lower(coalesce(brand, '')), 'brand#2') AND id NOT IN (SELECT id FROM p1) ORDER BY discount DESC, id LIMIT 1),
    r AS (SELECT a.*, 2 AS tier FROM a WHERE lower(coalesce(brand, '')) NOT IN ('outra', 'outras')), f AS (SELECT *, 0 AS tier FROM p1 UNION ALL SELECT *, 1 FROM p2 UNION ALL SELECT * FROM r WHERE id NOT IN (SELECT id FROM p1 UNION ALL SELECT id FROM p2))
    SELECT row_number() OVER (ORDER BY tier, discount DESC, id)::INT AS place, id, brand, discount FROM f ORDER BY tier, discount DESC, id LIMIT 3""")
def hero_products(v):
    discount = O.effective_discount(F.col("discount_percent"), F.col("current_price"), F.col("original_price"))
    shown = v.v_catalog.where("main_image_url is not null and offer_id is not null").select("id", F.col("brand_slug").alias("brand"), discount.alias("discount")).where("discount > 0")
    return D.heroes(shown, _ANCHORS, ("outra", "outras"))


@query("hero_products_v1", """WITH a AS (SELECT id, brand_slug AS brand, coalesce(discount_percent, 0) AS discount FROM v_catalog WHERE main_image_url IS NOT NULL),
    p1 AS (SELECT *, 0 AS tier FROM a WHERE brand = 'Brand#3' ORDER BY discount DESC, id LIMIT 1), f AS (SELECT * FROM p1 UNION ALL SELECT *, 1 FROM a WHERE lower(coalesce(brand, '')) NOT IN ('outra', 'outras') AND id NOT IN (SELECT id FROM p1))
    SELECT row_number() OVER (ORDER BY tier, discount DESC, id)::INT AS place, id, brand, discount FROM f ORDER BY tier, discount DESC, id LIMIT 3""")
def hero_products_v1(v):
    shown = v.v_catalog.where("main_image_url is not null").select("id", F.col("brand_slug").alias("brand"), F.coalesce("discount_percent", F.lit(0)).alias("discount"))
    return D.heroes(shown, ("Brand#3", "Missing"), ("outra", "outras"), exact=True)


@query("facets_with_selected", f"SELECT * FROM ({_counts_sql(_TESTS, FILTERS)}) z WHERE dimension IN ('marca', 'tamanho', 'genero', 'idade', 'modalidade', 'tipo')")
def facets_with_selected(v):
    return A.facet_counts(_faceted(v), FILTERS, PRICE).where(F.col("dimension").isin(*A.STICKY))


@query("selected_minus_present", "SELECT s.dimension, s.value FROM (VALUES " + ", ".join(f"('{d}', '{x}')" for d, values in FILTERS.items() for x in values) + ") s(dimension, value) WHERE s.dimension = 'marca' AND s.value NOT IN (SELECT name FROM v_brands b WHERE EXISTS (SELECT 1 FROM v_catalog c WHERE c.brand_slug = b.slug))")
def selected_minus_present(v):
    chosen = v.spark.createDataFrame([(d, x) for d, values in FILTERS.items() for x in values], "dimension string, value string").where("dimension = 'marca'")
    there = v.v_catalog.where("brand_slug is not null").select(F.col("brand_slug").alias("value")).distinct()
    return chosen.join(there, "value", "left_anti").select("dimension", "value")


@query("valid_snapshots", """WITH s AS (SELECT CAST(floor(id / 12) AS BIGINT) AS owner, id AS place FROM v_products WHERE id % 6 IN (0, 5))
    SELECT owner, place, place::VARCHAR AS product_id FROM s QUALIFY row_number() OVER (PARTITION BY owner ORDER BY place) <= 3""")
def valid_snapshots(v):
    own, kind = F.col("id").cast("string"), F.col("id") % 6
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    date = F.when(kind == 1, "yesterday").otherwise("2024-01-02T03:04:05Z")
    other = F.when(kind == 2, F.concat(own, F.lit("0"))).otherwise(own)
    title = F.when(kind == 3, " ").otherwise(F.lit("Tênis"))
    rating = F.when(kind == 4, "7.5").when(kind == 5, "4.5").otherwise("null")
    doc = F.concat(F.lit('{"productId":'), quoted(own), F.lit(',"selectedAt":'), quoted(date), F.lit(',"snapshot":{"product":{"id":'), quoted(other), F.lit(',"title":'), quoted(title), F.lit(',"rating":'), rating, F.lit('},"selectedAt":'), quoted(date), F.lit("}}"))
    rows = v.v_products.select(F.floor(F.col("id") / 12).alias("owner"), F.col("id").alias("place"), doc.alias("document"))
    return D.valid_snapshots(rows.unionByName(rows.withColumn("place", F.col("place") + 1_000_000)))


@query("stream_snapshot_upsert", "SELECT source_id, external_item_id, min(batch_no) AS first_batch, max(batch_no) AS last_batch, count(*) AS times FROM v_observations GROUP BY ALL")
def stream_snapshot_upsert(v):
    return S.merged_state(S.snapshot_stream(v.v_observations), ["source_id", "external_item_id"])
