"""Rules over values that come from the tables themselves, so that larger tables bring other values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import offers as O
from ..operators import documents as D
from ..registry import query
from .attributes import LABEL_SQL, normal_sql

_TEXTS = "CASE id % 7 WHEN 0 THEN CAST(current_price AS string) WHEN 1 THEN '  ' || CAST(current_price AS string) || ' reais' WHEN 2 THEN CAST(current_price AS string) || '.5.6' WHEN 3 THEN 'R$ ' || CAST(current_price AS string) WHEN 4 THEN '' WHEN 5 THEN '-' || CAST(id AS string) || 'e1x' ELSE '.' || CAST(id AS string) END"


@query("price_of_texts", rf"SELECT id, coalesce(TRY_CAST(nullif(regexp_extract({_TEXTS}, '^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '') AS DOUBLE), 0) AS price FROM v_catalog")
def price_of_texts(v):
    return v.v_catalog.select("id", O.price_of(F.expr(_TEXTS)).alias("price"))


@query("brand_aliases_of_words", "SELECT id, place - 1 AS place, CASE WHEN lower(strip_accents(word)) = 'olimpikus' THEN 'olympikus' ELSE lower(strip_accents(word)) END AS alias FROM (SELECT id, unnest(string_split(main_name || ' Olímpikus', ' ')) AS word, generate_subscripts(string_split(main_name || ' Olímpikus', ' '), 1) AS place FROM v_products) x")
def brand_aliases_of_words(v):
    words = v.v_products.select("id", F.posexplode(F.split(F.concat("main_name", F.lit(" Olímpikus")), " ")).alias("place", "word"))
    return words.select("id", "place", D.brand_alias(F.col("word")).alias("alias"))


_LINK = "'?marca=' || coalesce(brand_slug, '') || ', ' || upper(coalesce(brand_slug, '')) || ',&cor=' || coalesce(name, '') || '&tamanho=' || CAST(id % 30 AS string) || ',' || CAST(id % 7 AS string) || CASE id % 3 WHEN 0 THEN '&busca=b' || CAST(id AS string) || '&q=x' WHEN 1 THEN '&q=q' || CAST(id AS string) ELSE '' END"


def _links(v):
    colors = v.v_colors.select(F.col("product_id").alias("id"), "name")
    return v.v_products.join(colors, "id").select("id", D.filters_of(F.expr(_LINK)).alias("f"))


_EXPECTED = f"""x AS (SELECT p.id, p.brand_slug, CASE WHEN trim(name) <> '' THEN {LABEL_SQL} END AS label FROM v_products p JOIN v_colors c ON c.product_id = p.id),
    e AS (SELECT *, nullif(replace({normal_sql('label')}, ' ', '-'), '') AS color FROM x)"""


@query("filters_from_links", f"""WITH {_EXPECTED} SELECT id, CASE WHEN brand_slug IS NULL THEN '' ELSE brand_slug || '|' || upper(brand_slug) END AS brands, coalesce(color, '') AS colors, (id % 30) || '|' || (id % 7) AS sizes,
    CASE id % 3 WHEN 0 THEN 'b' || id WHEN 1 THEN 'q' || id ELSE '' END AS text FROM e""")
def filters_from_links(v):
    return _links(v).select("id", F.array_join("f.marca", "|").alias("brands"), F.array_join("f.cor", "|").alias("colors"), F.array_join("f.tamanho", "|").alias("sizes"), "f.text")


@query("active_filters_of_links", f"WITH {_EXPECTED} SELECT id, CASE WHEN brand_slug IS NULL THEN 0 ELSE 2 END + CASE WHEN color IS NULL THEN 0 ELSE 1 END + 2 + CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END AS active FROM e")
def active_filters_of_links(v):
    return _links(v).select("id", D.active_filters(F.col("f"), F.when(F.col("id") % 4 == 1, F.lit(9.5))).alias("active"))


@query("favorite_ids_cleaned", "SELECT user_id, count(*) > 1000 AS rejected, CASE WHEN count(*) <= 1000 THEN count(DISTINCT product_id) END AS n_ids FROM (SELECT user_id, product_id FROM v_favorites UNION ALL SELECT user_id, product_id FROM v_favorites WHERE product_id % 2 = 0) x GROUP BY user_id")
def favorite_ids_cleaned(v):
    """Each user's saved ids as a browser would send them: padded, some twice."""
    own = F.col("product_id").cast("string")
    sent = v.v_favorites.select("user_id", F.explode(F.when(F.col("product_id") % 2 == 0, F.array(F.concat(F.lit(" "), own), F.concat(own, F.lit(" ")))).otherwise(F.array(own))).alias("sent"))
    payload = sent.groupBy("user_id").agg(F.collect_list("sent").alias("payload"))
    ids = D.cleaned_ids(F.col("payload"))
    return payload.select("user_id", ids.isNull().alias("rejected"), F.size(ids).cast("long").alias("n_ids"))


@query("metrics_clamped", "SELECT id, CAST(least(100, greatest(0, (current_price - 500) / 7)) AS DOUBLE) AS metric FROM v_catalog WHERE current_price IS NOT NULL AND total_reviews > 0 UNION ALL SELECT id, 0.0 FROM v_catalog WHERE current_price IS NULL OR total_reviews = 0")
def metrics_clamped(v):
    """Prices on a scale; nothing known, and a division by nothing, is 0."""
    value = F.when(F.col("total_reviews") == 0, float("inf")).otherwise((F.col("current_price").cast("double") - 500) / 7)
    return v.v_catalog.select("id", O.clamped(value).alias("metric"))
