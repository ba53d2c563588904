"""Queries of faceted filtering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import search_text
from ..functions.titles import RULES
from ..operators import facets as A
from ..registry import query
from .attributes import BUCKET_SQL, DISCOUNT_SQL, LABEL_SQL, RATINGS_SQL, SIZE_SQL, normal_sql, terms_sql

_BASE = f"""
    k AS (SELECT c.*, coalesce(b.name, 'Outras') AS marca, {DISCOUNT_SQL} AS d, coalesce(CAST(current_price AS DOUBLE), 0) AS price FROM v_catalog c LEFT JOIN v_brands b ON b.slug = c.brand_slug),
    l AS (SELECT product_id, nullif(replace({normal_sql('label')}, ' ', '-'), '') AS cor FROM (SELECT product_id, CASE WHEN trim(name) <> '' THEN {LABEL_SQL} END AS label FROM v_colors) y),
    f AS (SELECT k.id, k.price, k.marca, l.cor, {BUCKET_SQL} AS desconto, CASE WHEN coalesce(free_shipping, false) THEN 'Sim' ELSE 'Não' END AS frete, {SIZE_SQL} AS tamanho,
        {terms_sql('main_name', *RULES['gender'])} AS genero, {terms_sql('main_name', *RULES['age'])} AS idade, {terms_sql('main_name', *RULES['sport'])} AS modalidade,
        {terms_sql('main_name', *RULES['type'])} AS tipo, average_rating FROM k LEFT JOIN l ON l.product_id = k.id)"""
FILTERS = {"marca": ["Brand#1", "Brand#2", "Brand#3", "Brand#999"], "idade": ["Adulto"], "frete": ["Sim", "Não"], "tipo": ["Calçados"], "desconto": ["50% ou mais", "20% - 29%", "30% - 39%"]}
PRICE = (100.0, 1600.0)
_TESTS = {d: f"coalesce({d} IN ({', '.join(repr(x) for x in values)}), false)" for d, values in FILTERS.items()} | {"price": f"price BETWEEN {PRICE[0]} AND {PRICE[1]}"}


def _counts_sql(tests: dict[str, str], sticky: dict[str, list[str]]) -> str:
    """Each dimension by a query of its own, as the definition says."""
    parts = []
    for d in A.DIMENSIONS:
        value = f"unnest({RATINGS_SQL})" if d == "avaliacao" else d
        kept = " AND ".join([t for x, t in tests.items() if x != d] or ["true"])
        labels = list(A.FIXED.get(d, [])) + [x for x in sticky.get(d, []) if d in A.STICKY]
        zeros = "".join(f" UNION ALL SELECT '{x}', 0" for x in labels)
        parts.append(f"SELECT '{d}' AS dimension, value, sum(n)::BIGINT AS n FROM (SELECT value, 1 AS n FROM (SELECT {value} AS value FROM f WHERE {kept}) q WHERE value IS NOT NULL{zeros}) w GROUP BY value")
    kept = " AND ".join([t for x, t in tests.items() if x != "price"] or ["true"])
    parts.append(f"SELECT 'preco_min', '', coalesce(floor(min(price)), 0)::BIGINT FROM f WHERE price > 0 AND {kept}")
    parts.append(f"SELECT 'preco_max', '', coalesce(ceil(max(price)), 0)::BIGINT FROM f WHERE price > 0 AND {kept}")
    return f"WITH {_BASE} " + " UNION ALL ".join(parts)


def _faceted(v):
    brands = v.v_brands.select(F.col("slug").alias("brand_slug"), F.col("name").alias("brand_name"))
    colors = v.v_colors.groupBy("product_id").agg(F.collect_list("name").alias("colors"))
    return A.with_facets(v.v_catalog.join(brands, "brand_slug", "left").join(colors, F.col("id") == F.col("product_id"), "left"))


@query("apply_filters", f"WITH {_BASE} SELECT id FROM f WHERE {' AND '.join(_TESTS.values())}")
def apply_filters(v):
    return A.apply_filters(_faceted(v), FILTERS, PRICE).select("id")


@query("facet_counts", _counts_sql({}, {}))
def facet_counts(v):
    return A.facet_counts(_faceted(v))


@query("cross_facets", _counts_sql(_TESTS, FILTERS))
def cross_facets(v):
    return A.facet_counts(_faceted(v), FILTERS, PRICE)


@query("facet_order", f"""
    WITH {_BASE}, n AS (SELECT modalidade AS value, count(*) AS n FROM f WHERE modalidade IS NOT NULL GROUP BY 1)
    SELECT value, n, row_number() OVER (ORDER BY n DESC, value) AS place FROM n""")
def facet_order(v):
    from pyspark.sql import Window

    sports = A.facet_counts(_faceted(v)).where("dimension = 'modalidade'").select("value", "n")
    return sports.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")).cast("long"))  # a row per label


@query("pinned_brands", """
    WITH n AS (SELECT b.name AS brand, count(*) AS n FROM v_catalog c JOIN v_brands b ON b.slug = c.brand_slug GROUP BY b.name)
    SELECT p.brand, coalesce(n.n, 0) AS n, 0 AS tier FROM (VALUES ('Brand#2'), ('Brand#1'), ('Marca')) p(brand) LEFT JOIN n ON n.brand = p.brand
    UNION ALL SELECT brand, n, 1 FROM n WHERE brand NOT IN ('Brand#2', 'Brand#1', 'Marca') AND contains(lower(strip_accents(brand)), 'brand')""")
def pinned_brands(v):
    pins = v.spark.createDataFrame([("Brand#2", 0), ("Brand#1", 1), ("Marca", 2)], "brand string, pin int")
    counts = v.v_catalog.where("brand_slug is not null").groupBy(F.col("brand_slug").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    joined = counts.join(pins, "brand", "full")
    kept = joined.where(F.col("pin").isNotNull() | F.contains(search_text(F.col("brand")), F.lit("brand")))
    return kept.orderBy(F.col("pin").asc_nulls_last(), F.desc("n"), "brand").select("brand", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("pin").isNull(), 1).otherwise(0).alias("tier"))
