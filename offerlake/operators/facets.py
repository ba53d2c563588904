"""Faceted filtering: each row's value per dimension, filters, and counts under all filters but one's own.

Cross facets take one pass. A row notes which dimensions' filters it fails; it counts for a dimension if it
fails no other. So a row goes out once per value it has in the dimensions that may count it, and counts
are combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import offers as O
from ..functions import titles as T
from ..functions.text import search_text, slug

# The dimensions.
DIMENSIONS = ("marca", "cor", "desconto", "frete", "tamanho", "genero", "idade", "modalidade", "tipo", "avaliacao")
#: Dimensions of which every label has a count, and these labels.
FIXED = {"desconto": [x[0] for x in O.DISCOUNTS], "avaliacao": [x[0] for x in O.RATINGS], "frete": ["Sim", "Não"]}
#: Dimensions that list a selected value even if nothing is left of it.
STICKY = ("marca", "tamanho", "genero", "idade", "modalidade", "tipo")


def with_facets(products: DataFrame) -> DataFrame:
    """``facets``: a map of dimension to values; ``price`` as number. Reads the catalogue's columns and ``colors``."""
    title = F.col("main_name")
    one = lambda c: F.array_compact(F.array(c))
    discount = O.effective_discount(F.col("discount_percent"), F.col("current_price"), F.col("original_price"))
    color_names = F.array_distinct(F.array_compact(F.transform(F.coalesce("colors", F.array().cast("array<string>")), lambda c: slug(T.color_label(c)))))
    values = {
        "marca": one(F.coalesce("brand_name", F.lit("Outras"))), "cor": color_names, "desconto": one(O.discount_bucket(discount)),
        "frete": one(F.when(F.coalesce("free_shipping", F.lit(False)), "Sim").otherwise("Não")), "tamanho": one(T.size_of(title)),
        "genero": one(T.attribute(title, "gender")), "idade": one(T.attribute(title, "age")), "modalidade": one(T.attribute(title, "sport")),
        "tipo": one(T.attribute(title, "type")), "avaliacao": O.rating_buckets(F.col("average_rating")),
    }
    facets = F.struct(*[values[d].alias(d) for d in DIMENSIONS])
    return products.withColumn("facets", facets).withColumn("price", F.coalesce(F.col("current_price").cast("double"), F.lit(0.0)))


def _fails(filters: Mapping[str, Sequence[str]], price: tuple[float, float] | None) -> dict[str, Column]:
    failed = {d: ~F.arrays_overlap(F.col(f"facets.{d}"), F.array(*map(F.lit, values))) for d, values in filters.items() if values}
    if price is not None:
        failed["price"] = ~F.col("price").between(*price)
    return {d: F.coalesce(c, F.lit(True)) for d, c in failed.items()}


def apply_filters(faceted: DataFrame, filters: Mapping[str, Sequence[str]], price: tuple[float, float] | None = None) -> DataFrame:
    """Rows that pass every given dimension; several values of one are alternatives."""
    for failed in _fails(filters, price).values():
        faceted = faceted.where(~failed)
    return faceted


def facet_counts(faceted: DataFrame, filters: Mapping[str, Sequence[str]] | None = None, price: tuple[float, float] | None = None) -> DataFrame:
    """dimension, value, n: each dimension under all filters but its own; the least and greatest whole price too."""
    failed = _fails(filters or {}, price)
    total = sum((c.cast("int") for c in failed.values()), F.lit(0))
    others = lambda d: (total - failed[d].cast("int") if d in failed else total) == 0
    pairs = lambda d: F.transform(F.col(f"facets.{d}"), lambda x: F.struct(F.lit(d).alias("dimension"), x.alias("value")))
    empty = F.array().cast("array<struct<dimension:string,value:string>>")
    rows = faceted.select(F.explode(F.concat(*[F.when(others(d), pairs(d)).otherwise(empty) for d in DIMENSIONS])).alias("x")).select("x.*", F.lit(1).cast("long").alias("n"))
    always = [(d, label, 0) for d, labels in FIXED.items() for label in labels]
    always += [(d, value, 0) for d in STICKY for value in (filters or {}).get(d, ())]
    zeros = faceted.sparkSession.createDataFrame(always, "dimension string, value string, n long")
    prices = faceted.where((F.col("price") > 0) & others("price")).agg(F.min("price").alias("low"), F.max("price").alias("high"))
    bounds = F.array(
        F.struct(F.lit("preco_min").alias("dimension"), F.lit("").alias("value"), F.coalesce(F.floor("low"), F.lit(0)).cast("long").alias("n")),
        F.struct(F.lit("preco_max").alias("dimension"), F.lit("").alias("value"), F.coalesce(F.ceil("high"), F.lit(0)).cast("long").alias("n")),
    )
    counted = rows.unionByName(zeros).groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    return counted.unionByName(prices.select(F.explode(bounds).alias("x")).select("x.*"))


def color_labels(names: DataFrame) -> DataFrame:
    """value, label of the colours that names show."""
    label = T.color_label(F.col("name"))
    return names.select(slug(label).alias("value"), label.alias("label")).where("value is not null").groupBy("value").agg(F.min("label").alias("label"))


def with_places(counts: DataFrame, labels: DataFrame, fixed: Mapping[str, Sequence[str]]) -> DataFrame:
    """dimension, value, label, n, place: fixed orders where there are such, sizes as numbers, all else by count.

    Equal counts stand by their labels in Portuguese order, so accents and case part words last. A dimension's labels
    are few, so its window is small.
    """
    known = labels.select(F.lit("cor").alias("dimension"), "value", "label")
    rows = counts.where(F.col("dimension").isin(*DIMENSIONS)).join(F.broadcast(known), ["dimension", "value"], "left").withColumn("label", F.coalesce("label", "value"))
    place = F
    for dimension, values in fixed.items():
        for i, value in enumerate(values):
            place = place.when((F.col("dimension") == dimension) & (F.col("value") == value), i)
    sized = F.col("dimension") == "tamanho"
    order = [place.otherwise(None), F.when(sized, F.col("value").try_cast("double")), F.when(~sized, -F.col("n")), F.collate("label", "pt_CI_AI"), F.collate("label", "pt"), F.col("value")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("dimension").orderBy(*order)).cast("long"))


def brand_key(label: Column, aliases: Mapping[str, str]) -> Column:
    """What names of one brand share: no accents, case or outer spaces; a misspelling stands for the right name."""
    key = F.trim(search_text(label))
    for wrong, right in aliases.items():
        key = F.when(key == wrong, right).otherwise(key)
    return key


def pinned(counts: DataFrame, names: Sequence[str], aliases: Mapping[str, str], search: str = "") -> DataFrame:
    """label, n, pin: the pinned brands first (a pin's commonest label; none is 0), then the others by count, those whose names hold a search."""
    spark = counts.sparkSession
    pins = spark.createDataFrame([(name, i) for i, name in enumerate(names)], "name string, pin int").withColumn("key", brand_key(F.col("name"), aliases))
    keyed = counts.withColumn("key", brand_key(F.col("label"), aliases))
    best = keyed.join(F.broadcast(pins.select("key", "pin")), "key").withColumn("_nth", F.row_number().over(Window.partitionBy("pin").orderBy(F.desc("n"), "label"))).where("_nth = 1").select("pin", "label", "n")
    first = pins.join(best, "pin", "left").select(F.coalesce("label", "name").alias("label"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "pin")
    rest = keyed.join(F.broadcast(pins.select("key")), "key", "left_anti").select("label", "n", F.lit(None).cast("int").alias("pin"))
    found = first.unionByName(rest).where(F.contains(F.trim(search_text(F.col("label"))), F.trim(search_text(F.lit(search)))))
    return found.orderBy(F.col("pin").asc_nulls_last(), F.desc("n"), "label")
