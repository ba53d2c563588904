"""Catalogue operators: best offers, dimensions, filters, pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_path


def first_rows(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; Spark prunes ranks before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def best_offers(offers: DataFrame) -> DataFrame:
    """Per product, the active offer with the highest discount (none last), then the lowest price."""
    order = [F.col("discount_percent").desc_nulls_last(), F.col("current_price").asc_nulls_last(), F.col("id")]
    best = first_rows(offers.where("status = 'active'"), ["product_id"], order)
    return best.select("product_id", F.col("id").alias("offer_id"), "marketplace_id", "original_price", "current_price", "discount_percent", "free_shipping", "last_seen_at")


def offer_counts(offers: DataFrame) -> DataFrame:
    return offers.where("status = 'active'").groupBy("product_id").agg(F.count(F.lit(1)).alias("offer_count"))


def with_dimensions(products: DataFrame, brands: DataFrame, categories: DataFrame) -> DataFrame:
    """Left joins to the dimension tables; their size decides the strategy."""
    b = brands.select(F.col("slug").alias("brand_slug"), F.col("name").alias("brand_name"))
    c = categories.select(F.col("slug").alias("category_slug"), F.col("name").alias("category_name"))
    return products.join(b, "brand_slug", "left").join(c, "category_slug", "left")


def with_offers(products: DataFrame, offers: DataFrame) -> DataFrame:
    joined = products.join(best_offers(offers), F.col("id") == F.col("product_id"), "left").drop("product_id")
    counts = offer_counts(offers)
    return joined.join(counts, F.col("id") == F.col("product_id"), "left").drop("product_id").withColumn("offer_count", F.coalesce("offer_count", F.lit(0).cast("long")))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def product_filter(category: str | None = None, brand: str | None = None, status: str | None = None, like: str | None = None, ilike: str | None = None) -> Column:
    """Predicates for those given, ANDed; wildcards in the search texts stay wildcards."""
    given = []
    if category is not None:
        given.append(F.col("category_slug") == category)
    if brand is not None:
        given.append(F.col("brand_slug") == brand)
    if status is not None:
        given.append(F.col("catalog_status") == status)
    if like is not None:
        given.append(F.col("main_name").like(f"%{like}%"))
    if ilike is not None:
        given.append(F.col("main_name").ilike(f"%{ilike}%"))
    return all_of(given)


def page(df: DataFrame, order: Sequence[Column], page_no: int = 1, size: int = 20, largest: int = 100) -> DataFrame:
    """One page of a total order; page numbers start at 1 and sizes are clamped."""
    size = max(1, min(largest, size))
    return df.orderBy(*order).offset((max(1, page_no) - 1) * size).limit(size)


def page_count(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("long")


def staged(df: DataFrame, name: str) -> DataFrame:
    """A table written in the shared folder and read again: what several plans start from is made once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """All rows in a total order, with ``place`` from 1: sorted by range, numbered within each part, and moved on by the rows of
    the parts before. The sorted rows are staged, so that both passes see the same parts."""
    path = shared_path(df.sparkSession, "placed")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return rows.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("place", F.col("_before") + within + 1).drop("_at", "_part", "_before")


SORTS = ("highest_discount", "relevance", "lowest_price", "most_recent")


def sort_keys(mode: str) -> list[Column]:
    """The order of a sort mode; relevance keeps the order in which the rows came."""
    keys = {"highest_discount": ("discount_percent", False), "lowest_price": ("current_price", True), "most_recent": ("created_at", False)}
    if mode == "relevance":
        return []
    name, ascending = keys[mode]
    return [F.col(name).asc_nulls_last() if ascending else F.col(name).desc_nulls_last()]


def sorted_by(df: DataFrame, mode: str, api_rank: str = "api_rank") -> DataFrame:
    """A sort mode, stable over the rank in which the rows came."""
    return df.orderBy(*sort_keys(mode), F.col(api_rank))


def product_detail(products: DataFrame, offers: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Products with their active offers nested, newest first; all products, or those with the ids."""
    wanted = products if ids is None else products.where(F.col("id").isin(*ids))
    active = offers.where("status = 'active'")
    if ids is not None:
        active = active.where(F.col("product_id").isin(*ids))
    nested = active.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("last_seen_at").cast("timestamp"))).alias("age"), F.col("id").alias("offer_id"), "current_price"))).alias("offers"))
    return wanted.join(nested, F.col("id") == F.col("product_id"), "left").drop("product_id")


def labels_brl(price: Column) -> Column:
    """R$ 1234,56; a dash for none."""
    return F.when(price.isNull(), "-").otherwise(F.concat(F.lit("R$ "), F.translate(price.cast("decimal(12,2)").cast("string"), ".", ",")))


def localized_brl(price: Column) -> Column:
    """R$ 1.234,56; a dash for none."""
    return F.when(price.isNull(), "-").otherwise(F.concat(F.lit("R$ "), F.translate(F.format_number(price.cast("decimal(12,2)"), 2), ",.", ".,")))
