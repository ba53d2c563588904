"""Whole records: log rows that are appended once, products with all that hangs on them, payloads with merged keys, masked rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns that a demonstration hides, and what it says instead.
HIDDEN = (
    "affiliateUrl", "affiliate_url", "originalUrl", "original_url", "itemUrl", "sourceUrl", "source_url", "rawUrl", "raw_url",
    "marketplaceName", "marketplace_name", "sellerName", "seller_name", "lastSeenAt", "last_seen_at", "referenceUrl",
)
DEMO_LABEL = "Loja demonstrativa"
COLOR_KEYS = ("marketplace_colors", "marketplace_color_audit")


def appended(log: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A log with new rows behind it; a row whose key is there already, or came twice, is taken once."""
    fresh = rows.dropDuplicates([key]).join(log.select(key), key, "left_anti")
    return log.unionByName(fresh.select(*log.columns))


def click_rows(clicks: DataFrame, offers: DataFrame) -> DataFrame:
    """The log row of each click (id, offer_id, referrer, agent, clicked_at) on an offer that is there and has an affiliate link."""
    linked = offers.where("affiliate_url <> ''").select(F.col("id").alias("offer_id"), "product_id")
    return clicks.join(linked, "offer_id").select("id", "offer_id", "product_id", F.col("referrer").alias("source_page_url"), F.col("agent").alias("user_agent"), F.lit(None).cast("string").alias("ip_hash"), "clicked_at")


def product_documents(products: DataFrame, offers: DataFrame, images: DataFrame, by: tuple[str, Sequence[str]] | None = None) -> DataFrame:
    """Products with their images (primary and lowest order first) and active offers (newest first) nested; all of them, or those with
    the given ids or slugs (``by`` names the column and the values)."""
    if by is not None:
        products = products.where(F.col(by[0]).isin(*by[1]))
        wanted = products.select(F.col("id").alias("product_id"))
        offers, images = offers.join(wanted, "product_id", "left_semi"), images.join(wanted, "product_id", "left_semi")
    shown = images.select("product_id", F.struct((~F.col("is_primary")).alias("rest"), "sort_order", "url", "alt").alias("x")).groupBy("product_id").agg(F.sort_array(F.collect_list("x")).alias("images"))
    age = (-F.unix_micros(F.col("last_seen_at").cast("timestamp"))).alias("age")
    live = offers.where("status = 'active'").select("product_id", F.struct(age, "id", "current_price", "original_price", "discount_percent", "free_shipping", "affiliate_url").alias("x"))
    nested = live.groupBy("product_id").agg(F.sort_array(F.collect_list("x")).alias("offers"))
    joined = products.join(shown, F.col("id") == shown.product_id, "left").drop("product_id").join(nested, F.col("id") == nested.product_id, "left").drop("product_id")
    names = ("id", "current_price", "original_price", "discount_percent", "free_shipping", "affiliate_url")
    return joined.withColumn("images", F.transform("images", lambda x: F.struct(x.url.alias("url"), x["alt"].alias("alt"), (~x.rest).alias("is_primary")))).withColumn("offers", F.transform("offers", lambda x: F.struct(*[x[n].alias(n) for n in names])))


def with_keys(payload: Column, new: dict[str, Column]) -> Column:
    """A JSON object with keys replaced by JSON texts; the others keep their values, of whatever kind.

    Null, and a payload that is no object, is taken as an empty one. A null text is a JSON null.
    """
    held = F.coalesce(F.from_json(payload, "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    kept = F.map_filter(held, lambda k, _: ~k.isin(*new))
    values = [x for k, v in new.items() for x in (F.lit(k), F.parse_json(F.coalesce(v, F.lit("null"))))]
    return F.to_json(F.map_concat(kept, F.create_map(*values)))


def masked(rows: DataFrame, label: str = DEMO_LABEL) -> DataFrame:
    """Rows for a demonstration: links, sellers, shops and times blank, a label beside them."""
    blank = {c: F.lit(None).cast(rows.schema[c].dataType) for c in rows.columns if c in HIDDEN}
    return rows.withColumns({**blank, "store_label": F.lit(label), "demonstrative": F.lit(True)})


def last_batches(sources: DataFrame, batches: DataFrame, members: DataFrame) -> DataFrame:
    """Sources with their last batch and how many members are active: one aggregate each, no query a source."""
    last = batches.groupBy("source_id").agg(F.max_by(F.struct("batch_id", "status", "total_collected", "finished_at"), F.struct("finished_at", "batch_id")).alias("last_batch"))
    stats = members.groupBy("source_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("is_active").alias("active"))
    joined = sources.join(last, F.col("id") == last.source_id, "left").drop("source_id").join(stats, F.col("id") == stats.source_id, "left").drop("source_id")
    none = F.lit(0).cast("long")
    return joined.withColumn("total", F.coalesce("total", none)).withColumn("active", F.coalesce("active", none)).withColumn("inactive", F.col("total") - F.col("active"))


def place_letters(place: Column) -> Column:
    """A, B, ... Z, AA, AB, ... for 1, 2, ...; up to 18,278 places."""
    letter = lambda n: F.char(F.lit(65) + n)
    n = place - 1
    two, three = n - 26, n - 26 - 26 * 26
    return (
        F.when(n < 26, letter(n)).when(two < 26 * 26, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
        .otherwise(F.concat(letter(F.floor(three / 676)), letter(F.floor(three / 26) % 26), letter(three % 26)))
    )
