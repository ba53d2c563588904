"""Nested documents of products: comparable attributes and summaries, favourite cards, filters of links, snapshots, hero products."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import offers as O
from ..functions import text as X
from ..functions import titles as T

Extractor = Callable[[Column], Column]

#: Attributes that titles give, by name; an extractor maps a title to an array of (value, label).
EXTRACTORS: dict[str, Extractor] = {"color": lambda title: F.transform(T.title_colors(title), lambda c: F.struct(X.slug(c).alias("value"), c.alias("label")))}
# Brands looked for in titles of the item interface, and where colours may come from.
ITEM_BRANDS = ("nike", "adidas", "puma", "mizuno", "asics", "olympikus", "fila", "reebok", "new balance", "under armour", "vans", "converse")
COLOR_SOURCES = ("marketplace_attribute", "marketplace_variation")
URL_FILTERS = ("marca", "cor", "desconto", "frete", "tamanho", "genero", "idade", "modalidade", "tipo", "avaliacao")


def extracted(title: Column, extractors: dict[str, Extractor] | None = None) -> Column:
    """A map of attribute to what its extractor found, without the empty ones."""
    found = extractors or EXTRACTORS
    pairs = [x for name, extract in found.items() for x in (F.lit(name), extract(title))]
    return F.map_filter(F.create_map(*pairs), lambda _, values: F.size(values) > 0)


def item_brand(attributes: Column, title: Column) -> Column:
    """The brand attribute, else the first brand in the title with its first letter upper, else 'Outra'."""
    own = F.get(F.filter(attributes, lambda a: (a.id == "BRAND") | (a.name == "Marca")), F.lit(0)).value_name
    named = T.first_rule(title, [(b[:1].upper() + b[1:], (b,)) for b in ITEM_BRANDS])
    return F.coalesce(F.nullif(own, F.lit("")), named, F.lit("Outra"))


def brand_alias(name: Column) -> Column:
    """Lower-case without accents; one misspelling is the brand that it means."""
    plain = X.search_text(name)
    return F.when(plain == "olimpikus", "olympikus").otherwise(plain)


def raw_colors(raw: Column) -> Column:
    """The official colours of a raw JSON record: (value, name, source), the last of each value."""
    kind = "struct<marketplace_colors:array<struct<name:string,source:string>>>"
    named = F.transform(F.from_json(raw, kind).marketplace_colors, lambda c: F.struct(X.slug(T.clean_color(c["name"])).alias("value"), T.clean_color(c["name"]).alias("name"), c.source.alias("source")))
    valid = F.filter(named, lambda c: c.value.isNotNull() & c.source.isin(*COLOR_SOURCES))
    return last_of_each(valid)


def last_of_each(items: Column) -> Column:
    """Of items with equal ``value``, the last, at the place of the first."""
    values = F.array_distinct(F.transform(items, lambda c: c.value))
    return F.transform(values, lambda x: F.element_at(F.filter(items, lambda c: c.value == x), -1))


def color_set(names: Column, primary: Column) -> Column:
    """(value, label) of a product's colours, the last label of each value; the primary colour if there is none."""
    translated = lambda n: F.struct(X.slug(T.color_label(n)).alias("value"), T.color_label(n).alias("label"))
    known = lambda xs: F.filter(xs, lambda c: c.value.isNotNull())
    own = last_of_each(known(F.transform(names, translated)))
    return F.when(F.size(own) > 0, own).otherwise(known(F.array(translated(primary))))


def positive(x: Column) -> Column:
    number = x.try_cast("double")
    return F.when((number > 0) & ~F.isnan(number) & (number < float("inf")), number)


def present(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def card_discount(informed: Column, current: Column, original: Column) -> tuple[Column, Column]:
    """The discount and where it is from: an informed one of 0 to 100, else that of the prices."""
    valid = F.when(informed.between(0, 100), informed.cast("double"))
    now, before = positive(current), positive(original)
    priced = F.when(valid.isNull() & (before > now), F.floor((before - now) / before * 100 + 0.5).cast("double"))
    return F.coalesce(valid, priced), F.when(valid.isNotNull(), "informed").when(priced.isNotNull(), "calculated")


def favorite_discount(informed: Column, current: Column, original: Column) -> Column:
    """The informed discount unless it is 0 or missing, without a cap; else that of the prices, else 0."""
    now, before = F.coalesce(current.cast("double"), F.lit(0.0)), original.cast("double")
    priced = F.when((before > 0) & (before > now), F.floor((before - now) / before * 100 + 0.5).cast("double"))
    return F.coalesce(F.nullif(informed.cast("double"), F.lit(0.0)), priced, F.lit(0.0))


def comparable_attributes(title: Column, names: Column, primary: Column) -> Column:
    """A product's attributes, each with where it is from."""
    inferred = lambda c: F.when(c.isNotNull(), F.struct(c.alias("value"), c.alias("label"), F.lit("title_inference").alias("provenance")))
    sport, age = T.attribute(title, "sport"), T.attribute(title, "age")
    colors = color_set(names, primary)
    return F.struct(
        F.when(F.size(colors) > 0, F.transform(colors, lambda c: F.struct(c.value.alias("value"), c.label.alias("label"), F.lit("catalog").alias("provenance")))).alias("colors"),
        inferred(T.size_of(title)).alias("size"), inferred(T.attribute(title, "gender")).alias("gender"), inferred(F.when(age == "Infantil", age)).alias("age_group"),
        inferred(F.when(sport != "Casual", sport)).alias("sport"), inferred(F.when(sport == "Casual", sport)).alias("usage"),
    )


def comparable(catalog: DataFrame) -> DataFrame:
    """id, ``product`` and ``offer``: summaries in which what is no valid number or text is null; no offer where there is none."""
    discount, source = card_discount(F.col("discount_percent"), F.col("current_price"), F.col("original_price"))
    reviews = F.col("total_reviews").try_cast("double")
    product = F.struct("id", F.col("main_name").alias("title"), present(F.col("main_image_url")).alias("image"), present(F.col("brand_slug")).alias("brand"), positive(F.col("average_rating")).alias("rating"), F.when(reviews >= 0, F.floor(reviews).cast("long")).alias("reviews"))
    offer = F.struct(present(F.col("offer_id")).alias("id"), positive(F.col("current_price")).alias("price"), positive(F.col("original_price")).alias("original_price"), discount.alias("discount"), source.alias("discount_source"), "free_shipping", F.lit("unknown").alias("availability"))
    return catalog.select("id", product.alias("product"), F.when(F.col("offer_id").isNotNull(), offer).alias("offer"))


def favorite_cards(catalog: DataFrame) -> DataFrame:
    price = lambda c: F.col(c).cast("double")
    discount = O.effective_discount(F.col("discount_percent"), F.col("current_price"), F.col("original_price"))
    return catalog.select("id", F.col("main_name").alias("name"), F.coalesce("brand_name", F.lit("Outras")).alias("brand"), F.coalesce(price("current_price"), F.lit(0.0)).alias("price"), price("original_price").alias("old_price"), discount.alias("discount"), F.coalesce("main_image_url", F.lit("")).alias("image"), F.coalesce("affiliate_url", F.lit("#")).alias("link"), F.coalesce("free_shipping", F.lit(False)).alias("free_shipping"), "average_rating", "total_reviews")


def filters_of(query: Column) -> Column:
    """The filter lists and the search text of a link's parameters; colours by their value, ``busca`` before ``q``."""
    values = F.str_to_map(F.regexp_replace(query, r"^\?", ""), F.lit("&"), F.lit("="))

    def listed(key: str) -> Column:
        items = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(values, F.lit(key)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
        return F.array_compact(F.transform(items, lambda x: X.slug(T.color_label(x)))) if key == "cor" else items

    text = F.coalesce(F.try_element_at(values, F.lit("busca")), F.try_element_at(values, F.lit("q")), F.lit(""))
    return F.struct(*[listed(k).alias(k) for k in URL_FILTERS], text.alias("text"))


def active_filters(filters: Column, price: Column) -> Column:
    """How many values are chosen; a price range is one."""
    total = price.isNotNull().cast("int")
    for key in URL_FILTERS:
        total = total + F.size(filters[key])
    return total


def cleaned_ids(payload: Column, longest: int = 36, most: int = 1000) -> Column:
    """The payload's distinct trimmed ids; null, for rejected, if it has too many."""
    ids = F.filter(F.transform(payload, lambda x: F.trim(x)), lambda x: x.isNotNull() & F.length(x).between(1, longest))
    return F.when(F.size(payload) <= most, F.array_distinct(ids))


# What a better product may cost more, by how many better criteria, and by how much its score must lead.
LEAD = 0.5
WORTH = ((50, 15, 3), (100, 10, 2))
TOO_DEAR, FEW_ADVANTAGES, LEAST_COMPARABLE = (200, 30), 1, 2


def worth_paying(scored: DataFrame, criteria: Sequence[str] = ("discount", "rating", "reviews", "shipping")) -> DataFrame:
    """Per cohort, whether its one winner is worth more than its one cheapest: YES, NO or DEPENDS. Needs the leader columns."""
    side = F.struct("product_id", F.col("current_price").cast("double").alias("price"), F.col("rounded").alias("score"), *[F.col(f"n_{c}") for c in criteria])
    pick = lambda name: F.max(F.when(F.col(f"{name}_leader") & ~F.col(f"{name}_tie"), side))
    both = scored.groupBy("cohort_id").agg(pick("score").alias("w"), pick("price").alias("c"))
    known = (F.col("w.price") > 0) & (F.col("c.price") > 0)
    more = F.when(known, F.greatest(F.lit(0.0), F.col("w.price") - F.col("c.price")))
    share = more / F.col("c.price") * 100

    def compared(sign: int) -> Column:
        hits = [F.when(known & (sign * (F.col(f"w.n_{c}") - F.col(f"c.n_{c}")) > 1e-6), c) for c in criteria]
        return F.array_compact(F.array(*hits))

    both = both.select("cohort_id", "w", "c", more.alias("more"), share.alias("share"), compared(1).alias("better"), compared(-1).alias("worse"), sum((F.when(known & F.col(f"w.n_{c}").isNotNull() & F.col(f"c.n_{c}").isNotNull(), 1).otherwise(0) for c in criteria), F.lit(0)).alias("comparable"))
    n = F.size("better")
    allowed = F.lit(False)
    for most, share_most, least in WORTH:
        allowed |= (F.col("more") <= most) & (F.col("share") <= share_most) & (n >= least)
    yes = (F.size("worse") == 0) & (F.col("w.score") - F.col("c.score") >= LEAD) & allowed
    no = ((F.col("more") > TOO_DEAR[0]) | (F.col("share") > TOO_DEAR[1])) & (n <= FEW_ADVANTAGES)
    verdict = F.when(F.col("more").isNull(), "DEPENDS").when((F.col("w.product_id") == F.col("c.product_id")) | (F.col("more") <= 1e-6), "NO").when(F.col("comparable") < LEAST_COMPARABLE, "DEPENDS").when(yes, "YES").when(no, "NO").otherwise("DEPENDS")
    return both.select("cohort_id", verdict.alias("verdict"), "more", "share", "better", "worse", "comparable")


def heroes(products: DataFrame, anchors: Sequence[str], generic: Sequence[str], n: int = 3, exact: bool = False) -> DataFrame:
    """n products: the best discounted of each anchor brand that is left, then of the known brands, then of any.

    products: id, brand, discount. One pass ranks each tier's first n before the shuffle; these few rows meet in one array, along
    which the places are given.
    """
    name = F.coalesce("brand", F.lit("")) if exact else brand_alias(F.coalesce("brand", F.lit("")))
    tiers = [(name == a) if exact else F.contains(name, F.lit(a)) for a in anchors] + [~F.lower(name).isin(*generic), F.lit(True)]
    fits = F.array_compact(F.array(*[F.when(c, i) for i, c in enumerate(tiers)]))
    ranked = products.select("id", "brand", "discount", F.explode(fits).alias("tier"))
    first = ranked.withColumn("_nth", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("discount"), "id"))).where(F.col("_nth") <= n)
    row = F.struct("tier", (-F.col("discount")).alias("rank"), "id", "brand", "discount")
    few = first.agg(F.sort_array(F.collect_list(row)).alias("rows"))  # n a tier
    none = F.slice("rows", 1, 0)

    def placed(chosen: Column, x: Column) -> Column:
        known = F.exists(chosen, lambda y: (y["id"] == x["id"]) | ((y["tier"] == x["tier"]) & (x["tier"] < len(anchors))))
        return F.when((F.size(chosen) >= n) | known, chosen).otherwise(F.concat(chosen, F.array(x)))

    chosen = few.select(F.aggregate("rows", none, placed).alias("chosen"))
    return chosen.select(F.posexplode("chosen").alias("at", "x")).select((F.col("at") + 1).alias("place"), "x.id", "x.brand", "x.discount")


SNAPSHOT = "struct<productId:string,selectedAt:string,snapshot:struct<product:struct<id:string,title:string,rating:double>,selectedAt:string>>"


def valid_snapshots(rows: DataFrame, most: int = 3) -> DataFrame:
    """Comparison documents (owner, place, document) that hold together: named, dated, wrapper and snapshot agreeing; the first of
    each product and at most so many an owner."""
    doc = F.from_json("document", SNAPSHOT)
    read = rows.select("owner", "place", doc.alias("d"))
    dated = F.try_to_timestamp(F.col("d.selectedAt")).isNotNull()
    sound = (F.trim("d.snapshot.product.title") != "") & (F.trim("d.productId") != "") & (F.col("d.productId") == F.col("d.snapshot.product.id")) & dated & (F.col("d.selectedAt") == F.col("d.snapshot.selectedAt"))
    sound = sound & (F.col("d.snapshot.product.rating").isNull() | F.col("d.snapshot.product.rating").between(0, 5))
    kept = read.where(F.coalesce(sound, F.lit(False)))
    first = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("owner", "d.productId").orderBy("place"))).where("_nth = 1")
    few = first.withColumn("_nth", F.row_number().over(Window.partitionBy("owner").orderBy("place"))).where(F.col("_nth") <= most)
    return few.select("owner", "place", F.col("d.productId").alias("product_id"))
