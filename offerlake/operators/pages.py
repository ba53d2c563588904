"""Listing pages as tables: cards and their fields, page audits, crawl order. Built-in functions only.

Markup is read with patterns over the page text, so that a page is a row of a scan like any other; entities in
texts stay as they are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.offers import collected_discount
from .catalog import staged

# The classes that a card's parts have, and phrases of pages and cards.
CARD = r'(?=<div[^>]*class="(?:[^"]* )?poly-card[ "])'
FREE_SHIPPING = ("frete gratis", "envio gratis", "chegara gratis")
BLOCKED = ("access denied", "pardon our interruption", "account-verification")
EMPTY = ("nao encontramos produtos", "nao ha produtos", "nenhum produto encontrado")
NEXT_LINK = r"""(?s)<a\b(?=[^>]*(?:andes-pagination__link|aria-label="[^"]*página|aria-label="Seguinte"|aria-label="Próximo"))(?=[^>]*href="[^"]*(?i:page=\d))"""
# The kinds of cards that brand stores have had, in the order in which they are tried.
STORE_CARDS = (
    r'(?=<div[^>]*class="(?:[^"]* )?poly-card--grid-card[ "])', r"""(?=<a[^>]*data-component-type=["']product-card["'])""", r"(?=<article(?=[ >])(?![^>]*ui-search-result))",
    r'(?=<article[^>]*class="(?:[^"]* )?ui-search-result[ "])', r'(?=<li[^>]*class="(?:[^"]* )?ui-search-layout__item[ "])', r'(?=<div[^>]*class="(?:[^"]* )?item[ "])',
    r'(?=<div[^>]*class="(?:[^"]* )?s-result-item[ "])', r'(?=<div[^>]*class="[^"]*product-card)',
)
STATE = "struct<searchState:struct<itemsResponse:struct<results:array<struct<id:string,title:string,url:string,prices:struct<id:bigint,prices:struct<currentPrice:string,originalPrice:string,discountPercent:int>>,freeShipping:boolean>>>>>"
MIN_TITLE = 5
MIN_LENGTH, MIN_DISCOUNT, MAX_PAGES, SIGNATURE = 5000, 25, 25, 5


def _inside(card: Column, name: str, within: str = "") -> Column:
    """The trimmed text of the first element of a class, after one of another class if given; empty if there is none."""
    lead = rf'class="(?:[^"]* )?{within}[ "].*?' if within else ""
    return F.trim(F.regexp_extract(card, rf'(?s){lead}class="(?:[^"]* )?{name}(?: [^"]*)?"[^>]*>([^<]*)<', 1))


def _split(html: Column, marker: str) -> Column:
    """The parts of a text that start with a marker."""
    return F.slice(F.split(F.concat(F.lit(" "), html), marker), 2, 1 << 20)


def raw_cards(pages: DataFrame) -> DataFrame:
    """source_id, page_no, position and the texts of each card's parts."""
    body = F.substring_index("html", '<nav class="andes-pagination', 1)
    cards = pages.select("source_id", "page_no", F.posexplode(_split(body, CARD)).alias("position", "card"))
    card = F.col("card")
    return cards.select(
        "source_id", "page_no", "position",
        _inside(card, "poly-component__title").alias("title"),
        F.substring_index(F.regexp_extract(card, r'(?s)<a\b[^>]*?href="([^"]*)"', 1), "#", 1).alias("url"),
        F.regexp_extract(card, r'(?s)<img[^>]*class="(?:[^"]* )?poly-component__picture[ "][^>]*src="([^"]*)"', 1).alias("image"),
        _inside(card, "andes-money-amount__fraction", "poly-price__current").alias("fraction"),
        _inside(card, "andes-money-amount__cents", "poly-price__current").alias("cents"),
        _inside(card, "andes-money-amount__fraction", "andes-money-amount--previous").alias("old_fraction"),
        _inside(card, "andes-money-amount__cents", "andes-money-amount--previous").alias("old_cents"),
        _inside(card, "poly-price__disc_label").alias("label"),
        _inside(card, "poly-component__brand").alias("brand"),
        _inside(card, "poly-reviews__rating").alias("rating"),
        _inside(card, "poly-reviews__total").alias("reviews"),
        _inside(card, "poly-component__shipping").alias("shipping"),
        _inside(card, "poly-price__installments").alias("installments"),
        _inside(card, "poly-component__highlight").alias("highlight"),
        card.rlike('class="(?:[^"]* )?(?:poly-component__highlight-countdown|poly-highlight-countdown__text)[ "]').alias("countdown"),
        F.regexp_replace(card, "<[^>]*>", "").alias("plain"),
    )


def free_shipping(shipping: Column, plain: Column) -> Column:
    """A free-shipping phrase in the shipping part, or anywhere in the card without regard to accents."""
    own, text = F.lower(shipping), X.search_text(plain)
    found = F.contains(own, F.lit("grátis")) | F.contains(own, F.lit("gratis"))
    for phrase in FREE_SHIPPING:
        found |= F.contains(text, F.lit(phrase))
    return found


def promotion(countdown: Column, highlight: Column) -> Column:
    badge = F.upper(highlight)
    has = lambda s: F.contains(badge, F.lit(s))
    return F.when(countdown, "lightning").when(has("OFERTA DO DIA"), "deal_of_day").when(has("OFERTA RELÂMPAGO") | has("RELAMPAGO"), "lightning").otherwise("general")


def parsed_cards(pages: DataFrame, least_discount: int | None = MIN_DISCOUNT, derive: bool = True) -> DataFrame:
    """The items of each page: named, priced, discounted enough (unless no floor is set), the first of each key."""
    price = lambda whole, part: X.price_of_parts(F.nullif(F.col(whole), F.lit("")), F.col(part))
    cards = raw_cards(pages).select(
        "source_id", "page_no", "position", "title", "url", X.item_id(F.col("url")).alias("external_id"), F.nullif("image", F.lit("")).alias("image"),
        price("fraction", "cents").alias("price"), price("old_fraction", "old_cents").alias("original_price"), X.percent_in(F.col("label")).alias("informed"),
        F.coalesce(F.nullif("brand", F.lit("")), F.lit("N/A")).alias("brand"), X.rating_in(F.col("rating")).alias("rating"), X.review_count_in(F.col("reviews")).alias("reviews"),
        free_shipping(F.col("shipping"), F.col("plain")).alias("free_shipping"), "installments", promotion(F.col("countdown"), F.col("highlight")).alias("promotion_type"),
    ).where((F.col("title") != "") & (F.col("price") > 0))
    discount = collected_discount(F.col("informed"), F.col("price"), F.col("original_price")) if derive else F.col("informed")
    cards = cards.withColumn("discount", discount).drop("informed").withColumn("content_hash", X.content_hash32(F.col("title"), F.col("price")))
    if least_discount is not None:
        cards = cards.where(F.col("discount") >= least_discount)
    return first_cards(cards, ["source_id", "page_no"])


def first_cards(cards: DataFrame, within: list[str]) -> DataFrame:
    """The first card, by page and position, of each item (its id, else its hash)."""
    key = F.coalesce("external_id", "content_hash")
    order = F.row_number().over(Window.partitionBy(*within, key).orderBy("page_no", "position"))
    return cards.withColumn("_nth", order).where("_nth = 1").drop("_nth")


def audited(pages: DataFrame, cards: DataFrame | None = None) -> DataFrame:
    """Per page: blocked, empty_state, has_next, raw_cards, parsed_cards and what is wrong with it. Its parsed cards may be given."""
    html = F.col("html")
    low = F.lower(html)
    blocked = F.length(html) < MIN_LENGTH
    for phrase in BLOCKED:
        blocked |= F.contains(low, F.lit(phrase))
    blocked |= F.contains(low, F.lit("captcha")) & F.contains(low, F.lit("verify"))
    plain = X.search_text(html)
    empty = F.lit(False)
    for phrase in EMPTY:
        empty |= F.contains(plain, F.lit(phrase))
    told = pages.select("source_id", "page_no", F.coalesce(blocked, F.lit(True)).alias("blocked"), empty.alias("empty_state"), html.rlike(NEXT_LINK).alias("has_next"), F.size(_split(html, CARD)).alias("raw_cards"))
    parsed = (parsed_cards(pages) if cards is None else cards).groupBy("source_id", "page_no").agg(F.count(F.lit(1)).cast("int").alias("parsed_cards"))
    joined = told.join(parsed, ["source_id", "page_no"], "left").withColumn("parsed_cards", F.coalesce("parsed_cards", F.lit(0)))
    return joined.withColumn("error", F.when((F.col("raw_cards") == 0) & ~F.col("empty_state"), "unrecognised_markup"))


def crawl_prefix(pages: DataFrame) -> DataFrame:
    """The pages that a crawl keeps, source by source: up to one without cards or like the one before it (both go), one without
    a link to the next, or the last allowed one."""
    cards = staged(parsed_cards(pages).select("source_id", "page_no", "position", "content_hash"), "cards")  # pages are parsed once
    items = cards.groupBy("source_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("position", "content_hash"))).alias("items"))  # a page has few cards
    signature = items.select("source_id", "page_no", F.slice(F.col("items.content_hash"), 1, SIGNATURE).alias("signature"))
    facts = audited(pages, cards).join(signature, ["source_id", "page_no"], "left").where(F.col("page_no") <= MAX_PAGES)
    order = Window.partitionBy("source_id").orderBy("page_no")  # MAX_PAGES rows at most
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("again", F.coalesce(F.col("signature") == F.last("signature", ignorenulls=True).over(before), F.lit(False)))
    facts = facts.withColumn("out", (F.col("raw_cards") == 0) | F.col("again"))
    stopped = F.coalesce(F.max(F.col("out") | ~F.col("has_next")).over(before), F.lit(False))
    return facts.withColumn("_stopped", stopped).where("not _stopped and not out").select("source_id", "page_no", "raw_cards", "parsed_cards")


def page_url(url: Column, page: Column) -> Column:
    """The address of a page: any page parameter is replaced, the first page has none, the fragment stays last."""
    base, mark = F.substring_index(url, "#", 1), F.when(F.contains(url, F.lit("#")), F.regexp_extract(url, "(?s)#.*$", 0)).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(base, r"([?&])page=[^&]*(?:&|$)", "$1"), "[?&]$", "")
    more = F.concat(F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("page="), page.cast("string"))
    return F.concat(bare, F.when(page <= 1, "").otherwise(more), mark)


def store_items(pages: DataFrame) -> DataFrame:
    """Items of brand stores: those of the embedded state, or else of the first kind of card that gives any. ``tried`` is 0 for the state."""
    state = F.from_json(F.regexp_extract("html", r"(?s)window\.__PRELOADED_STATE__\s*=\s*(\{.*?\});", 1), STATE)
    records = pages.select("source_id", "page_no", F.posexplode(state.searchState.itemsResponse.results).alias("position", "x"))
    now = F.col("x.prices.prices.currentPrice").try_cast("double")
    informed = records.where("x.title <> '' and x.id is not null and coalesce(x.prices.id, 0) >= 0").select(
        "source_id", "page_no", F.lit(0).alias("tried"), "position", "x.title", F.coalesce("x.url", F.lit("")).alias("url"), F.col("x.id").alias("external_id"), now.alias("price"),
        F.coalesce(F.col("x.prices.prices.originalPrice").try_cast("double"), now).alias("original_price"), F.nullif("x.prices.prices.discountPercent", F.lit(0)).alias("discount"), F.coalesce("x.freeShipping", F.lit(False)).alias("free_shipping"),
    ).where("price > 0")
    # A page whose state gives an item is not split at all.
    told = F.exists(F.coalesce(state.searchState.itemsResponse.results, F.array()), lambda x: F.coalesce((x.title != "") & x.id.isNotNull() & (F.coalesce(x.prices.id, F.lit(0)) >= 0) & (x.prices.prices.currentPrice.try_cast("double") > 0), F.lit(False)))
    kinds = F.array(*[_split(F.col("html"), marker) for marker in STORE_CARDS])
    cards = pages.where(~F.coalesce(told, F.lit(False))).select("source_id", "page_no", F.posexplode(kinds).alias("kind", "cards")).select("source_id", "page_no", (F.col("kind") + 1).alias("tried"), F.posexplode("cards").alias("position", "card"))
    card = F.col("card")
    title = F.trim(F.coalesce(*[F.nullif(_inside(card, c), F.lit("")) for c in ("poly-component__title", "ui-search-result__title")], F.regexp_extract(card, "(?s)<h2[^>]*>([^<]*)<", 1)))
    whole = lambda *places: F.coalesce(*[F.nullif(_inside(card, *p), F.lit("")) for p in places])
    price = X.price_of_parts(whole(("andes-money-amount__fraction", "poly-price__current"), ("price-tag", "ui-search-price__second-line"), ("price-tag-fraction",)), F.lit(""))
    old = X.price_of_parts(whole(("andes-money-amount__fraction", "andes-money-amount--previous"), ("price-tag-fraction", "ui-search-price__third-line")), F.lit(""))
    url = F.substring_index(F.regexp_extract(card, r'(?s)<a\b[^>]*?href="([^"]*)"', 1), "#", 1)
    read = cards.select("source_id", "page_no", "tried", "position", title.alias("title"), url.alias("url"), X.item_id(url).alias("external_id"), price.alias("price"), old.alias("original_price"), X.percent_in(_inside(card, "poly-price__disc_label")).alias("informed"), free_shipping(_inside(card, "poly-component__shipping"), F.regexp_replace(card, "<[^>]*>", "")).alias("free_shipping"))
    was, now = F.col("original_price"), F.col("price")
    discount = F.coalesce(F.nullif("informed", F.lit(0)), F.when(was > now, F.floor((was - now) / was * 100 + 0.5).cast("int")))
    read = read.where((F.length("title") >= MIN_TITLE) & (F.col("url") != "") & (now > 0)).withColumn("discount", discount).drop("informed")
    both = informed.unionByName(read).withColumn("content_hash", X.content_hash32(F.col("title"), F.col("price")))
    key = F.when(F.col("tried") == 0, F.col("content_hash")).otherwise(F.coalesce("external_id", "content_hash"))
    at = Window.partitionBy("source_id", "page_no")  # a page has few cards
    first = both.withColumn("_first", F.min("tried").over(at)).where("tried = _first").drop("_first")
    return first.withColumn("_nth", F.row_number().over(Window.partitionBy("source_id", "page_no", key).orderBy("position"))).where("_nth = 1").drop("_nth")
