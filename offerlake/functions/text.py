"""Column functions on titles, links and prices. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_ACCENTED = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFD", c)[0].isascii() and len(unicodedata.normalize("NFD", c)) > 1]

# Tokens of a title that name no attribute.
STOP_WORDS = (
    "nike", "adidas", "puma", "mizuno", "olympikus", "olimpikus", "asics", "fila", "reebok",
    "masculino", "masculina", "feminino", "feminina", "unissex", "infantil",
    "corrida", "caminhada", "tenis", "calcado", "calcados", "chuteira", "br",
    "numeracao", "numeracoes", "tamanho", "tam", "adulto", "adultos", "original", "novo", "nova",
)


def without_accents(c: Column) -> Column:
    """Latin letters lose their accents; combining marks that stand alone go."""
    plain = F.translate(c, "".join(a for a, _ in _ACCENTED), "".join(b for _, b in _ACCENTED))
    return F.regexp_replace(plain, r"[̀-ͯ]", "")


def attribute_text(c: Column) -> Column:
    """Lower-case ASCII words joined by one space; null is empty."""
    return F.trim(F.regexp_replace(F.lower(without_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", " "))


def slug(c: Column) -> Column:
    """Hyphenated attribute text; null if nothing is left."""
    return F.nullif(F.replace(attribute_text(c), F.lit(" "), F.lit("-")), F.lit(""))


def search_text(c: Column) -> Column:
    return F.lower(without_accents(c))


def tokens(c: Column) -> Column:
    return F.filter(F.split(attribute_text(c), " "), lambda t: t != "")


def meaningful_tokens(c: Column) -> Column:
    """Tokens that are neither stop words nor numbers."""
    return F.filter(tokens(c), lambda t: ~t.isin(*STOP_WORDS) & ~t.rlike("^[0-9]+$"))


def ngrams(words: Column, longest: int) -> Column:
    """All n-grams, longer ones first."""
    sized = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.flatten(F.array(*[F.when(F.size(words) >= n, sized(F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(longest, 0, -1)]))


def matches_all(query: str, *columns: Column) -> Column:
    """Every word of the query occurs somewhere in the columns' joined text."""
    text = search_text(F.concat_ws(" ", *columns))
    found = F.lit(True)
    for word in query.split():
        found &= F.contains(text, search_text(F.lit(word)))
    return found


def title_key(*titles: Column) -> Column:
    """What offers of one model share: the first known title's first 60 characters."""
    return F.lower(F.substring(F.regexp_replace(F.coalesce(*titles, F.lit("")), r"\s+", " "), 1, 60))


def published_slug(title: Column, suffix: Column, longest: int = 80) -> Column:
    return F.concat(F.substring(F.coalesce(slug(title), F.lit("")), 1, longest), F.lit("-"), suffix)


def tracked(url: Column, parameters: str) -> Column:
    """The link with tracking parameters; an empty one stays so."""
    return F.when(url == "", url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit(parameters)))


def item_id(url: Column) -> Column:
    """MLB and digits, from a link; one letter between them is dropped."""
    found = F.replace(F.regexp_extract(url, r"(?i)MLB[A-Z]?-?\d+", 0), F.lit("-"), F.lit(""))
    return F.nullif(F.regexp_replace(found, r"(?i)^MLB[A-Z]", "MLB"), F.lit(""))


def redacted(url: Column) -> Column:
    """No credentials, no fragment, no parameter values."""
    bare = F.regexp_replace(F.substring_index(url, "#", 1), "^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")
    return F.regexp_replace(bare, "([?&][^=&]*)=[^&]*", "$1=redacted")


def price_of_parts(fraction: Column, cents: Column) -> Column:
    """Whole and cent texts as a number; only the first dot of the whole is a separator."""
    whole = F.regexp_replace(fraction, r"^([^.]*)\.", "$1")
    return F.concat(whole, F.lit("."), F.coalesce(F.nullif(cents, F.lit("")), F.lit("0"))).try_cast("double")


def percent_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)%", 1), F.lit("")).try_cast("int")


def rating_in(text: Column) -> Column:
    number = F.regexp_replace(F.regexp_extract(text, "[0-9.,]+", 0), "^([^,]*),", "$1.")
    return F.nullif(F.regexp_extract(number, r"^(\d+\.?\d*|\.\d+)", 1), F.lit("")).try_cast("double")


def review_count_in(text: Column) -> Column:
    digits = F.regexp_replace(F.regexp_extract(text, r"\((\d+[\d.]*)\)", 1), r"^(\d+)\.", "$1")
    return F.nullif(F.regexp_extract(digits, r"^\d+", 0), F.lit("")).try_cast("int")


def content_sha256(title: Column, price: Column) -> Column:
    """Over title and price, the price without trailing zeros."""
    number = F.regexp_replace(F.regexp_replace(price.cast("decimal(18,2)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.sha2(F.concat(title, F.lit("::"), number), 256)


def content_hash32(title: Column, price: Column) -> Column:
    """The 31-multiplier string hash of 32 bits, without its sign, as eight hex digits."""
    raw = F.concat(F.lower(F.trim(title)), F.lit("::"), price.cast("decimal(18,2)").cast("string"))
    total = F.aggregate(F.split(raw, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(F.when(total >= 1 << 31, F.lit(1 << 32) - total).otherwise(total))), 8, "0")


def large_image(url: Column) -> Column:
    """The large picture over https."""
    return F.regexp_replace(F.regexp_replace(url, "^(.*?)-I[.]jpg", "$1-O.jpg"), "^http:", "https:")


def display_name(c: Column) -> Column:
    """Each word's first letter upper; the rest as it is."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def joined_label(*parts: Column) -> Column:
    """The parts that are not blank, with a middle dot between."""
    return F.concat_ws(" · ", *[F.nullif(F.trim(p), F.lit("")) for p in parts])


def email_key(c: Column) -> Column:
    """What tells accounts apart: the address without spaces around it, in lower case."""
    return F.lower(F.trim(c))
