"""Attributes that titles reveal: brand, category, gender, age, size, sport, type, colours."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import attribute_text, meaningful_tokens, slug

# Labels with the terms that show them, in order of precedence.
GENDERS = (
    ("Unissex", ("unissex",)),
    ("Feminino", ("feminino", "feminina", "menina", "mulher")),
    ("Masculino", ("masculino", "masculina", "menino", "homem")),
)
AGES = (("Infantil", ("infantil", "criança", "crianca", "kids", "menino", "menina", "bebê", "bebe", "juvenil", "baby")),)
SPORTS = (
    ("Corrida", ("corrida", "running")),
    ("Caminhada", ("caminhada",)),
    ("Treino", ("treino", "academia", "training", "fitness", "crossfit")),
    ("Futebol", ("futebol", "futsal", "society", "chuteira")),
    ("Basquete", ("basquete", "basketball")),
    ("Vôlei", ("vôlei", "volei", "volleyball")),
    ("Skate", ("skate",)),
    ("Casual", ("casual", "slip on", "slip-on", "slipon", "conforto", "passeio", "escolar", "lifestyle")),
)
TYPES = (
    ("Acessórios", (
        "meia", "meias", "boné", "bone", "mochila", "bolsa", "garrafa", "squeeze", "viseira", "touca", "luva", "munhequeira",
        "cadarço", "cadarco", "palmilha", "necessaire", "pochete", "sacola", "chaveiro", "acessório", "acessorio",
    )),
)
CATEGORIES = (
    ("futebol", ("chuteira", "society", "campo", "futsal")),
    ("corrida", ("corrida", "running", "runner")),
    ("academia", ("academia", "treino", "training", "crossfit")),
    ("basquete", ("basquete", "basketball")),
    ("caminhada", ("caminhada", "walking")),
    ("acessorios", ("meia", "palmilha", "cadarço")),
)
# Brands by name, then product lines by brand.
BRANDS = (
    "on running", "new balance", "under armour", "nike", "adidas", "puma", "mizuno", "asics", "olympikus", "fila", "reebok",
    "vans", "converse", "skechers", "oakley", "penalty", "umbro", "diadora", "kappa", "lynd", "and1",
)
BRAND_LINES = (
    ("adidas", ("lightmotion", "ultraboost", "ultra boost", "superstar", "ozweego", "galaxy", "duramo", "runfalcon", "questar", "ultimashow", "grand court")),
    ("nike", ("air max", "airmax", "air force", "airforce", "pegasus", "revolution", "downshifter", "court vision")),
    ("puma", ("rs x", "suede", "cell")),
    ("asics", ("gel ",)),
    ("olympikus", ("corre ",)),
    ("mizuno", ("wave ",)),
)
# Brands that may publish without review, in the order in which they are looked for.
TRUSTED_BRANDS = (
    "new balance", "under armour", "nike", "adidas", "olympikus", "mizuno", "puma", "fila", "jordan", "kappa", "asics", "reebok",
    "skechers", "vans", "converse", "mormaii", "penalty", "umbro", "topper",
)
# Colours and their aliases as normalised text.
COLORS = (
    ("Off-white", ("off white",)),
    ("Azul-marinho", ("azul marinho", "marinho", "navy")),
    ("Preto", ("preto", "preta", "black")),
    ("Branco", ("branco", "branca", "white")),
    ("Azul", ("azul", "blue")),
    ("Vermelho", ("vermelho", "vermelha", "red")),
    ("Verde", ("verde", "green")),
    ("Amarelo", ("amarelo", "amarela", "yellow")),
    ("Laranja", ("laranja", "orange")),
    ("Rosa", ("rosa", "pink")),
    ("Magenta", ("magenta",)),
    ("Roxo", ("roxo", "roxa", "purple")),
    ("Cinza", ("cinza", "grey", "gray")),
    ("Chumbo", ("chumbo",)),
    ("Grafite", ("grafite",)),
    ("Marrom", ("marrom", "brown")),
    ("Bege", ("bege", "beige")),
    ("Dourado", ("dourado", "dourada", "gold")),
    ("Prata", ("prata", "prateado", "prateada", "silver")),
    ("Vinho", ("vinho",)),
    ("Bordô", ("bordo",)),
    ("Nude", ("nude",)),
    ("Caramelo", ("caramelo",)),
)
COLOR_OF = {alias: label for label, aliases in COLORS for alias in aliases}
COLOR_PATTERN = r"\b(?:" + "|".join(sorted(COLOR_OF, key=lambda a: -a.count(" "))) + r")\b"

#: An attribute's rules, and its value when none fits.
RULES = {"gender": (GENDERS, None), "age": (AGES, "Adulto"), "sport": (SPORTS, None), "type": (TYPES, "Calçados"), "category": (CATEGORIES, "casual")}


def first_rule(text: Column, rules: Iterable[tuple[str, Iterable[str]]], default: str | None = None) -> Column:
    """The label of the first rule with a term in the text."""
    lower = F.lower(text)
    chain = None
    for label, terms in rules:
        hit = F.lit(False)
        for term in terms:
            hit |= F.contains(lower, F.lit(term))
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit(default))


def attribute(title: Column, name: str) -> Column:
    return first_rule(title, *RULES[name])


def brand_of(title: Column, hint: Column | None = None) -> Column:
    """By the seller's brand field, then the title, then a product line; 'outra' if none is known."""
    named = tuple((b, (b,)) for b in BRANDS)
    tries = [first_rule(title, named), first_rule(title, BRAND_LINES), F.lit("outra")]
    return F.coalesce(*([] if hint is None else [first_rule(F.trim(hint), named)]), *tries)


# Sizes of shoes, and how titles write them.
SMALLEST, LARGEST = 16, 48
MARKED_SIZE, ANY_SIZE = r"\b(\d{2})(?:[.,]0)?\s+br\b", r"\b\d{2}\b"


def size_of(title: Column) -> Column:
    """A shoe size from 16 to 48: the one before 'Br', else the last number of two digits."""
    fits = lambda x: x.try_cast("int").between(SMALLEST, LARGEST)
    marked = F.regexp_extract(F.lower(title), MARKED_SIZE, 1)
    others = F.filter(F.regexp_extract_all(title, F.lit(ANY_SIZE), F.lit(0)), fits)
    return F.when(fits(marked), marked).otherwise(F.try_element_at(others, F.lit(-1)))


def trusted_brands(title: Column, field: Column) -> Column:
    """All trusted brands that the title or the brand field names as whole words."""
    text = F.concat(title, F.lit(" "), F.coalesce(field, F.lit("")))
    found = [F.when(text.rlike(r"(?i)\bair\s+jordan\b"), "jordan")]
    found += [F.when(text.rlike(r"(?i)\b" + b.replace(" ", r"\s+") + r"\b"), b) for b in TRUSTED_BRANDS]
    return F.array_distinct(F.array_compact(F.array(*found)))


def brand_confidence(title: Column, field: Column, brands: Column) -> Column:
    """How sure the brand is, by where it stands; several brands make it unsure."""
    brand, in_field, in_title = F.get(brands, F.lit(0)), attribute_text(field), attribute_text(title)
    return (
        F.when(F.size(brands) == 0, 0.0).when(F.size(brands) > 1, 0.3).when(in_field.isin(*TRUSTED_BRANDS), 0.95)
        .when(F.contains(in_field, brand), 0.92).when(F.startswith(in_title, brand), 0.9).when(F.contains(in_title, brand), 0.82).otherwise(0.7)
    )


def card_issues(title: Column, url: Column, image: Column, price: Column, discount: Column) -> Column:
    """What a card lacks to be published."""
    web = lambda u: F.coalesce(u, F.lit("")).rlike("(?i)^https?://")
    return F.array_compact(F.array(
        F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) < 10, "title_too_short"),
        F.when(~web(url), "invalid_source_url"),
        F.when(~web(image), "missing_image"),
        F.when(F.coalesce(price, F.lit(0)) <= 0, "invalid_price"),
        F.when(~discount.between(0, 90), "discount_out_of_range"),
    ))


def approval(brands: Column, confidence: Column, issues: Column, least: float = 0.85) -> Column:
    """The decision on a card: auto_approved, or what stands against it first."""
    return F.when(F.size(brands) == 0, "brand_not_in_whitelist").when(confidence < least, "confidence_below_threshold").when(F.size(issues) > 0, "incomplete_card").otherwise("auto_approved")


def _colors() -> Column:
    return F.create_map(*[F.lit(x) for pair in COLOR_OF.items() for x in pair])


def title_colors(title: Column) -> Column:
    """Labels of the colours in a title, each once, in order; names of two words go before those of one."""
    words = F.array_join(meaningful_tokens(title), " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(words, F.lit(COLOR_PATTERN), F.lit(0)), lambda a: _colors()[a]))


def color_label(name: Column) -> Column:
    """A colour's name with each part translated and the first letter upper; null for blank."""
    parts = F.regexp_extract_all(F.trim(name), F.lit("[/+,&]|[^/+,&]+"), F.lit(0))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(_colors(), attribute_text(p)), F.trim(p))), "")
    return F.when(F.trim(name) != "", F.concat(F.upper(F.substring(joined, 1, 1)), F.substring(joined, 2, 1 << 20)))


def clean_color(name: Column) -> Column:
    """An official colour name with single spaces; null if empty, over 120 characters or without a slug."""
    plain = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when((plain != "") & (F.length(plain) <= 120) & slug(plain).isNotNull(), plain)
