"""HTML as column functions: tags with their attributes and the text behind them, entities decoded.

A text is cut into tags by one pattern whose parts are taken in turn, so that a page is read in a fixed number of
linear passes. Attributes may come in any order and quoting. Comments, declarations and the contents of scripts and styles are no tags.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

_HIDDEN = r"(?is)<!--.*?-->|<[!?][^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>"
#: A tag: whether it closes, its name, its attributes; then the text up to the next tag. A < that starts no tag is text.
_TAG = r"""(?s)<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>([^<]*+(?:<(?![/a-zA-Z])[^<]*+)*+)"""
_ATTRIBUTE = r"""(?s)([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
#: Elements without an end.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def decoded(text: Column) -> Column:
    """A text with its entities as characters: named ones with a semicolon, decimal and hexadecimal ones. Others stay as written."""
    names = F.create_map(*[F.lit(x) for name, code in sorted(name2codepoint.items()) for x in (name, chr(code))])

    def one(part: Column) -> Column:
        name = F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});", 1)
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 9)).try_cast("int")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        found = F.when(name == "", F.lit(None)).when(F.startswith(name, F.lit("#")), numeric).otherwise(F.try_element_at(names, name))
        return F.when(found.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(found, F.substring(part, F.length(name) + 2, F.length(part))))

    parts = F.split(text, "&")
    several = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(F.contains(text, F.lit("&")), several).otherwise(text)


def tags(html: Column) -> Column:
    """closing, name, attributes (as written), text of each tag; the first one, named top, has the text before all tags."""
    shown = F.concat(F.lit("<top>"), F.regexp_replace(html, _HIDDEN, ""))
    part = lambda i: F.regexp_extract_all(shown, F.lit(_TAG), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("closing"), part(2).alias("name"), part(3).alias("attributes"), part(4).alias("text"))
    return F.transform(zipped, lambda t: F.struct((t["closing"] == "/").alias("closing"), F.lower(t["name"]).alias("name"), t["attributes"].alias("attributes"), t["text"].alias("text")))


def attribute(attributes: Column, name: str) -> Column:
    """The first value of an attribute; empty without a value, null if it is not there."""
    names, values = F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(1)), F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(2))
    at = F.array_position(F.transform(names, F.lower), name).cast("int")
    bare = F.regexp_replace(F.try_element_at(values, F.nullif(at, F.lit(0))), r"""^["']|["']$""", "")
    return F.when(at > 0, decoded(bare))


def has_class(attributes: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attribute(attributes, "class"), r"\s+"), name), F.lit(False))
