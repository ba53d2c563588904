"""Pages as tables of tags: nesting by running sums along a page, elements, facts and links. Each page is read once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as K


def page_tags(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """id, place, closing, name, attributes, text, depth: the tags of each page; depth is how many elements are open behind a tag.

    A null page has no tags. What is never closed stays open: implied ends are not guessed.
    """
    rows = pages.where(F.col(html_col).isNotNull()).select(id_col, F.posexplode(K.tags(F.col(html_col))).alias("place", "tag")).select(id_col, "place", "tag.*")
    ends = F.col("name").isin(*K.VOID) | F.endswith(F.rtrim("attributes"), F.lit("/")) | (F.col("place") == 0)
    step = F.when(ends, 0).when(F.col("closing"), -1).otherwise(1)
    return rows.withColumn("depth", F.sum(step).over(_along(id_col)).cast("int"))


def _along(id_col: str):
    """A page is one row of the input, so its tags are no more than it holds."""
    return Window.partitionBy(id_col).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)


def in_element(name: str, id_col: str) -> tuple[Column, Column]:
    """Whether a tag's text lies in an element of a name, and the element's number on the page (the outer one of nested ones)."""
    own = F.col("name") == name
    level = F.sum(F.when(~own, 0).when(F.col("closing"), -1).otherwise(1)).over(_along(id_col))
    outer = own & ~F.col("closing") & (level == 1)
    return level > 0, F.sum(F.when(outer, 1).otherwise(0)).over(_along(id_col))


def _joined(where: Column) -> Column:
    """The texts of some tags, in order, decoded, white space as one space."""
    texts = F.sort_array(F.collect_list(F.when(where, F.struct("place", "text"))))
    return F.trim(F.regexp_replace(K.decoded(F.array_join(F.transform(texts, lambda t: t["text"]), "")), r"\s+", " "))


def page_facts(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """Per page: title, heading (the first h1), links with an address, those to other hosts, list items, paragraphs, characters of text
    that are no white space, and how deep elements nest. A null page has none of these."""
    tags = page_tags(pages, id_col, html_col)
    for name in ("title", "h1"):
        inside, number = in_element(name, id_col)
        tags = tags.withColumn(f"_{name}", inside).withColumn(f"_{name}_n", number)
    tags = tags.withColumn("_first", F.col("_title") & (F.col("_title_n") == 1)).withColumn("_head", F.col("_h1") & (F.col("_h1_n") == 1))
    opens = ~F.col("closing")
    href = F.when(opens & (F.col("name") == "a"), K.attribute(F.col("attributes"), "href"))
    tags = tags.withColumn("_href", href)
    found = tags.groupBy(id_col).agg(
        _joined(F.col("_first")).alias("title"), _joined(F.col("_head")).alias("heading"), F.count("_href").alias("n_links"), F.count_if(F.col("_href").rlike("(?i)^(https?:)?//")).alias("n_outside"),
        F.count_if(opens & (F.col("name") == "li")).alias("n_items"), F.count_if(opens & (F.col("name") == "p")).alias("n_paragraphs"),
        F.sum(F.length(F.regexp_replace(K.decoded(F.col("text")), r"\s+", ""))).alias("text_chars"), F.max("depth").alias("deepest"),
    )
    return pages.select(id_col).join(found, id_col, "left")


def page_links(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """Per link with an address: its number on the page, address and text."""
    tags = page_tags(pages, id_col, html_col)
    inside, number = in_element("a", id_col)
    own = tags.withColumn("_in", inside).withColumn("number", number).where("_in")
    href = F.min_by(K.attribute(F.col("attributes"), "href"), F.col("place"))
    found = own.groupBy(id_col, "number").agg(href.alias("href"), _joined(F.lit(True)).alias("text"))
    return found.where("href is not null")
