"""Queries of the given pages, read tag by tag. Their SQL reads the same pages with patterns of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import markup as M
from ..registry import query

_ENTITIES = {"&copy;": "©", "&middot;": "·", "&quot;": '"', "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _plain(text: str) -> str:
    for name, char in _ENTITIES.items():
        text = f"replace({text}, '{name}', '{char}')"
    return text


_SHOWN = r"regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script[^>]*>.*?</script>', '', 'gs'), '<style[^>]*>.*?</style>', '', 'gs')"
_PAGES = f"p AS (SELECT page_id, {_SHOWN} AS shown, html IS NULL AS missing FROM pages)"
_ONE_SPACE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("page_facts", rf"""WITH {_PAGES}
    SELECT page_id, {_ONE_SPACE.format(_plain("regexp_extract(shown, '<title>(.*?)</title>', 1, 's')"))} AS title, {_ONE_SPACE.format(_plain("regexp_extract(shown, '<h1>(.*?)</h1>', 1, 's')"))} AS heading,
           len(regexp_extract_all(shown, '<a href="'))::BIGINT AS n_links, len(regexp_extract_all(shown, '<a href="(https?:)?//'))::BIGINT AS n_outside, len(regexp_extract_all(shown, '<li>'))::BIGINT AS n_items,
           len(regexp_extract_all(shown, '<p>'))::BIGINT AS n_paragraphs, length(regexp_replace({_plain(r"regexp_replace(shown, '<[/a-zA-Z!][^>]*>', '', 'g')")}, '\s+', '', 'g'))::BIGINT AS text_chars
    FROM p""")
def page_facts(v):
    return M.page_facts(v.pages, "page_id").drop("deepest")


@query("page_links", rf"""WITH {_PAGES}, a AS (SELECT page_id, unnest(regexp_extract_all(shown, '<a href="[^"]*">.*?</a>', 0, 's')) AS link, generate_subscripts(regexp_extract_all(shown, '<a href="[^"]*">.*?</a>', 0, 's'), 1) AS number FROM p)
    SELECT page_id, number, {_plain("regexp_extract(link, 'href=\"([^\"]*)\"', 1)")} AS href, {_ONE_SPACE.format(_plain("regexp_replace(link, '<[^>]*>', '', 'g')"))} AS text FROM a""")
def page_links(v):
    return M.page_links(v.pages, "page_id")


@query("page_hosts", r"""SELECT coalesce(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '') AS host, count(*) AS pages, sum(len(regexp_extract_all(coalesce(html, ''), '<li>')))::BIGINT AS items FROM pages GROUP BY 1""")
def page_hosts(v):
    """What is read of each host's pages: partial sums by page, then by host."""
    facts = M.page_facts(v.pages, "page_id").select("page_id", "n_items")
    hosts = v.pages.select("page_id", F.coalesce(F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1)), F.lit("")).alias("host"))
    return hosts.join(facts, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n_items"), F.lit(0)).alias("items"))
