"""Literal cases of the tag reader, of records and of orders."""

import json

import pytest
from pyspark.sql import functions as F

from offerlake.functions import markup as K
from offerlake.operators import facets as A
from offerlake.operators import markup as M
from offerlake.operators import records as R
from offerlake.operators import runs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a &amp; b", "a & b"), ("&amp;lt;", "&lt;"), ("&eacute;&Eacute;&nbsp;&euro;", "éÉ\xa0€"), ("&#233;&#xE9;&#X1F600;", "éé😀"), ("&unknown; &; & &#; &#xZZ; &amp", "&unknown; &; & &#; &#xZZ; &amp"),
        ("&#55296;&#1114112;&#0;", "&#55296;&#1114112;&#0;"), ("", ""), (None, None), ("&&lt;&", "&<&"),
    ],
)
def test_entities(spark, text, want):
    assert one(spark, K.decoded(F.lit(text).cast("string"))) == want


def test_attributes_in_any_order_and_quoting(spark):
    tag = """ data-x = '1>2' HREF="/a?b=1&amp;c=2" disabled class='card  big' id=main href="/second" """
    get = lambda name: one(spark, K.attribute(F.lit(tag), name))
    assert (get("href"), get("data-x"), get("id"), get("disabled"), get("none")) == ("/a?b=1&c=2", "1>2", "main", "", None)
    assert one(spark, K.has_class(F.lit(tag), "big")) and not one(spark, K.has_class(F.lit(tag), "bi")) and not one(spark, K.has_class(F.lit("id=x"), "big"))


PAGE = """lead &lt;<!DOCTYPE html><html><head><title>One &amp;
 two</title><script>var t = "<a href='x'>";</script><style>p > a {}</style></head><body><!-- <a href="/hidden">no</a> -->
<ul><li><a title="a > b" href='/one'>First <b>bold</b> link</a></li><li><a class=x href="https://o.test/">2 < 3</a></li><li><a name="anchor">none</a></li></ul>
<h1>Head <i>line</i></h1><h1>Second</h1><p>text<br/>more<img src="x>y"><p>end</body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "plain text & more"), (5, "<p>" * 3000 + "x")], "id long, html string")


def test_pages_tag_by_tag(spark, pages):
    tags = M.page_tags(pages.where("id = 1"), "id").orderBy("place").collect()
    assert (tags[0].name, tags[0].text, tags[0].depth) == ("top", "lead &lt;", 0)
    assert [(t.name, t.closing, t.depth) for t in tags if t.name in ("html", "ul", "li", "b")] == [("html", False, 1), ("ul", False, 3), ("li", False, 4), ("b", False, 6), ("b", True, 5), ("li", True, 3), ("li", False, 4), ("li", True, 3), ("li", False, 4), ("li", True, 3), ("ul", True, 2), ("html", True, 2)]
    assert {t.name for t in tags}.isdisjoint({"script", "style"})


def test_page_facts(spark, pages):
    facts = {r.id: r for r in M.page_facts(pages, "id").collect()}
    f = facts[1]
    assert (f.title, f.heading, f.n_links, f.n_outside, f.n_items, f.n_paragraphs, f.deepest) == ("One & two", "Head line", 2, 1, 3, 2, 6)
    assert (facts[2].title, facts[2].n_links) == (None, None) and (facts[3].title, facts[3].n_links, facts[3].text_chars) == ("", 0, 0)
    assert facts[4].text_chars == len("plaintext&more") and (facts[5].n_paragraphs, facts[5].deepest, facts[5].text_chars) == (3000, 3000, 1)
    assert M.page_facts(pages.limit(0), "id").count() == 0


def test_page_links(spark, pages):
    assert [(r.id, r.number, r.href, r.text) for r in M.page_links(pages, "id").orderBy("number").collect()] == [(1, 1, "/one", "First bold link"), (1, 2, "https://o.test/", "2 < 3")]


def test_keys_are_merged_into_payloads_and_the_rest_stays(spark):
    raw = ['{"n":1,"s":"1","t":"true","x":null,"deep":{"a":[1,{"b":"ç"}]},"k":["old"]}', None, "broken", "[1]", "{}", '{"k":{"other":1}}']
    rows = spark.createDataFrame(list(enumerate(raw)), "id long, raw string")
    found = {r.id: json.loads(r.x) for r in rows.select("id", R.with_keys(F.col("raw"), {"k": F.lit('["new"]'), "audit": F.lit(None).cast("string")}).alias("x")).collect()}
    assert found[0] == {"n": 1, "s": "1", "t": "true", "x": None, "deep": {"a": [1, {"b": "ç"}]}, "k": ["new"], "audit": None}
    assert all(found[i] == {"k": ["new"], "audit": None} for i in range(1, 6))


def test_facets_stand_in_portuguese_and_numeric_order(spark):
    counts = [("cor", "z", 2), ("cor", "bordo", 1), ("cor", "bege", 1), ("cor", "azul", 1), ("cor", "agua", 1), ("tamanho", "9.5", 7), ("tamanho", "10", 1), ("tamanho", "38", 5), ("genero", "Unissex", 9), ("genero", "Masculino", 1), ("marca", "b", 3), ("marca", "a", 3), ("marca", "c", 4), ("preco_min", "", 5)]
    labels = [("z", "Zinco"), ("bordo", "Bordô"), ("bege", "bege"), ("azul", "Azul"), ("agua", "Água")]
    placed = A.with_places(spark.createDataFrame(counts, "dimension string, value string, n long"), spark.createDataFrame(labels, "value string, label string"), {"genero": ("Masculino", "Feminino", "Unissex")})
    order = {}
    for r in placed.orderBy("dimension", "place").collect():
        order.setdefault(r.dimension, []).append(r.label)
    assert order == {"cor": ["Zinco", "Água", "Azul", "bege", "Bordô"], "tamanho": ["9.5", "10", "38"], "genero": ["Masculino", "Unissex"], "marca": ["c", "a", "b"]}


def test_pinned_brands_under_other_spellings(spark):
    counts = spark.createDataFrame([("OLÍMPIKUS", 2), ("olympikus ", 5), ("Fila", 9), ("adidas", 1), ("Ásics", 9)], "label string, n long")
    found = [(r.label, r.n, r.pin) for r in A.pinned(counts, ("Nike", "Adidas", "Olympikus"), {"olimpikus": "olympikus"}).collect()]
    assert found == [("Nike", 0, 0), ("adidas", 1, 1), ("olympikus ", 5, 2), ("Fila", 9, None), ("Ásics", 9, None)]
    assert [r.label for r in A.pinned(counts, ("Nike",), {}, " ás").collect()] == ["Ásics", "adidas"]


def test_letters_go_on_past_z(spark):
    places = {1: "A", 26: "Z", 27: "AA", 52: "AZ", 53: "BA", 702: "ZZ", 703: "AAA", 18278: "ZZZ"}
    rows = spark.createDataFrame([(p,) for p in places], "p int")
    assert {r.p: r.x for r in rows.select("p", R.place_letters(F.col("p")).alias("x")).collect()} == places


def test_log_rows_are_appended_once(spark):
    log = spark.createDataFrame([(1, "a")], "id long, x string")
    rows = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c"), (3, "d")], "id long, x string")
    assert sorted(map(tuple, R.appended(log, rows, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_clicks_need_an_offer_with_a_link(spark):
    clicks = spark.createDataFrame([(1, "o1", None, "x"), (2, "o2", "r", "x"), (3, "none", "r", "x")], "id long, offer_id string, referrer string, agent string").withColumn("clicked_at", F.current_timestamp())
    offers = spark.createDataFrame([("o1", 7, "https://l"), ("o2", 8, ""), ("o3", 9, None)], "id string, product_id long, affiliate_url string")
    assert [(r.id, r.product_id, r.source_page_url) for r in R.click_rows(clicks, offers).collect()] == [(1, 7, None)]


def test_documents_by_slug_nest_images_and_offers(spark):
    products = spark.createDataFrame([(1, "um"), (2, "dois"), (3, None)], "id long, slug string")
    offers = spark.createDataFrame([("a", 1, "active", 5.0, "2024-01-01"), ("b", 1, "active", 6.0, "2024-01-02"), ("c", 1, "expired", 1.0, "2024-01-03")], "id string, product_id long, status string, current_price double, last_seen_at string")
    offers = offers.withColumn("last_seen_at", F.col("last_seen_at").cast("timestamp")).withColumns({"original_price": F.lit(None).cast("double"), "discount_percent": F.lit(1), "free_shipping": F.lit(True), "affiliate_url": F.lit("l")})
    images = spark.createDataFrame([(1, "u2", 1, False), (1, "u1", 5, True), (2, "v", 0, False)], "product_id long, url string, sort_order int, is_primary boolean").withColumn("alt", F.lit("x"))
    found = {r.id: r for r in R.product_documents(products, offers, images, ("slug", ["um", "none"])).collect()}
    assert set(found) == {1} and [i.url for i in found[1].images] == ["u1", "u2"] and [o.id for o in found[1].offers] == ["b", "a"]
    assert {r.id for r in R.product_documents(products, offers, images).collect()} == {1, 2, 3}


def test_masked_rows(spark):
    row = R.masked(spark.createDataFrame([(1, "x", "s", 5.0)], "id long, affiliate_url string, seller_name string, price double")).first()
    assert (row.affiliate_url, row.seller_name, row.price, row.store_label, row.demonstrative) == (None, None, 5.0, "Loja demonstrativa", True)


def test_source_rules(spark):
    good = (1, "n", "HTTP://a.test/x", 0, None, None, None, "active", "brand", True)
    rows = [good, (2, " ", "https://", -1, None, None, "y" * 5001, "paused", None, None), (3, "z" * 201, None, None, None, None, "ok", None, "shop", True)]
    df = spark.createDataFrame(rows, "id long, name string, url string, priority int, starts_at timestamp, ends_at timestamp, notes string, status string, source_type string, _market boolean")
    found = {}
    for r in runs.violations(df, runs.source_rules()).collect():
        found.setdefault(r.row_id, set()).add(r.rule)
    assert found == {"2": {"name_length", "url_pattern", "priority_negative", "notes_length", "status_value", "source_type_value", "unknown_marketplace"}, "3": {"name_length", "url_pattern", "priority_negative", "status_value", "source_type_value"}}
