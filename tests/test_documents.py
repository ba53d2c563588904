"""Literal cases of pages, runs and documents."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import text as X
from offerlake.operators import documents as D
from offerlake.operators import pages as P
from offerlake.operators import runs as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "page", "want"),
    [
        ("https://a.test/l", 1, "https://a.test/l"), ("https://a.test/l", 2, "https://a.test/l?page=2"), ("https://a.test/l?x=1#f%20g", 3, "https://a.test/l?x=1&page=3#f%20g"),
        ("https://a.test/l?page=7&x=1", 1, "https://a.test/l?x=1"), ("https://a.test/l?x=1&page=7", 4, "https://a.test/l?x=1&page=4"), ("https://a.test/l?page=7", 1, "https://a.test/l"),
    ],
)
def test_page_url(spark, url, page, want):
    assert one(spark, P.page_url(F.lit(url), F.lit(page))) == want


def card(**parts):
    html = '<div class="poly-card poly-card--list">'
    html += f'<a href="{parts.get("url", "https://x.test/MLB-123#frag")}"><img class="poly-component__picture" src="i.jpg"></a><h2 class="poly-component__title">{parts.get("title", "Tênis Bom de Correr")}</h2>'
    html += '<s class="andes-money-amount andes-money-amount--previous"><span class="andes-money-amount__fraction">1.299</span><span class="andes-money-amount__cents">90</span></s>'
    html += f'<div class="poly-price__current"><span class="andes-money-amount__fraction">{parts.get("price", "649")}</span></div>'
    return html + f'<span class="poly-price__disc_label">{parts.get("label", "")}</span>{parts.get("more", "")}</div>'


def parsed(spark, *pages):
    rows = [(1, i, "<main>" + p + "</main>") for i, p in enumerate(pages, 1)]
    return spark.createDataFrame(rows, "source_id long, page_no int, html string")


def test_cards(spark):
    html = card() + card(url="https://x.test/MLBU123?x#y", title="other") + card(url="https://x.test/none", label="10% OFF") + card(url="https://x.test/z", price="") + card(url="https://x.test/q", title=" ") + card(url="https://x.test/mlb9", label="30% OFF", more='<span>Chegará grátis</span><b class="poly-component__highlight">OFERTA RELÂMPAGO</b>')
    found = {r.position: r for r in P.parsed_cards(parsed(spark, html)).collect()}
    assert set(found) == {0, 5}  # a second card of an item, a small discount, no price and no title are left out
    assert (found[0].external_id, found[0].price, found[0].original_price, found[0].discount, found[0].url) == ("MLB123", 649.0, 1299.9, 50, "https://x.test/MLB-123")
    assert (found[5].free_shipping, found[5].promotion_type, found[0].free_shipping, found[0].promotion_type) == (True, "lightning", False, "general")


def test_audit_and_crawl(spark):
    link = '<nav class="andes-pagination"><a class="andes-pagination__link" href="?page=2">x</a></nav>'
    pad = "<!--" + "x" * 5000 + "-->"
    pages = parsed(spark, card(label="50% OFF") + link + pad, card(label="50% OFF", title="Another name here", url="https://x.test/MLB5") + link, card(label="50% OFF", title="Another name here", url="https://x.test/MLB5") + link + pad, card() + pad)
    facts = {r.page_no: r for r in P.audited(pages).collect()}
    assert [facts[i].blocked for i in (1, 2, 3, 4)] == [False, True, False, False]
    assert [facts[i].has_next for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert sorted(r.page_no for r in P.crawl_prefix(pages).collect()) == [1, 2]
    empty = parsed(spark, "<p>Nenhum produto encontrado</p>" + pad, "<p>?</p>" + pad)
    assert {r.page_no: (r.empty_state, r.error) for r in P.audited(empty).collect()} == {1: (True, None), 2: (False, "unrecognised_markup")}
    assert P.crawl_prefix(empty).count() == 0


def test_memberships_take_the_last_item_and_count_misses(spark):
    members = spark.createDataFrame([("m1", 1, "A", "h1", "old", True, "b1", 1), ("m2", 1, None, "h2", "old", True, "b1", 0), ("m3", 1, "C", "h3", "old", True, "b1", 1), ("m4", 2, "D", "h4", "old", True, "b1", 1), ("m5", 1, "E", "h5", "old", True, None, 1)], "id string, source_id long, external_item_id string, content_hash string, raw_title string, is_active boolean, last_batch string, missed int")
    items = spark.createDataFrame([("i1", 1, "A", "h9", "first", 1), ("i2", 1, "A", "h8", "second", 2), ("i3", 1, None, "h2", "by hash", 3), ("i4", 1, "N", "h7", "new", 4)], "item_id string, source_id long, external_id string, content_hash string, title string, position long")
    after = R.upserted_memberships(members, items, "b2")
    found = {r.id: r for r in after.collect()}
    assert (found["m1"].content_hash, found["m1"].raw_title, found["m1"].missed, found["m2"].raw_title) == ("h8", "second", 0, "by hash")
    assert found["new-1-e:N"].is_active
    missed = {r.id: (r.is_active, r.missed) for r in R.missed_memberships(after, "b2", spark.createDataFrame([(1,)], "source_id long")).collect()}
    assert missed == {"m1": (True, 0), "m2": (True, 0), "m3": (False, 2), "m4": (True, 1), "m5": (True, 1), "new-1-e:N": (True, 0)}


def test_heroes_take_a_product_once(spark):
    rows = [(1, "Nike Adidas", 90), (2, "Adidas", 50), (3, "Outra", 99), (4, "Fila", 40), (5, "Ólimpikus", 10)]
    products = spark.createDataFrame(rows, "id long, brand string, discount int")
    assert [r.id for r in D.heroes(products, ("nike", "adidas", "olympikus"), ("outra",)).collect()] == [1, 2, 5]
    assert [r.id for r in D.heroes(products.where("id >= 3"), ("nike",), ("outra",)).collect()] == [4, 5, 3]


def test_brand_tables_hold_their_values():
    from offerlake.functions import titles as T

    assert T.COLOR_OF["azul marinho"] == "Azul-marinho" and T.COLOR_OF["bordo"] == "Bordô" and len(T.COLORS) == 23
    assert dict(T.GENDERS)["Feminino"] == ("feminino", "feminina", "menina", "mulher") and T.BRANDS[:3] == ("on running", "new balance", "under armour")
    assert "tamanho" in X.STOP_WORDS and "nike" in X.STOP_WORDS


def test_empty_inputs(spark):
    pages = spark.createDataFrame([], "source_id long, page_no int, html string")
    assert P.parsed_cards(pages).count() == P.audited(pages).count() == P.crawl_prefix(pages).count() == 0
    nothing = spark.createDataFrame([(None, 1, None)], "owner string, place long, document string")
    assert D.valid_snapshots(nothing).count() == 0
    assert one(spark, D.cleaned_ids(F.lit(None).cast("array<string>"))) is None
