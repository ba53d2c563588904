"""Rows of publishing and review, deletions over references, and registries, on literal cases."""

import pytest
from pyspark.sql import functions as F

from offerlake import registry
from offerlake.operators import cascades as D
from offerlake.operators import maintenance as H
from offerlake.operators import publishing as B
from offerlake.operators.registries import Collectors, Criteria
from offerlake.plans.publishing import _published, _reviewed
from offerlake.sources.bindings import Views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("make", [_published, _reviewed])
def test_every_reference_resolves_and_a_rerun_makes_the_same_rows(spark, make):
    made, again = make(Views(spark, SF)), make(Views(spark, SF))
    products = {r.id for r in made.products.collect()}
    assert products and made.products.count() == len(products)
    assert {r.id for r in again.products.collect()} == products
    for table in (made.offers, made.images):
        rows = table.collect()
        assert rows and {r.product_id for r in rows} <= products and len({r.id for r in rows}) == len(rows)
    offers = {r.id: r.product_id for r in made.offers.collect()}
    assert sorted(offers.values()) == sorted(products)
    if make is _published:
        triage = made.triage.collect()
        assert {r.product_id for r in triage if r.status == "approved"} == products and all(r.product_id is None for r in triage if r.status == "pending")
    else:
        audit = made.audit.where("result_product_id is not null").collect()
        assert {r.result_product_id for r in audit} == products and all(offers[r.result_offer_id] == r.result_product_id for r in audit)


def test_the_last_decision_counts_once_and_all_are_audited(spark):
    triage = spark.createDataFrame([("t1", "p1", None, "sug"), ("t2", "p2", "b", None), ("t3", "gone", None, None)], "id string, processed_id string, suggested_brand string, suggested_category string")
    processed = spark.createDataFrame([("p1", "Tênis Um", "det", "cat", "lightning", 5.0, None, None, True, "E1", "i", "u", "a"), ("p2", "Tênis Dois", "det", "cat", "general", 6.0, 9.0, 33, False, None, None, "u", "a")], "id string, normalized_title string, detected_brand string, detected_category string, promotion_type string, price double, original_price double, discount int, free_shipping boolean, external_id string, image string, url string, affiliate_url string")
    rows = [("d1", 1, "t1", "reject", None, None, None, ""), ("d2", 2, "t1", "approve", "Novo", "own", None, None), ("d3", 2, "t1", "approve", "Mais Novo", "", None, None), ("d4", 5, "t2", "approve", "", None, None, None), ("d5", 6, "t2", "reject", None, None, None, "ruim"), ("d6", 1, "none", "approve", None, None, None, None), ("d7", 1, "t3", "approve", None, None, None, None), ("d8", 9, "t1", "skip", None, None, None, None)]
    decisions = spark.createDataFrame([(*r,) for r in rows], "decision_id string, at int, triage_id string, action string, name string, brand string, category string, reason string")
    made = B.reviewed(triage, processed, decisions)
    assert [(p.main_name, p.brand_slug, p.main_category_slug, p.slug, p.section) for p in made.products.collect()] == [("Mais Novo", "det", "sug", "mais-novo-t1", "relampago")]
    assert {r.id: r.status for r in made.statuses.collect()} == {"t1": "approved", "t2": "rejected"}
    audit = sorted((r.triage_id, r.action, r.at, r.effective, r.rejection_reason, r.result_product_id is not None) for r in made.audit.collect())
    assert audit == [("t1", "approve", 2, False, None, False), ("t1", "approve", 2, True, None, True), ("t1", "reject", 1, False, "Rejeitado em lote", False), ("t2", "approve", 5, False, None, False), ("t2", "reject", 6, True, "ruim", False)]
    assert made.images.count() == 1
    assert B.reviewed(triage, processed, decisions.limit(0)).products.count() == 0


def test_deletion_follows_a_chain_and_stops_at_what_holds_back(spark):
    refs = [D.Reference("b", "a_id", "a"), D.Reference("c", "b_id", "b"), D.Reference("d", "c_id", "c"), D.Reference("d", "a_id", "a"), D.Reference("e", "b_id", "b", cascade=False)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "a": make([(1,), (2,)], "id long"), "b": make([(10, 1), (11, 2), (12, None)], "id long, a_id long"), "c": make([(20, 10), (21, 11), (22, 10)], "id long, b_id long"),
        "d": make([(30, 20, 2), (31, 21, 1), (32, 21, 2), (33, None, None), (34, 22, 1)], "id long, c_id long, a_id long"), "e": make([(40, 10)], "id long, b_id long"),
    }
    keys = {name: "id" for name in tables}
    gone = D.deletions(tables, keys, refs, {"a": tables["a"].where("id = 1")})
    found = {name: sorted(r.id for r in rows.collect()) for name, rows in gone.items()}
    assert found == {"a": [1], "b": [10], "c": [20, 22], "d": [30, 31, 34]}  # 34 by both its parents, once
    assert sorted(r.id for r in D.remaining(tables["d"], gone["d"], ["id"]).collect()) == [32, 33]
    assert D.remaining(tables["e"], gone.get("e"), ["id"]).count() == 1
    assert [r.id for r in D.held_back(tables, keys, refs, {"b": tables["b"]})["b"].collect()] == [10]
    assert D.order_of(refs).index("a") < D.order_of(refs).index("b") < D.order_of(refs).index("c") < D.order_of(refs).index("d")
    with pytest.raises(ValueError):
        D.order_of([D.Reference("a", "b_id", "b"), D.Reference("b", "a_id", "a")])


def test_patches_change_known_values_and_stamp_what_they_hit(spark):
    old = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "y", 5), (3, None, "z", None)], "id long, name string, kind string, updated_at int")
    patch = spark.createDataFrame([(1, "n"), (2, None), (9, "none")], "id long, name string")
    assert sorted(map(tuple, H.patched(old, patch, ["id"], F.lit(7)).collect())) == [(1, "n", "x", 7), (2, "b", "y", 7), (3, None, "z", None)]


def test_collectors_are_found_by_trimmed_lower_case_slugs_in_one_plan(spark):
    known = Collectors()
    known.register([" Shop ", "STORE"], lambda pages: pages.withColumn("by", F.lit("first")))
    known.register(["other"], lambda pages: pages.withColumn("by", F.lit("second")))
    assert known.resolve("shop") is known.resolve(" store") and known.resolve("none") is None
    pages = spark.createDataFrame([(1, "SHOP"), (2, " other "), (3, "none"), (4, None), (5, "store")], "id long, provider string")
    assert {r.id: r.by for r in known.collected(pages, ["id", "by"]).collect()} == {1: "first", 2: "second", 5: "first"}
    known.register(["shop"], lambda pages: pages.withColumn("by", F.lit("third")))
    assert {r.id: r.by for r in known.collected(pages, ["id", "by"]).collect()}[1] == "third"
    assert not spark.range(1).select(Collectors().supported(F.lit("shop")).alias("x")).first().x
    with pytest.raises(ValueError):
        Collectors().collected(pages, ["id"])


def test_criteria_are_registered_once(spark):
    known = Criteria()
    known.register("a", "A", 2.0)
    with pytest.raises(ValueError, match="registered already"):
        known.register("a", "other", 1.0)
    known.register("b", "B", 1.0, higher_is_better=False)
    assert known.get("a") == ("A", 2.0, True) and list(known) == ["a", "b"] and "c" not in known
    scores = spark.createDataFrame([(1, "a", 80.0), (1, "b", 30.0), (1, "c", 0.0), (2, "a", None), (2, "b", 100.0)], "subject long, criterion_id string, score double")
    assert {r.subject: (r.score, r.criteria) for r in known.weighted(scores).collect()} == {1: ((160 + 70) / 3, 2), 2: (0.0, 1)}
    assert known.unregister("a") and not known.unregister("a") and known.get("a") is None


def test_new_queries_are_registered_with_sql():
    for name in ("published_products", "reviewed_products", "review_audit", "cascade_deletions", "run_metrics", "stream_run_memberships", "stream_run_routes"):
        assert name in registry.QUERIES and name in registry.ORACLE_SQL
