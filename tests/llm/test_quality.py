"""Fitting on all trusted documents: many of them, quantiles of many values, ids that no broadcast holds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from offerlake.llm import common, quality


def trusted_rows(spark, n):
    """Trusted texts and 3,000 others; the trusted ones with the highest hashes of ids are in Greek letters."""
    order = [r.id for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]
    late = set(order[20_000:])
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choices(letters, k=5))
    good = [(i, " ".join(word("αβγδεζηθ" if i in late else "abcdefgh") for _ in range(12))) for i in range(n)]
    return good + [(n + i, " ".join(word("qrstuvwx") for _ in range(12))) for i in range(3_000)], late


def test_every_trusted_document_counts(spark):
    rows, late = trusted_rows(spark, 22_000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(22_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    found = quality.QualityRules(docs, labels, carry=["doc_id"])
    target = quality.counts(docs.where("doc_id < 22000"), "text")
    assert (found.weights == quality.log_ratio(target, quality.counts(docs, "text"))).all()
    judged = found.judged.select("doc.doc_id", "rules.base_failed", "rules.score", "kept").collect()
    own = [r.score for r in judged if r.doc_id < 22_000 and not r.base_failed]
    assert found.threshold == pytest.approx(np.quantile(own, quality.QUANTILE) - quality.MARGIN, abs=1e-12)
    assert late and all(r.kept for r in judged if r.doc_id in late)
    assert not any(r.kept for r in judged if r.doc_id >= 22_000)


@pytest.mark.parametrize("cells", [2, 4096])
def test_quantile_is_exact(spark, monkeypatch, cells):
    monkeypatch.setattr(common, "CELLS", cells)
    rng = np.random.default_rng(4)
    tables = [[], [1.5], [0.0, -0.0, 0.0], [2.0] * 50 + [3.0] * 50, [1e300, -1e300, 5e-324, 0.0, 1.0], list(rng.normal(size=500)), list(np.round(rng.normal(size=500), 1)), [1.0, np.nextafter(1.0, 2), 7.0]]
    for values in tables:
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        for share in (0.0, 0.01, 0.5, 0.993, 1.0):
            assert common.quantile(df, share) == df.agg(F.percentile("x", F.lit(share))).first()[0]


def test_ids_beyond_a_broadcast_select_the_same_rows(spark, monkeypatch):
    keys = [*range(-3000, 3000), None, 0, 0, 2**63 - 1, -(2**63), 2**40]
    docs = spark.createDataFrame([(k, f"t{i}") for i, k in enumerate(keys)], "id long, text string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in [*range(-3000, 3000, 7), 0, 2**63 - 1, -(2**63), 5_000_000]], "good_id long").distinct()
    few = sorted(r.text for r in common.with_ids(docs, "id", ids).collect())
    wanted = {r.good_id for r in ids.collect()}
    assert few == sorted(f"t{i}" for i, k in enumerate(keys) if k in wanted)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    many = common.with_ids(docs, "id", ids)
    assert many.columns == docs.columns and sorted(r.text for r in many.collect()) == few
    assert common.candidates(docs, "id", ids.toDF("_id")).count() <= len(few) + 5


def test_ids_beyond_a_broadcast_are_joined_by_key(spark, monkeypatch, tmp_path):
    spark.range(1_000).write.parquet(f"{tmp_path}/ids")  # few bytes on disk: Spark by itself would broadcast them
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    found = common.with_ids(spark.range(3_000).toDF("key"), "key", spark.read.parquet(f"{tmp_path}/ids"))
    assert found.count() == 1_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1  # the ids, and the bitmap


def test_the_pipeline_keeps_trusted_documents_of_any_hash(spark, tmp_path):
    rows, late = trusted_rows(spark, 21_000)
    spark.createDataFrame([(*r, "en", "s1", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(21_000).selectExpr("id as doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert late and late <= kept
    assert not any(i >= 21_000 for i in kept)
