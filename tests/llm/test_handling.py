"""Very long texts, repeated rows, ties, null ids and clashing columns, operator by operator."""

import hashlib

import pytest

from offerlake.llm import exact_dedup, ngram_join, packing, quality, secrets, substring_dedup, toxicity, warc
from offerlake.llm.line_dedup import LineDedup
from offerlake.llm.mixing import Mix
from offerlake.llm.tokens import default_tokenizer

LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(95_000))
SAME = "word " * 200_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a"), (2, LONG + " end", "a"), (3, SAME, "b"), (4, SAME, "b"), (5, "x" * 1_000_000, None), (6, "line\n" * 100_000, "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")


def test_long_texts_exact(docs):
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.ExactDedup(docs).decisions.collect()}
    assert found == {1: (1, 1), 2: (2, 1), 3: (3, 2), 4: (3, 2), 5: (5, 1), 6: (6, 1)}


def test_long_texts_join(docs):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.NgramJoin(docs).docs.collect()}
    assert found[2][0] == found[1][0] + 1 == 95_000 - 4 + 1 and found[2][1] == 1
    assert found[3] == found[4] == (1, 3) and found[5] == (1, 5) and found[6] == (1, 6)


def test_long_texts_substrings(docs):
    found = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.SubstringDedup(docs).result.collect()}
    assert found == {1: (95_000, 0), 2: (95_001, 95_000), 3: (200_000, 0), 4: (200_000, 200_000), 5: (1, 0), 6: (100_000, 0)}


def test_long_texts_in_the_other_operators(docs, labels):
    assert {r.doc_id: r["size"] for r in Mix(docs).plan.collect()} == {1: 95_000, 2: 95_001, 3: 200_000, 4: 200_000, 5: 1, 6: 100_000}
    judged = {r.doc_id: r for r in quality.QualityRules(docs, labels, carry=["doc_id"]).judged.select("doc.doc_id", "rules.*").collect()}
    assert (judged[3].n_words, judged[3].n_repeat_words, judged[6].n_dup_lines, judged[5].word_chars) == (200_000, 200_000, 99_999, 1_000_000)
    scores = {r.doc_id: r.score for r in toxicity.Toxicity(docs, labels).scored.collect()}
    assert len(scores) == 6 and scores[3] == scores[4]
    lines = {r.doc_id: r for r in LineDedup(docs).result.collect()}
    assert lines[6].n_lines == 100_001 and lines[4].kept_text == SAME
    spans = {r.doc_id: r.spans for r in secrets.report(secrets.find_secrets(docs)).collect()}
    assert set(spans.values()) == {""}


def test_long_texts_packed(docs):
    tok = default_tokenizer()
    found = packing.pack(docs).groupBy("doc_id").sum("length").collect()
    texts = {1: LONG, 2: LONG + " end", 3: SAME, 4: SAME, 5: "x" * 1_000_000, 6: "line\n" * 100_000}
    assert {r.doc_id: r["sum(length)"] for r in found} == {d: len(tok.encode(t)) + 1 for d, t in texts.items()}


def test_archives_with_null_ids_ties_and_clashing_columns(spark):
    body = "<p>same</p>" * 200
    rows = [(None, "http://a/", body, "x", 1), (7, "http://b/", body, "x", 1), (7, "http://b/", body, "x", 1), (3, None, body, "x", 1), (None, None, None, None, None), (8, "http://c/", "y" * 2_000_000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, revisit int")
    found = warc.archive_pages(pages).collect()
    told = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in found), key=repr)
    n = len(body)
    want = [(True, 0, "revisit", 7, n), (False, 7, "response", None, n), (False, 7, "response", None, n), (False, 3, "revisit", 7, n), (True, 0, "response", None, 0), (False, 8, "response", None, 2_000_000)]
    assert told == sorted(want, key=repr)
    assert {r.payload_digest for r in found if r.payload_bytes == n} == {hashlib.sha1(body.encode()).hexdigest()}


def test_rows_that_are_repeated_whole(spark, labels):
    text = " ".join(f"u{i}" for i in range(100)) + ' password = "aB3dE5fG7hJ9"'
    docs = spark.createDataFrame([(1, text, "s")] * 3 + [(2, text, "s")], "doc_id long, text string, source string")
    assert len({tuple(r) for r in secrets.report(secrets.find_secrets(docs)).drop("doc_id").collect()}) == 1
    assert [r.n_removed for r in substring_dedup.SubstringDedup(docs).result.orderBy("doc_id").collect()] == [0, 0, 0, 103]
    assert ngram_join.NgramJoin(docs).kept.count() == exact_dedup.ExactDedup(docs).kept.count() == 1
    assert sum(r.taken for r in Mix(docs).plan.collect()) == int(1.5 * 4 * 103)
