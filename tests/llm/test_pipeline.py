"""The pipeline stage by stage against brute force: nulls, an empty table, repeated rows, clashing columns and long texts."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from offerlake.llm.quality import QualityRules

from .test_operators import SPACES, WORD, corpus, shingles

#: Columns with names that the operators use inside.
EXTRA = "rid long, key string, size long, cid string, item long, position double, doc string, n long"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def documents():
    rows = corpus(5) + [(None, None, None, None, None), (9001, " ".join(f"w{i}" for i in range(30_000)), "en", "s1", 1)]
    return [(*r, i, "k", 1, "c", 2, 0.5, "d", 3) for i, r in enumerate(rows)]


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, 0) for r in rows[::2] if r[0] is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def staged(spark, folder):
    """The rows before and after each stage, as the check of the pipeline runs it: written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = {}
    for name, step in corpus_pipeline.STAGES:
        found = step(spark, docs, folder)
        path = f"{folder}/{name}"
        found.write.parquet(path)
        after = spark.read.parquet(path)
        before[name] = (docs, after)
        docs = after
    return before


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    return staged(spark, write(spark, tmp_path_factory.mktemp("pipeline"), documents()))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for name, (docs, after) in stages.items():
        if name != "pack_sequences":
            assert after.schema.names == docs.schema.names
            assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema]


def test_quality_keeps_what_passes_rules_and_ratio(spark, stages):
    docs, after = stages["quality_rules"]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in documents()[::2] if r[0] is not None], "doc_id long, quality int, toxic int")
    found = QualityRules(docs, labels)
    assert sorted(map(repr, rows_of(found.judged.where("kept").select("doc.*")))) == sorted(map(repr, rows_of(after)))
    short = [r for r in rows_of(after) if len(WORD.findall(r[1] or "")) < 10]
    assert not short and 0 < after.count() < docs.count()


def test_exact_dedup_keeps_one_of_equal_texts(stages):
    docs, after = stages["exact_dedup"]
    first = {}
    for r in rows_of(docs):
        body = SPACES.sub(" ", r[1] or "")
        first[body] = min(first.get(body, r[0]), r[0])
    assert sorted(r[0] for r in rows_of(after)) == sorted(first.values())
    assert set(map(repr, rows_of(after))) <= set(map(repr, rows_of(docs)))


def test_near_dedup_keeps_one_of_each_group(stages):
    docs, after = stages["near_dedup"]
    sets = {r[0]: shingles(r[1], 5) for r in rows_of(docs)}
    reach = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if reach[a] != reach[b] and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((reach[a], reach[b]))
                reach = {d: low if x == high else x for d, x in reach.items()}
    assert sorted(r[0] for r in rows_of(after)) == sorted(set(reach.values()))
    assert len(set(reach.values())) < len(ids)


def test_mix_takes_targets_in_order(stages):
    docs, after = stages["mix_sources"]
    size = lambda t: len(WORD.findall(t or ""))
    have, taken, own = collections.Counter(), collections.Counter(), {}
    for r in rows_of(docs):
        have[r[3]] += size(r[1])
        own[r[0]] = size(r[1])
    for r in rows_of(after):
        taken[r[3]] += size(r[1])
    total = sum(have.values())
    assert all(n <= 2 * have[s] for s, n in taken.items())
    assert sum(taken.values()) == pytest.approx(min(1.5 * total, 2 * total), rel=0.01)
    per = collections.Counter()
    for r in rows_of(after):
        per[r[0]] += size(r[1])
    assert all(n <= 2 * own[d] for d, n in per.items())


def test_packing_lays_every_token_once(stages):
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, after = stages["pack_sequences"]
    want = collections.Counter()
    for r in rows_of(docs):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want.update((r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    found = after.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    parts = collections.defaultdict(list)
    for r in found:
        parts[r.sequence_id].append((r.offset, r.length))
    for own in parts.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_an_empty_table_stays_empty(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
