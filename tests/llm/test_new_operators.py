"""Token files, whitening and resampling against brute force: nulls, empty tables, ties, repeated rows, long texts, clashing columns."""

import glob
import hashlib
import math
import random
import re
import tempfile
import zlib
from collections import Counter

import numpy as np
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

from offerlake.llm import resampling, whitening
from offerlake.llm.token_files import TokenFiles, crc_before
from offerlake.llm.tokens import default_tokenizer

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def texts(seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcDEé9'", k=rng.randint(1, 7))) for _ in range(300)]
    found = [None, "", " \t", "one", "A-b_C", "É!é ç", "x " * 9000, "w" * 30_000, "<|endoftext|> a"]
    found += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 90))) for _ in range(120)]
    return found + found[-3:]


@pytest.fixture(scope="module")
def rows():
    found = [((i * 37) % 1009, t) for i, t in enumerate(texts())]
    return found + [found[20], (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, start string, part int, score int").repartition(5)


# --- token files ------------------------------------------------------------------------


def test_moved_checksums_combine():
    rng = random.Random(1)
    for n in (0, 1, 4, 1000, 70_000):
        a, b = rng.randbytes(37), rng.randbytes(n)
        assert crc_before(zlib.crc32(a), n) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_token_files_hold_every_id_in_order(spark, docs, rows):
    tok = default_tokenizer()
    files = TokenFiles.write(docs, piece=64)
    found = sorted(files.documents.collect(), key=lambda r: r.start)
    assert len(found) == len(rows)
    ids = [r.doc_id for r in found]
    assert ids[:2] == [None, None] and ids[2:] == sorted(d for d, _ in rows if d is not None)
    want = Counter()
    for d, t in rows:
        data = np.append(tok.encode(t or ""), np.uint32(0)).astype("<u4").tobytes()
        want[d, len(data) // 4, zlib.crc32(data)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    at = sorted(files.tokens.collect(), key=lambda r: r.start)
    stream = np.concatenate([r.ids for r in at])
    assert [r.start for r in at] == np.cumsum([0, *[len(r.ids) for r in at]])[:-1].tolist() and max(len(r.ids) for r in at) == 64
    for r in found:
        assert zlib.crc32(stream[r.start : r.start + r.n_tokens].astype("<u4").tobytes()) == r.ids_crc32


def test_token_files_of_nothing(spark, docs):
    assert TokenFiles.write(docs.limit(0)).documents.collect() == []


def test_token_files_are_read_by_stripe_and_pruned_by_their_indexes(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i * 3, " ".join(str(rng.randrange(10**9)) for _ in range(100))) for i in range(4000)], "doc_id long, text string")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/tokens"
    files = TokenFiles.write(docs.coalesce(1), path, stripe_bytes=100_000, stride=1000)
    orc = [pyarrow.orc.ORCFile(f) for f in glob.glob(f"{path}/*.orc")]
    assert max(f.nstripes for f in orc) > 1 and sum(f.nrows for f in orc) == 4000
    # A part per stripe or so, when splits are small.
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        assert files.pieces.rdd.getNumPartitions() > len(orc)
        assert files.documents.agg(F.sum("n_tokens")).first()[0] == sum(len(r.ids) for r in files.tokens.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

    def rows_read(wanted):
        df = files.lookup(wanted)
        got = [r.doc_id for r in df.collect()]
        return got, df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    got, scanned = rows_read(1500)
    assert got == [1500] and scanned <= 1000  # an entry of the row index
    got, scanned = rows_read(1501)  # within the range of a stripe, but in no Bloom filter
    assert got == [] and scanned == 0
    narrow = files.pieces.where("piece = 0").select("doc_id", "n_tokens")
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]


# --- whitening --------------------------------------------------------------------------


def brute_whitening(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    z = x * n - sums
    cov = np.array((z.T.dot(z)), float) / n**3
    values, vecs = np.linalg.eigh(cov)
    order = np.argsort(-values)
    return n, [sum(v * v for v in row) for row in z], values[order], vecs[:, order], np.array(z, float) / n, np.trace(cov)


def test_whitening_equals_an_eigendecomposition(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    vectors = base @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 7
    rows = [(i, [float(c) for c in v], "a", 0.5) for i, v in enumerate(vectors)]
    rows += [rows[3], rows[3], (None, rows[5][1], "a", 0.5)]
    bad = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0] * 11), (906, [1e300] * 12)]
    table = spark.createDataFrame(rows + [(*b, "z", 1.5) for b in bad], "vec_id long, embedding array<double>, n string, explained double").repartition(4)
    found = whitening.Whitening(table)
    got = found.rows.collect()
    n, deviation, values, vecs, d, trace = brute_whitening([r[1] for r in rows])
    assert len(got) == 8 * len(rows) == 8 * n and {r.vec_id for r in got} == {r[0] for r in rows}
    assert {r.n for r in got} == {n} and found.identity_error <= 1e-10
    for k in range(8):
        w = d @ vecs[:, k] / math.sqrt(values[k])
        own = {r.vec_id: r for r in got if r.component == k + 1}
        sign = 1 if np.sign(own[0].whitened) == np.sign(w[0]) else -1
        for (i, *_), a, b in zip(rows, w, deviation, strict=True):
            assert own[i].whitened == pytest.approx(sign * a, abs=1e-9) and int(own[i].deviation) == b
            assert own[i].explained == pytest.approx(values[k] / trace, rel=1e-10)


def test_whitening_does_not_depend_on_the_partitions(spark):
    rng = np.random.default_rng(8)
    table = spark.createDataFrame([(i, [float(c) for c in rng.normal(size=5)]) for i in range(200)], "vec_id long, embedding array<float>")
    told = [{(r.vec_id, r.component): r.whitened for r in whitening.Whitening(table.repartition(k, "vec_id")).rows.collect()} for k in (1, 7)]
    assert told[0] == pytest.approx(told[1], abs=1e-12)


def test_whitening_of_few_equal_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    flat = [(i, [float(i), float(2 * i), 1.0]) for i in range(5)]
    assert {r.component for r in whitening.Whitening(spark.createDataFrame(flat, schema)).rows.collect()} == {1}  # rank one
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3, [(1, None)]):
        assert whitening.Whitening(spark.createDataFrame(few, schema)).rows.collect() == []


def test_exact_products_of_large_numbers():
    rng = np.random.default_rng(0)
    for top in (10, 1 << 24, 1 << 40):
        y = rng.integers(-top, top, size=(50, 3))
        want = y.astype(object).T.dot(y.astype(object))
        assert (whitening.products(y) == want).all()


def test_jacobi_gives_small_eigenvalues_to_full_precision():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0]
    want = np.array([1e8, 1e4, 1.0, 1e-2, 1e-3, 1e-4])
    low, p = whitening.pivoted_cholesky((q * want) @ q.T)
    assert (np.triu(low, 1) == 0).all()
    w = whitening.one_sided_jacobi(low)
    assert np.sort((w * w).sum(axis=0))[::-1][:4] == pytest.approx(want[:4], rel=1e-6)


# --- resampling -------------------------------------------------------------------------


def brute_features(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def brute_ranks(rows, target, percent=25, least=20, n=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % n
    held = Counter(bucket(f) for t in target for f in brute_features(t)[1])
    raw = Counter(bucket(f) for _, t in rows for f in brute_features(t)[1])
    t_all, s_all = sum(held.values()), sum(raw.values())
    gain = lambda b: math.floor(1000 * math.log((held[b] + 1) * (s_all + n) / ((raw[b] + 1) * (t_all + n))))
    out, able = [], []
    for i, (d, t) in enumerate(rows):
        words, features = brute_features(t)
        weight = math.floor(sum(gain(bucket(f)) for f in features) / len(features)) if features else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(features), weight, score, None])
        if len(words) >= least:
            able.append((-score, d is None, d, i))
    for place, (*_, i) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[i][4] = place
    return Counter(map(tuple, out))


def test_resampling_equals_brute_force(spark, docs, rows):
    target = [None, "one a b", *[t for t in texts(5)[20:60]]]
    held = spark.createDataFrame([(t,) for t in target], "text string")
    found = resampling.Resampling(docs, held)
    got = found.ranked.drop("n_words").collect()
    assert Counter(map(tuple, got)) == brute_ranks(rows, target)
    drawn = {r.doc_id for r in got if r["rank"]}
    assert drawn and {r.doc_id for r in found.drawn.collect()} == drawn


def test_resampling_without_target_or_documents(spark, docs, rows):
    held = spark.createDataFrame([], "text string")
    assert Counter(map(tuple, resampling.Resampling(docs, held).ranked.drop("n_words").collect())) == brute_ranks(rows, [])
    assert resampling.Resampling(docs.limit(0), docs).ranked.collect() == []


def test_matrix_checksums():
    rng = random.Random(9)
    parts = [rng.randbytes(rng.choice([0, 1, 2, 2, 5, 5, 5, 40, 3000])) for _ in range(200)]
    data = np.frombuffer(b"".join(parts) + b"x" * 3000, np.uint8)
    sizes = np.array(list(map(len, parts)))
    assert resampling.matrix_crcs(data, np.cumsum(sizes) - sizes, sizes).tolist() == list(map(zlib.crc32, parts))


# --- earlier operators ------------------------------------------------------------------


def test_archives_are_read_as_files(spark, tmp_path):
    from offerlake.llm import warc

    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>text</p>" * (i % 3) * 100) for i in range(30)], "page_id long, url string, html string").repartition(2)
    for r in warc.write_archives(pages).collect():
        (tmp_path / f"{r.archive_id}.warc.zst").write_bytes(r.archive)
    (tmp_path / "other.txt").write_text("no archive")
    found = {r.page_id: (r.url, r.payload_bytes, r.record_type) for r in warc.read_files(spark, str(tmp_path)).collect()}
    assert {i: (u, n) for i, (u, n, _) in found.items()} == {i: (f"http://h/{i}", 1100 * (i % 3)) for i in range(30)}
    assert {i for i, (_, n, kind) in found.items() if kind == "response" and n} == {28, 29}  # the last of each equal payload


def test_a_mix_of_columns_that_clash(spark):
    from offerlake.llm.mixing import Mix

    rows = [(i, "word " * (i + 1), "s", "own", 1.5, "p") for i in range(5)]
    mix = Mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target double, position string"))
    plan, schedule = mix.plan, mix.schedule
    assert plan.columns == ["doc_id", "text", "source", "doc_size", "doc_target", "position", "size", "source_size", "target", "taken"]
    assert {r["size"] for r in plan.collect()} == {1, 2, 3, 4, 5}
    assert len(set(schedule.columns)) == len(schedule.columns) and {r.doc_position for r in schedule.collect()} == {"p"}
    assert mix.rows.columns == ["doc_id", "text", "source", "size", "target", "position"]
