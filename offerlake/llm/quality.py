"""Quality rules, and a target-against-raw log-likelihood ratio of hashed n-grams.

Two multinomials over hashed byte n-grams are counted: one of the raw corpus (every document) and one
of a trusted target (every document labelled good). A document's score is the mean of
log p_target - log p_raw over its n-grams, which is free of its length; it is a sum of whole numbers, the same in any place of the table. Every document with a score
below the threshold goes; the threshold is a quantile of all trusted documents' own scores, less a margin.

Defined results: a null or empty text has no words and fails the rules (under ten words); its score is 0.
Without trusted documents the ratio is 0 everywhere and only the rules decide. Repeated rows are judged
alike. An empty table gives no rows. Texts of any length are judged whole, alike at every length. The input's columns travel in a struct, so that their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, Words, drop, quantile, stage, text_chunks, with_ids

NGRAM = 3
BUCKETS = 1 << 16
#: Log ratios are rounded to whole parts of this, so that a sum is exact and the same wherever a text lies.
PARTS = 1 << 24
#: Share of the trusted documents below the threshold before the margin, and the margin in nats an n-gram.
QUANTILE, MARGIN = 0.01, 0.1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
RULES = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType())])


def hashed_ngrams(data: np.ndarray) -> np.ndarray:
    """The bucket of each byte n-gram, by its first byte."""
    h = np.zeros(max(0, len(data) - NGRAM + 1), np.uint32)
    for i in range(NGRAM):
        h = h * np.uint32(257) + data[i : i + len(h)]
    return ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % BUCKETS


def _count(batches: Iterator) -> Iterator:
    """Counts of hashed n-grams over a partition."""
    import pyarrow as pa

    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, texts in text_chunks(batch.column(0)):
            data = np.frombuffer(b"".join(texts), np.uint8)
            if len(data) >= NGRAM:
                edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))[:-1]
                whole = np.ones(len(data) - NGRAM + 1, bool)
                for back in range(1, NGRAM):  # n-grams over a text's edge don't count
                    at = edges - back
                    whole[at[(at >= 0) & (at < len(whole))]] = False
                total += np.bincount(hashed_ngrams(data)[whole], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])


def counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """n-gram counts over all rows: partial sums a task, added by bucket; the result is BUCKETS numbers."""
    rows = docs.select(text_col).mapInArrow(_count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Add-one-smoothed log ratio per bucket; zeros without a target."""
    if not target.sum():
        return np.zeros(BUCKETS)
    smooth = lambda c: np.log((c + 1.0) / (c.sum() + BUCKETS))
    return smooth(target) - smooth(raw)


def in_parts(weights: np.ndarray) -> np.ndarray:
    """Weights as whole numbers."""
    return np.rint(weights * PARTS).astype(np.int64)


def _text_scores(words: Words, limits: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean of the whole weights of each text's n-grams; texts end at limits - 1, at a separator."""
    w = np.concatenate([[0], np.cumsum(weights[hashed_ngrams(words.data)])])
    first = np.concatenate([[0], limits[:-1]])
    n = limits - 1 - first - (NGRAM - 1)
    last = np.minimum(first + np.maximum(n, 0), len(w) - 1)
    return np.where(n > 0, (w[last] - w[np.minimum(first, len(w) - 1)]) / (np.maximum(n, 1) * PARTS), 0.0)


def measure(texts: list[bytes], weights: np.ndarray) -> dict[str, np.ndarray]:
    """The rules' figures and the score of each text, by whole weights."""
    words = Words(texts)
    k = len(texts)
    limits = np.cumsum(np.fromiter(map(len, texts), np.int64, k) + 1)
    owner = np.repeat(np.arange(k), np.diff(limits, prepend=0))
    n_words = np.diff(words.first)
    points = np.bincount(owner[(words.data & 0xC0) != 0x80], minlength=k) - 1  # without the separator
    spaces = np.bincount(owner[IS_SPACE[words.data]], minlength=k) - 1
    symbols = np.bincount(owner[_SYMBOL[words.data]], minlength=k)
    grams, whole = words.grams(5)
    repeat = np.zeros(k, np.int64)
    at = np.flatnonzero(whole)
    if len(at):
        keys = grams[at] ^ (words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
        windows = at[order[np.union1d(same, same + 1)]]
        edge = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edge, windows, 1)
        np.add.at(edge, windows + 5, -1)
        repeat = np.bincount(words.doc[np.cumsum(edge)[:-1] > 0], minlength=k)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x and not x.isspace()] if b"\n" in t else ()
        dup.append(len(lines) - len(set(lines)))
    return {"n_words": n_words, "word_chars": points - spaces, "n_symbols": symbols, "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": repeat, "base_failed": (n_words < 10) | (100 * repeat > 20 * n_words), "score": _text_scores(words, limits, weights)}


def annotate(docs: DataFrame, weights: np.ndarray, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``doc`` (a struct of the carried columns) and ``rules`` of every row."""
    carry = docs.columns if carry is None else carry
    model = docs.sparkSession.sparkContext.broadcast(in_parts(weights))  # BUCKETS numbers

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            doc = batch.column(0)
            parts = [measure(texts, model.value) for _, _, texts in text_chunks(doc.field(text_col))]
            if not parts:
                continue
            rules = pa.StructArray.from_arrays([pa.array(np.concatenate([p[f.name] for p in parts])) for f in RULES], names=RULES.names)
            kept = doc if carry == [f.name for f in doc.type] else pa.StructArray.from_arrays([doc.field(c) for c in carry], names=carry)
            yield pa.RecordBatch.from_arrays([kept, rules], names=["doc", "rules"])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*carry, text_col])]).alias("doc"))
    out = T.StructType([T.StructField("doc", T.StructType([docs.schema[c] for c in carry])), T.StructField("rules", RULES)])
    return whole.mapInArrow(run, out)


class QualityRules:
    """``judged``: ``doc``, ``rules`` and ``kept`` of every row; ``kept_rows``: the documents that stay."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None):
        good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("good_id")).distinct()
        named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        trusted = stage(with_ids(named, "id", good).select("text"), "quality-trusted")
        self.weights = log_ratio(counts(trusted, "text"), counts(docs, text_col))
        scores = stage(annotate(trusted, self.weights).where("not rules.base_failed").select("rules.score"), "quality-scores")
        at = quantile(scores, QUANTILE)
        drop(trusted)
        drop(scores)
        self.threshold = float("-inf") if at is None else at - MARGIN
        self.judged = annotate(docs, self.weights, text_col, carry).withColumn("kept", ~F.col("rules.base_failed") & (F.col("rules.score") >= self.threshold))
        self.kept_rows = self.judged.where("kept").select("doc.*")
