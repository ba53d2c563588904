"""Importance resampling towards a target: hashed n-gram features, a gain a bucket, Gumbel scores, the highest drawn.

Features are runs of one and two words. A batch's distinct words are found once and its distinct pairs by the
words' numbers, so a feature is hashed once a batch however often it stands there. Distinct features of equal
length form a matrix of bytes; the CRCs of a whole matrix are updated column by column, and the buckets are
scattered back to the places of the features.

Two passes: counts of buckets over the documents and over the target (a fixed number of figures), then each
document's mean gain. What is drawn is decided by a range sort of ids and scores and the parts' totals.

Defined results: a null or empty text has no words, weight 0 and no rank. Repeated rows score alike and are drawn each; a null id
is hashed as an empty one and comes last among ties. Without a target every gain follows from the smoothing alone. An empty table gives no
rows. Texts of any length are counted whole. The id and the text alone are read, so no column can clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, stage, text_chunks

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, "7"
#: Bytes of text, about, whose distinct features are hashed together.
TEXT_BYTES = 4 << 20

#: Bytes of words, of lower-cased text: digits, letters, and all of other characters.
_IN_WORD = np.ones(256, bool)
_IN_WORD[0x00:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_TABLE = _crc_table()


def matrix_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of bytes: those of one length are a matrix, whose CRCs go on column by column."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if not len(rows):
            continue
        matrix = np.lib.stride_tricks.sliding_window_view(data, int(length[rows[0]]))[start[rows]]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in np.ascontiguousarray(matrix.T):
            crc = _TABLE[(crc ^ column) & 0xFF] ^ crc >> 8
        out[rows] = ~crc
    return out


def _bytes_of(arrays: list[tuple[np.ndarray, np.ndarray]], data: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of data laid out one behind the other, those of a row joined by a byte: bytes, starts, lengths."""
    lengths = np.stack([n for _, n in arrays], axis=1)
    total = lengths.sum(axis=1) + len(arrays) - 1
    start = np.cumsum(total) - total
    out = np.full(int(total.sum()), gap, np.uint8)
    at = start
    for (source, n), i in zip(arrays, range(len(arrays)), strict=True):
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at, n) + step] = data[np.repeat(source, n) + step]
        at = at + lengths[:, i] + 1
    return out, start, total


def features(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and the owner and bucket of every feature."""
    import pyarrow as pa

    data = lower_ascii(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8))
    inside = _IN_WORD[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    limits = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    doc = np.searchsorted(limits, start, "right")
    n_words = np.bincount(doc, minlength=len(texts))
    if not len(start):
        return n_words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = end - start
    packed = data[inside]
    offsets = np.concatenate([[0], np.cumsum(length)])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(packed)]).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    distinct = len(words.dictionary)
    first = np.zeros(distinct, np.int64)  # a place of each distinct word
    first[code[::-1]] = np.arange(len(code))[::-1]
    at, size = offsets[first], length[first]
    one = matrix_crcs(packed, at, size) % np.uint32(buckets)
    pair = np.flatnonzero(doc[1:] == doc[:-1])
    both, place = np.unique(code[pair] * distinct + code[pair + 1], return_inverse=True)
    two = matrix_crcs(*_bytes_of([(at[both // distinct], size[both // distinct]), (at[both % distinct], size[both % distinct])], packed, 0x20)) % np.uint32(buckets)
    return n_words, np.concatenate([doc, doc[pair]]), np.concatenate([one[code], two[place]]).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows: a task adds up its own, Spark adds those."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0), TEXT_BYTES):
                total += np.bincount(features(texts, buckets)[2], minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Floored thousandths of the add-one-smoothed log ratio of target to raw, per bucket."""
    n = len(target)
    held, all_held = float(target.sum() + n), float(raw.sum() + n)
    pairs = zip((target + 1.0).tolist(), (raw + 1.0).tolist(), strict=True)
    return np.array([math.floor(1000 * math.log(t * all_held / (s * held))) for t, s in pairs], np.int64)


def _gumbel(doc_id: object, seed: str) -> int:
    """Floored thousandths of a Gumbel variate drawn by the id's hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class Resampling:
    """``scored``: doc_id, n_words, n_features, weight, score; ``ranked``: with the rank of what is drawn, null for the rest; ``drawn``: the rows that are."""

    def __init__(self, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED):
        self.gains = gains(bucket_counts(target, target_col, buckets), bucket_counts(docs, text_col, buckets))
        self._percent, self._least = percent, least_words
        model = docs.sparkSession.sparkContext.broadcast(self.gains)  # a number a bucket

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                ids = batch.column(0)
                for a, b, texts in text_chunks(batch.column(1), TEXT_BYTES):
                    words, owner, bucket = features(texts, buckets)
                    k = len(texts)
                    count = np.bincount(owner, minlength=k)
                    total = np.bincount(owner, model.value[bucket], k).astype(np.int64)  # whole numbers, far below 2^53
                    weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                    own = ids.slice(a, b - a)
                    score = weight + np.fromiter((_gumbel(x, seed) for x in own.to_pylist()), np.int64, k)
                    yield pa.RecordBatch.from_arrays([own, *map(pa.array, (words.astype(np.int64), count.astype(np.int64), weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

        longs = [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score")]
        self._docs, self._id = docs, id_col
        self.scored = docs.select(id_col, text_col).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *longs]))

    @property
    def ranked(self) -> DataFrame:
        """Places come from a range sort: a row's place in its part, and the rows of the parts before."""
        spark = self.scored.sparkSession
        able = F.col("n_words") >= self._least
        order = [able.desc(), F.desc("score"), F.col("doc_id").asc_nulls_last()]
        laid = stage(self.scored.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "resample-sorted")
        part = F.shiftright("at", 33)
        offset, rows, n = 0, [], 0
        for r in laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(able).alias("able")).orderBy("part").collect():  # a row a part
            rows.append((r.part, offset))
            offset, n = offset + r.n, n + r.able
        parts = spark.createDataFrame(rows, "part long, offset long")
        place = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        drawn = F.when(place <= self._percent * n // 100, place).alias("rank")
        return laid.join(F.broadcast(parts), part == parts.part).select("doc_id", "n_words", "n_features", "weight", "score", drawn)

    @property
    def drawn(self) -> DataFrame:
        """The drawn documents, whole; rows of one id come together."""
        ids = self.ranked.where("rank is not null").select(F.col("doc_id").alias("drawn_id")).distinct()
        return self._docs.join(ids, self._docs[self._id].eqNullSafe(F.col("drawn_id")), "left_semi")
