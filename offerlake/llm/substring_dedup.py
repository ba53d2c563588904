"""Removal of word windows that start in an earlier document, by super-k-mer partitioning.

A window is WINDOW consecutive words; its minimiser is the smallest hash of the MINIMISER-word runs in it.
Consecutive windows with one minimiser travel as one packed string (a super-k-mer) to the bucket of the
minimiser, where the windows are sorted and equal ones met exactly. The bucket answers, per string, from
which window to which an earlier document has them; documents apply the answers to their own words.

Three things keep the exchange small. Minimisers that one document has alone can't repeat, so a count of
them comes first. A task sends equal strings once. And a minimiser with very many different strings (a
passage that very many documents share, each in its own context) is split: its windows travel one by one and
are grouped by their words, with partial sums in each task.

Defined results: a null text has no words. A null id counts as the largest. Rows with equal ids don't
remove each other's words, and repeated rows get the same result. Windows are judged on the input. Ids are
integers. An empty table gives none. A text of any length is taken whole; a long run of one repeated word is
many strings of bounded size, equal ones sent once. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, fits, stage, text_chunks
from .filters import MAX_BITS, KeyFilter, key_filter

WINDOW, MINIMISER = 50, 10
#: Packed strings in a bucket, and of one minimiser before its windows are aggregated singly.
BUCKET_STRINGS, HOT_STRINGS = 4000, 5000
#: Distinct strings that a task holds before it sends them.
TASK_STRINGS = 50_000
#: Windows of one packed string; a longer run of one minimiser (repeated words) is several strings.
STRING_WINDOWS = 256
_LAST = (1 << 63) - 1


def canonical(column) -> list[bytes]:
    """Texts as their words, joined by one space (bytes.split knows just the six ASCII spaces)."""
    import pyarrow as pa

    return [b" ".join((x or b"").split()) for x in column.cast(pa.binary()).to_pylist()]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class SuperKmers:
    """The super-k-mers of some canonical texts: minimiser, text, first window and number of windows of each."""

    def __init__(self, texts: list[bytes], window: int = WINDOW, minimiser: int = MINIMISER):
        self.words, self.window = Words(texts), window
        grams, _ = self.words.grams(minimiser)
        width = window - minimiser + 1
        empty = np.zeros(0, np.int64)
        self.minimisers, self.text, self.first, self.windows, self.begin, self.end = empty.astype(np.uint64), empty, empty, empty, empty, empty
        if len(grams) < width:
            return
        least = sliding_min(grams, width)
        doc = self.words.doc
        valid = np.flatnonzero(doc[: len(least)] == doc[window - 1 : window - 1 + len(least)])
        if not len(valid):
            return
        new = np.ones(len(valid), bool)
        new[1:] = (least[valid[1:]] != least[valid[:-1]]) | (doc[valid[1:]] != doc[valid[:-1]]) | (valid[1:] != valid[:-1] + 1)
        at = np.flatnonzero(new)
        windows = np.diff(np.append(at, len(valid)))
        parts = -(-windows // STRING_WINDOWS)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start = valid[np.repeat(at, parts) + nth * STRING_WINDOWS]
        self.windows = np.minimum(np.repeat(windows, parts) - nth * STRING_WINDOWS, STRING_WINDOWS)
        self.minimisers, self.text = least[start], doc[start]
        self.first = start - self.words.first[self.text]
        self.begin, self.end = self.words.start[start], self.words.end[start + self.windows + window - 2]

    def packed(self, i: int) -> bytes:
        return self.words.data[self.begin[i] : self.end[i]].tobytes()


def _minimisers(batches: Iterator) -> Iterator:
    """Each document's distinct minimisers."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for a, b, texts in text_chunks(batch.column(1), read=canonical):
            found = SuperKmers(texts)
            yield pa.RecordBatch.from_arrays([pa.array(found.minimisers.view(np.int64)), pa.array(ids[a:b][found.text])], names=["mh", "id"])


_ROWS = "sid binary, mh long, id long, th long, first long, windows long, packed binary, low long, high long"


def _super_kmers(keep: KeyFilter):
    """Occurrences (id, th, first, windows), and each distinct string of the task with its lowest and highest id."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        strings: dict[bytes, list] = {}

        def flush():
            rows = [(s, m, None, None, None, n, p, lo, hi) for s, (m, n, p, lo, hi) in strings.items()]
            strings.clear()
            return record(rows)

        def record(rows):
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sid", "mh", "id", "th", "first", "windows", "packed", "low", "high"])

        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in text_chunks(batch.column(2), read=canonical):
                found = SuperKmers(texts)
                rows = []
                mh = found.minimisers.view(np.int64)
                for i in np.flatnonzero(keep.hits(found.minimisers)):
                    packed = found.packed(i)
                    sid = hashlib.blake2b(packed, digest_size=16).digest()
                    doc, n = a + int(found.text[i]), int(found.windows[i])
                    rows.append((sid, int(mh[i]), ids[doc], hashes[doc], int(found.first[i]), n, None, None, None))
                    known = strings.get(sid)
                    if known is None:
                        strings[sid] = [int(mh[i]), n, packed, ids[doc], ids[doc]]
                    else:
                        known[3], known[4] = min(known[3], ids[doc]), max(known[4], ids[doc])
                if rows:
                    yield record(rows)
                if len(strings) >= TASK_STRINGS:
                    yield flush()
        if strings:
            yield flush()

    return run


def _windows(packed: bytes, n: int, window: int = WINDOW) -> list[bytes]:
    """The n windows of a packed string."""
    edges = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32)
    starts = [0, *(edges + 1).tolist()]
    ends = [*edges.tolist(), len(packed)]
    return [packed[starts[j] : ends[j + window - 1]] for j in range(n)]


def _runs(lows: list[int | None]) -> list[tuple[int, int, int]]:
    """Consecutive windows with one answer: offset, length, lowest id."""
    out = []
    for j, low in enumerate(lows):
        if low is None:
            continue
        if out and out[-1][0] + out[-1][1] == j and out[-1][2] == low:
            out[-1] = (out[-1][0], out[-1][1] + 1, low)
        else:
            out.append((j, 1, low))
    return out


def _bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sorts the windows of each minimiser; equal ones of several documents are answered with the lowest id."""
    pdf = pdf.sort_values(["mh", "sid"], kind="stable", ignore_index=True)
    fresh = ~pdf.duplicated(["mh", "sid"])
    at = np.flatnonzero(fresh)
    mh, sid, packed, n = (pdf[c].to_numpy()[at] for c in ("mh", "sid", "packed", "windows"))
    low, high = np.minimum.reduceat(pdf["low"].to_numpy(), at), np.maximum.reduceat(pdf["high"].to_numpy(), at)
    limits = np.append(np.flatnonzero(np.append(True, mh[1:] != mh[:-1])), len(mh))
    out = []
    for a, b in zip(limits[:-1], limits[1:], strict=True):
        if b - a == 1:
            if low[a] < high[a]:
                out.append((sid[a], 0, n[a], low[a]))
            continue
        windows = sorted((w, i, j) for i in range(a, b) for j, w in enumerate(_windows(packed[i], n[i])))
        answers = {i: [None] * n[i] for i in range(a, b)}
        x = 0
        while x < len(windows):
            y = x + 1
            while y < len(windows) and windows[y][0] == windows[x][0]:
                y += 1
            same = windows[x:y]
            lowest, highest = min(low[i] for _, i, _ in same), max(high[i] for _, i, _ in same)
            if lowest < highest:
                for _, i, j in same:
                    answers[i][j] = lowest
            x = y
        out += [(sid[i], *r) for i in range(a, b) for r in _runs(answers[i])]
    return pd.DataFrame(out, columns=["sid", "off", "len", "low"])


def _single_windows(batches: Iterator) -> Iterator:
    """The windows of hot minimisers' strings, one a row."""
    import pyarrow as pa

    for batch in batches:
        rows = [(sid, j, w, lo, hi) for sid, packed, n, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True) for j, w in enumerate(_windows(packed, n))]
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["sid", "off", "words", "low", "high"])


def _answers(table: DataFrame, hot_strings: int) -> DataFrame:
    """sid, off, len, low: windows that several documents have, and the lowest id that has them."""
    strings = table.where("packed is not null").select("mh", "sid", "packed", "windows", "low", "high")
    loads = strings.groupBy("mh").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_strings).select("mh", F.lit(True).alias("hot"))
    loads = stage(loads, "substring-hot")
    n_hot = loads.count()
    near = F.broadcast(loads) if fits(n_hot, 32) else loads
    n = strings.count()
    cold = strings.join(near, "mh", "left_anti") if n_hot else strings
    bucket = F.pmod(F.xxhash64("mh"), F.lit(max(1, -(-n // BUCKET_STRINGS))))
    answers = cold.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(_bucket, "sid binary, off long, len long, low long")
    if n_hot:
        single = strings.join(near, "mh", "left_semi").select("sid", "packed", "windows", "low", "high").mapInArrow(_single_windows, "sid binary, off long, words binary, low long, high long")
        single = stage(single, "substring-single")
        shared = single.groupBy("words").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most")
        answers = answers.union(single.join(shared, "words").select("sid", "off", F.lit(1).cast("long"), "least").distinct())
    return answers


class SubstringDedup:
    """``ranges``: per document (id, th) the word ranges to remove; ``result``: their effect on every row."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_BITS, hot_strings: int = HOT_STRINGS):
        keyed = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).alias("id"), F.xxhash64(text_col).alias("th"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        seen = keyed.select("id", "text").mapInArrow(_minimisers, "mh long, id long").groupBy("mh").agg(F.min("id").alias("low"), F.max("id").alias("high"))
        repeated = stage(seen.where("low < high").select("mh"), "substring-minimisers")
        keep = key_filter(repeated, "mh", repeated.count(), max_filter_bits)
        found = keyed.select("id", "th", "text").mapInArrow(_super_kmers(keep), _ROWS)
        table = stage(found, "substring-strings")
        answers = stage(_answers(table, hot_strings), "substring-answers")
        occurrences = table.where("packed is null").select("sid", "id", "th", "first")
        hit = occurrences.join(answers, "sid").where("low < id")
        start = F.col("first") + F.col("off")
        self.ranges = hit.groupBy("id", "th").agg(F.collect_set(F.struct(start.alias("a"), (start + F.col("len") + WINDOW - 1).alias("b"))).alias("ranges"))
        self._docs = keyed.join(self.ranges, ["id", "th"], "left").select("doc_id", "text", "ranges")
        self._id_type = docs.schema[id_col].dataType

    @property
    def result(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 and the kept text."""
        schema = T.StructType([T.StructField("doc_id", self._id_type), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])
        return self._docs.mapInArrow(_apply, schema)


def _apply(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        counts, removed, digests, texts = [], [], [], []
        for text, ranges in zip(canonical(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.split() if ranges else None
            total = len(words) if ranges else (text.count(b" ") + 1 if text else 0)
            gone = 0
            if ranges:
                stay = np.ones(total, bool)
                for r in ranges:
                    stay[r["a"] : r["b"]] = False
                gone = total - int(stay.sum())
                text = b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s)
            counts.append(total)
            removed.append(gone)
            digests.append(hashlib.sha256(text).hexdigest())
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])
