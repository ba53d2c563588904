"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each partition sorts the fingerprints of its texts and sends them to their owners (ranges of
   the fingerprint space) as Golomb-Rice-coded gaps, about two bytes each.
2. Each owner finds those that two partitions sent, and returns one bitmap per partition.
3. Rows whose bit is set, or whose fingerprint repeats inside their own partition, are suspects.
   Only their texts are shuffled; grouping by the text itself verifies the bytes.

Defined results: a null text counts as empty. Of equal texts, the row with the smallest id stays,
null ids last; of repeated rows with that id, one stays. An empty table gives an empty result.
Columns of the input travel inside one struct, so their names can't clash with the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fits, normalised, small, stage

#: Rows whose fingerprints a task sorts at once.
RUN_ROWS = 1 << 20
#: Distinct fingerprints that one owner should get.
OWNER_ROWS = 1 << 18
#: Bits beyond log2(rows): one in 2**12 singles is suspected wrongly.
SPARE_BITS = 12


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct non-negative integers as Golomb-Rice codes of their gaps.

    A byte for the parameter k, four for the count, then all quotients in unary, then all k-bit remainders.
    """
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    n = len(gaps)
    k = max(0, int(np.log2(max(1.0, gaps.mean() * 0.69))) if n else 0)
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    unary[ends - 1] = 1
    low = (gaps[:, None] >> np.arange(k)) & 1
    return bytes([k]) + n.to_bytes(4, "little") + np.packbits(unary).tobytes() + np.packbits(low.astype(np.uint8).ravel()).tobytes()


def golomb_decode(blob: bytes) -> np.ndarray:
    k, n = blob[0], int.from_bytes(blob[1:5], "little")
    body = np.frombuffer(blob, np.uint8, offset=5)
    low_bytes = (n * k + 7) // 8
    ones = np.flatnonzero(np.unpackbits(body[: len(body) - low_bytes]))[:n]
    quotients = np.diff(ones, prepend=-1) - 1
    low = np.unpackbits(body[len(body) - low_bytes :])[: n * k].reshape(n, k).astype(np.int64)
    gaps = (quotients << k) + (low << np.arange(k)).sum(axis=1)
    return np.cumsum(gaps + 1) - 1


def _encoder(bits: int, owners: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, seq, held, rows = TaskContext.get().partitionId(), 0, [], 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= RUN_ROWS:
                yield encode(pd.concat(held), (part << 24) + seq)
                seq, held, rows = seq + 1, [], 0
        if rows:
            yield encode(pd.concat(held), (part << 24) + seq)

    def encode(pdf: pd.DataFrame, run_id: int) -> pd.DataFrame:
        short = (pdf.fp.to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        values, where, counts = np.unique(short, return_inverse=True, return_counts=True)
        width = -(-(1 << bits) // owners)
        owner = values // width
        first = np.searchsorted(owner, owner)
        blobs = {int(o): golomb_encode(values[owner == o] - o * width) for o in np.unique(owner)}
        out = pd.DataFrame({"rid": pdf.rid.to_numpy(), "run": run_id, "owner": owner[where], "pos": (np.arange(len(values)) - first)[where], "twice": counts[where] > 1})
        out["blob"] = None
        lead = ~out.owner.duplicated()
        out.loc[lead, "blob"] = out.owner[lead].map(blobs)
        return out

    return run


def _owner_bitmaps(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = [golomb_decode(b) for b in pdf.blob]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    shared = values[counts > 1]
    rows = []
    for run, own in zip(pdf.run, lists, strict=True):
        hit = np.isin(own, shared, assume_unique=True)
        if hit.any():
            hit = np.concatenate([hit, np.zeros(-len(hit) % 64, bool)])
            rows.append((run, pdf.owner.iloc[0], np.packbits(hit, bitorder="little").view(np.int64)))
    return pd.DataFrame(rows, columns=["run", "owner", "words"])


class ExactDedup:
    """``decisions``: a row per document; ``kept``: the rows that stay, in the input's columns."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        names = docs.columns
        text = normalised(F.col(f"doc.{text_col}"))
        wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
        #: One write gives every row an id that no later scan changes.
        self.rows = stage(wrapped.select("doc", F.monotonically_increasing_id().alias("rid"), F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("sha")), "exact-rows")
        n = self.rows.count()
        bits = min(62, max(1, n).bit_length() + SPARE_BITS)
        owners = max(1, n // OWNER_ROWS)
        ranked = stage(self.rows.select("rid", "fp").mapInPandas(_encoder(bits, owners), "rid long, run long, owner long, pos long, twice boolean, blob binary"), "exact-ranks")
        sent = ranked.where("blob is not null").select("run", "owner", "blob")
        bitmaps = stage(sent.groupBy("owner").applyInPandas(_owner_bitmaps, "run long, owner long, words array<long>"), "exact-bitmaps")
        replies = bitmaps.count()
        bit = F.expr("shiftright(get(words, cast(shiftright(pos, 6) as int)), cast(pos % 64 as int)) & 1")
        back = F.broadcast(bitmaps) if fits(replies * 64 + n // 8, 1) else bitmaps
        suspects = stage(ranked.drop("blob").join(back, ["run", "owner"], "left").where(F.col("twice") | (F.coalesce(bit, F.lit(0)) == 1)).select("rid"), "exact-suspects")
        n_suspects = suspects.count()
        near = small(suspects, n_suspects, 32)

        doc_id = F.col(f"doc.{id_col}").alias("id")
        found = self.rows.join(near, "rid", "left_semi")
        # Grouping by the text compares the bytes; copies within a task are combined before the shuffle.
        classes = found.select("fp", "sha", doc_id, text.alias("body")).groupBy("fp", "sha", "body").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).drop("body")
        labelled = stage(found.select("rid", "fp", "sha", doc_id).join(classes, ["fp", "sha"]), "exact-labelled")
        stays = labelled.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("fp", "sha").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("stays"))
        judged = labelled.join(stays, "rid", "left").select("rid", "id", "keep_id", "group_size", F.coalesce("stays", F.lit(False)).alias("kept"), "sha")
        alone = self.rows.select("rid", doc_id, "sha").join(near, "rid", "left_anti").select("rid", "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
        self.decisions = alone.unionByName(judged).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
        dropped = judged.where(~F.col("kept")).select("rid")
        self.kept = self.rows.join(small(dropped, n_suspects, 32), "rid", "left_anti").select("doc.*")
