"""Token ids of whole texts in ORC files, in ascending order of document ids.

A row is a piece of a document: its place in the file's order, its document's id and number of tokens, and up to
PIECE ids. ORC stores ids by integer run-length encoding in stripes; every stripe has a row index (smallest and
largest document id each STRIDE rows) and a Bloom filter on the document id. So a reader splits files by stripes,
reads the narrow columns without the ids, and skips stripes and row groups in a look-up.

Documents are sorted by range, so files hold ascending, disjoint stretches of ids. A file's rows know where they
start in their part; the parts' totals, read from the files, give the offsets. Checksums of pieces are moved over
the ids behind them and combined by exclusive or, so pieces are read in any order and no document is gathered again.

Defined results: a null or empty text is the end id alone. Null ids come first. Rows with one id stand next to each
other, by the hash of their texts; each is a document with its own start. An empty table gives an empty result.
A text of any length is encoded whole and laid out in pieces. Only the id and the text are read, so no other column
can clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, text_chunks
from .tokens import tokenizer_of

#: Ids of a row; rows of an entry of the row index; bytes of a stripe; false positives of the Bloom filter.
PIECE, STRIDE, STRIPE_BYTES, FALSE_POSITIVES = 4096, 1000, 16 << 20, 0.01
END = 0
#: The reflected polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo CRC-32's, bits reflected."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


#: x to the 8 * 2^i.
_SHIFTS = [0x00800000]
for _ in range(63):
    _SHIFTS.append(_times(_SHIFTS[-1], _SHIFTS[-1]))


def crc_before(crc: int, n: int) -> int:
    """What a checksum adds to that of a text that goes on for n bytes: the checksums of all parts, so moved, combine by exclusive or."""
    i = 0
    while n:
        if n & 1:
            crc = _times(crc, _SHIFTS[i])
        n >>= 1
        i += 1
    return crc


def _encoded(paths: tuple[str, str, str], piece: int):
    """Pieces of the documents of a partition, in its order."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokenizer, part = tokenizer_of(*paths), TaskContext.get().partitionId()
        row = start = 0
        names = ["doc_id", "part", "doc_row", "part_start", "n_tokens", "piece", "ids"]
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1), read=lambda c: c):
                found, source, rows = [], [], []
                for i, ids in enumerate(tokenizer.encode_all(texts)):
                    ids = np.append(ids, np.uint32(END))
                    for k, at in enumerate(range(0, len(ids), piece)):
                        found.append(ids[at : at + piece])
                        source.append(a + i)
                        rows.append((row, start, len(ids), k))
                    row, start = row + 1, start + len(ids)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int32)))
                told = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source)), pa.array(np.full(len(rows), part, np.int32)), *[pa.array(c) for c in told.T], lists], names=names)

    return run


def _checked(batches: Iterator) -> Iterator:
    """The share of each piece in its document's checksum."""
    import pyarrow as pa

    for batch in batches:
        n, piece, size = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("n_tokens", "piece", "piece_ids"))
        lists = batch.column(batch.schema.get_field_index("ids"))
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        crcs = []
        for i in range(batch.num_rows):
            ids = values[offsets[i] : offsets[i + 1]]
            behind = int(n[i]) - int(piece[i]) * int(size[i]) - len(ids)
            crcs.append(crc_before(zlib.crc32(np.ascontiguousarray(ids, "<i4").tobytes()), 4 * behind))
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("part", "doc_row")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crcs, pa.int64())], names=["part", "doc_row", "crc"])


class TokenFiles:
    """ORC files of token ids under a path.

    ``write`` makes them; ``pieces`` are their rows; ``documents`` is a row per document with its start, length and
    checksum; ``tokens`` is its ids; ``lookup`` reads the pieces of some documents, skipping the stripes without them.
    """

    def __init__(self, spark: SparkSession, path: str, piece: int = PIECE):
        self._spark, self.path, self._piece = spark, path, piece

    @classmethod
    def write(cls, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str, str] | None = None, piece: int = PIECE, stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> TokenFiles:
        """tokenizer: paths of the vocabulary and its ranks, and the pattern that splits words. Files go to the shared folder if no path is given."""
        import public_tokenizers as files

        spark = docs.sparkSession
        path = path or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
        tokenizer = tokenizer or (files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN)
        order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("rid")]
        # The row number parts a key that very many rows share. Texts move once; ids are made where they are written.
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
        laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
        longs = [T.StructField(c, T.LongType()) for c in ("doc_row", "part_start", "n_tokens", "piece")]
        schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("part", T.IntegerType()), *longs, T.StructField("ids", T.ArrayType(T.IntegerType()))])
        options = {"compression": "zstd", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": stride, "orc.rows.between.memory.checks": min(stride, 5000), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES}
        laid.mapInArrow(_encoded(tokenizer, piece), schema).write.options(**options).orc(path)
        return cls(spark, path, piece)

    @property
    def pieces(self) -> DataFrame:
        return self._spark.read.orc(self.path)

    def _offsets(self) -> DataFrame:
        """part, part_offset: ids in the parts before. A part is a task's output, so there are few."""
        totals = self.pieces.where("piece = 0").groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
        offset, rows = 0, []
        for r in sorted(totals):
            rows.append((r.part, offset))
            offset += r.n
        return self._spark.createDataFrame(rows, "part int, part_offset long")

    @property
    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 of every document."""
        files = self.pieces
        shares = files.select("part", "doc_row", "n_tokens", "piece", F.lit(self._piece).alias("piece_ids"), "ids").mapInArrow(_checked, "part int, doc_row long, crc long")
        crcs = shares.groupBy("part", "doc_row").agg(F.bit_xor("crc").alias("ids_crc32"))
        heads = files.where("piece = 0").select("doc_id", "part", "doc_row", "part_start", "n_tokens")
        found = heads.join(crcs, ["part", "doc_row"]).join(F.broadcast(self._offsets()), "part")
        return found.select("doc_id", (F.col("part_offset") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")

    @property
    def tokens(self) -> DataFrame:
        """doc_id, start, ids of every piece: what a training job reads, stripe by stripe."""
        found = self.pieces.join(F.broadcast(self._offsets()), "part")
        return found.select("doc_id", (F.col("part_offset") + F.col("part_start") + F.col("piece") * self._piece).alias("start"), "ids")

    def lookup(self, *doc_ids) -> DataFrame:
        """The pieces of some documents, in order. The filter reaches the row indexes and Bloom filters."""
        return self.pieces.where(F.col("doc_id").isin(*doc_ids)).select("doc_id", "part", "doc_row", "piece", "ids")
