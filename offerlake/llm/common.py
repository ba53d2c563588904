"""What the training-data operators share: words, shared staging, bounded broadcasts."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII space characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: The largest table, in estimated bytes, that an operator hints to broadcast.
BROADCAST_BYTES = 48 << 20
#: Bytes that a broadcast id counts with, and the bits of a bitmap of ``bitmap_construct_agg``; there are 4,096 such bitmaps.
ID_BYTES, BITMAP_BITS = 40, 1 << 15
#: Cells that a step of a quantile splits the values into.
CELLS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it back: lineage ends, sizes are known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def drop(staged: DataFrame) -> None:
    """Deletes a table that ``stage`` wrote, once no job needs it any more."""
    spark = staged.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged.staged_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fits(rows: int, row_bytes: int) -> bool:
    """Whether so many rows may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """A broadcast hint if the counted rows fit in the bound; a plain (shuffled) side otherwise."""
    return F.broadcast(df) if fits(rows, row_bytes) else df


def with_ids(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose key is among the given ids (one column, distinct). Few ids are broadcast. Many are joined by key,
    after a bitmap of their hashes, of the same size for any number of them, has held back most other rows."""
    ids = ids.toDF("_id")
    if fits(ids.count(), ID_BYTES):
        return df.join(F.broadcast(ids), F.col(key) == F.col("_id"), "left_semi")
    return candidates(df, key, ids).join(ids.hint("merge"), F.col(key) == F.col("_id"), "left_semi")  # Spark may think many ids small


def candidates(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows with a key whose hash is that of an id: all those with the ids, and few others."""
    hashed = lambda c: F.xxhash64(F.col(c).cast("string"))
    part, place = (lambda c: F.shiftrightunsigned(hashed(c), 52)), (lambda c: hashed(c).bitwiseAND(F.lit(BITMAP_BITS - 1)))
    maps = ids.groupBy(part("_id").alias("_part")).agg(F.bitmap_construct_agg(place("_id")).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place(key), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, place(key).bitwiseAND(F.lit(7)).cast("int")) == 1
    return df.join(F.broadcast(maps), part(key) == F.col("_part")).where(held).drop("_part", "_bits")


def quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of a column of doubles of finite range, interpolated as by ``percentile``; None without any.

    The cell that holds the place is split until it holds one value, so that no task and no answer has more than
    CELLS + 1 of them, however many differ."""
    x = F.col(values.columns[0])
    figures = (F.count(x).alias("n"), F.min(x).alias("low"), F.max(x).alias("high"))
    n, low, high = values.agg(*figures).first()
    if not n:
        return None
    place = share * (n - 1)
    left = math.floor(place)
    while low < high:
        cell = F.floor((x - F.lit(low)) / F.lit(high - low) * CELLS)
        for found in sorted(values.where(x.between(low, high)).groupBy(cell).agg(*figures).collect(), key=lambda r: r.low):
            if left < found.n:
                break
            left -= found.n
        low, high = found.low, found.high
    upto, above = values.agg(F.count_if(x <= low), F.min(F.when(x > low, x))).first()
    first = math.floor(place)
    return low if place == first or upto > first + 1 else (first + 1 - place) * low + (place - first) * above


def sampled(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows with the lowest hashes of the keys. A cut-off from the count leaves little more than n rows
    in all partitions together, so the last step merges no more, however many partitions there are."""
    total, order = df.count(), F.xxhash64(*keys)
    if total > n:
        share = min(1.0, (n + 6 * math.sqrt(n) + 16) / total)
        df = df.where(order <= F.lit(int(share * ((1 << 64) - 1)) - (1 << 63)))
    return df.orderBy(order, *keys).limit(n)


def normalised(text: Column) -> Column:
    """Null as empty; every run of ASCII space characters as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words, without building them: runs of non-space become one letter."""
    return F.length(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "\u0001"), SPACES, "")).cast("long")


# --- words as numbers, in numpy ---------------------------------------------------------

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _POW)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return _LOWER[data]


def powers(n: int, base: np.uint64 = _POW) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of several texts: where they are in the joined bytes, whose they are, their hashes."""

    __slots__ = ("data", "doc", "end", "first", "hash", "start")

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        space = IS_SPACE[self.data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        self.start, self.end = edge[::2], edge[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        limits = np.cumsum(lengths)
        #: first[i] .. first[i + 1]: the words of text i.
        self.first = np.concatenate([[0], np.searchsorted(self.start, limits)])
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        size = self.end - self.start
        inside = np.flatnonzero(~space)
        offset = inside - np.repeat(self.start, size)
        terms = _BYTE[self.data[inside]] * powers(int(size.max()))[offset]
        self.hash = mix(np.add.reduceat(terms, np.concatenate([[0], np.cumsum(size)[:-1]])))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words, by first word, and which of them lie in one text."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        total = np.zeros(count, np.uint64)
        for weight, at in zip(powers(n), range(n), strict=True):
            total += self.hash[at : at + count] * weight
        return mix(total), self.doc[:count] == self.doc[n - 1 :]


def batches_of_sizes(sizes, limit: int):
    """Ranges of items whose sizes add up to about the limit."""
    start = total = i = 0
    for i, size in enumerate(sizes, 1):
        total += size
        if total >= limit:
            yield start, i
            start, total = i, 0
    if start < i:
        yield start, i


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_chunks(column, limit: int = 1 << 20, read=text_bytes):
    """Ranges of an Arrow string column, of about so many bytes each, with their texts: a batch is never all Python objects at once."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in batches_of_sizes(sizes, limit):
        yield a, b, read(column.slice(a, b - a))
    pa.default_memory_pool().release_unused()
