"""WARC archives with a Zstandard dictionary.

A dictionary is trained on a bounded sample of the records to be archived. Every archive starts with it, in
a skippable frame, and then holds each record as a frame of its own, so that a reader can start at any
record. An archive is the exact content of a .warc.zst file; archives are rows of bytes, which Spark writes
to and reads from any store. read_files() reads such files as they lie in a store.

Payloads that were archived before are revisit records. Defined results: a null page is an empty payload; a
null page_id is never the one that others refer to unless all are null; rows that repeat the largest id are
each a response. An empty table gives no archives. Payloads of any length are one record. Only page_id, url
and html are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sampled, stage

#: Of the .warc.zst format: the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Rows and bytes of each that train the dictionary, and its size.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16_384, 32_768
#: An archive closes beyond so many compressed bytes.
ARCHIVE_BYTES = 4 << 20
#: Payloads of at least so many bytes are archived once.
REVISIT_BYTES = 1000
LEVEL = 3
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace for URLs


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{digest.hex()}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(url.split()))
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard frame that starts here ends, by its header and block headers."""
    flags = data[at + 4]
    single, size_flag = flags >> 5 & 1, flags >> 6
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[size_flag]
    last = False
    while not last:
        block = int.from_bytes(data[pos : pos + 3], "little")
        last = bool(block & 1)
        pos += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    return pos + 4 * (flags >> 2 & 1)


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; none (empty) where they are too few to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def open_archive(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def iterate(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed by itself with the archive's own dictionary."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive must start with its dictionary")
    own = data[8 : 8 + size]
    tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own)) if own else zstandard.ZstdDecompressor()
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        yield tool.decompress(data[at:end])
        at = end


def with_revisits(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``refers_to`` and ``revisit``: groups of equal payloads are counted by digests first, so no page moves for that."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"), F.xxhash64(payload).alias("check"))
    large = keyed.where(F.octet_length("html") >= revisit_bytes)
    groups = large.groupBy("digest", "check").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    groups = stage(groups.select("digest", "check", "first_id", F.lit(True).alias("many")), "warc-groups")
    joined = keyed.join(groups, ["digest", "check"], "left")
    revisit = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """pages: page_id, url, html. Returns archive_id, n_records, archive (the bytes of a .warc.zst file)."""
    chosen = sampled(pages.select("page_id", "url", F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_BYTES).alias("html")), SAMPLE_ROWS, "page_id", "url")
    sample = sorted(chosen.collect(), key=lambda r: (str(r.page_id), r.url or "", r.html))
    dictionary = train([make_record(r.page_id, r.url, r.html.encode(), None, False, date) for r in sample])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
        tool = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **options) if dictionary else zstandard.ZstdCompressor(**options)
        frames, size = [], 0

        def close():
            nonlocal seq, frames, size
            row = pa.RecordBatch.from_arrays([pa.array([(part << 24) + seq]), pa.array([len(frames)]), pa.array([open_archive(dictionary) + b"".join(frames)], pa.binary())], names=["archive_id", "n_records", "archive"])
            seq, frames, size = seq + 1, [], 0
            return row

        for batch in batches:
            for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3), batch.column(4))), strict=True):
                frames.append(tool.compress(make_record(page_id, url, html, refers_to, revisit, date)))
                size += len(frames[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
        if frames:
            yield close()

    return with_revisits(pages, revisit_bytes).mapInArrow(run, "archive_id long, n_records long, archive binary")


def read_archives(archives: DataFrame, id_type: T.DataType | None = None) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest (checked where the payload is there), record_type, refers_to, payload."""
    id_type = id_type or T.LongType()

    def rows(data: bytes) -> Iterator[tuple]:
        for raw in iterate(data):
            fields, block = parse_record(raw)
            http, _, payload = block.partition(b"\r\n\r\n")
            size = int(http.rpartition(b"Content-Length: ")[2])
            digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
            whole = fields["WARC-Type"] == "response"
            if whole and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
            number = lambda k: int(fields[k]) if k in fields else None
            yield number("Page-ID"), fields.get("WARC-Target-URI"), size, digest, fields["WARC-Type"], number("Refers-To-Page-ID"), payload if whole else None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        ids = to_arrow_type(id_type)
        kinds = (ids, pa.string(), pa.int64(), pa.string(), pa.string(), ids, pa.binary())
        for batch in batches:
            for data in batch.column(0):
                found = list(rows(data.as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    schema = T.StructType([T.StructField("page_id", id_type), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", id_type), T.StructField("payload", T.BinaryType())])
    return archives.select("archive").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, id_type: T.DataType | None = None) -> DataFrame:
    """The records of .warc.zst files anywhere that Spark reads; a file is a row, so files should be of bounded size, as written here."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("content").alias("archive")), id_type)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Archives the pages in the shared folder and reads the archives back."""
    kept = stage(write_archives(pages.select("page_id", "url", "html")), "warc-archives")
    return read_archives(kept, pages.schema["page_id"].dataType)
