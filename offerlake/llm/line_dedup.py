"""Removal of repeated multi-line chunks with content-defined boundaries.

Each line has a hash; a rolling hash over three consecutive ones ends a chunk where it is divisible by
DIVISOR, so boundaries depend on nearby lines only and an insertion shifts none beyond it. Chunks of two
lines or more that repeat anywhere are compared byte by byte (they are grouped by their text) and removed,
but for the first: of the smallest id, the earliest in its document.

DataFrame functions only. Defined results: a null text is one empty line; null ids are the largest; rows
equal in id and text don't remove each other and get the same result. Chunks of blank lines stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

DIVISOR = 4
_LAST = (1 << 63) - 1


def line_hash(line: Column) -> Column:
    """32 bits of MD5, which any engine has."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_ends(hashes: Column) -> Column:
    """The indices of the lines that end a chunk."""
    at = lambda i: F.coalesce(F.get(hashes, i), F.lit(0).cast("long"))
    rolling = lambda i: at(i) + 3 * F.when(i >= 1, at(i - 1)).otherwise(0) + 9 * F.when(i >= 2, at(i - 2)).otherwise(0)
    last = F.size(hashes) - 1
    return F.filter(F.sequence(F.lit(0), last), lambda i: (rolling(i) % DIVISOR == 0) | (i == last))


class LineDedup:
    """``result``: doc_id, n_lines, n_chunks, n_removed_lines, kept_sha256, kept_text."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        text = F.coalesce(F.col(text_col), F.lit(""))
        keyed = docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("th"), F.col(id_col).alias("doc_id"), text.alias("text"))
        lined = keyed.withColumn("lines", F.split("text", "\n", -1)).withColumn("hashes", F.transform("lines", line_hash))
        cut = lined.withColumn("ends", chunk_ends(F.col("hashes"))).drop("hashes")
        start = lambda e, k: F.when(k > 0, F.get("ends", k - 1) + 1).otherwise(0)
        spans = F.transform("ends", lambda e, k: F.struct(start(e, k).alias("first"), (e - start(e, k) + 1).alias("n")))
        rows = cut.select("id", "th", "lines", F.explode(F.filter(spans, lambda s: s.n >= 2)).alias("span"))
        chunks = rows.select("id", "th", F.col("span.first").alias("first"), F.col("span.n").alias("n"), F.array_join(F.slice("lines", F.col("span.first") + 1, F.col("span.n")), "\n").alias("body"))
        chunks = chunks.where(F.col("body").rlike(r"[^\x20\x09-\x0D]")).withColumn("digest", F.md5("body"))
        # Grouping by the text compares the bytes; copies in a task are combined before they are sent.
        classes = chunks.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).where("copies > 1")
        classes = stage(classes.select("digest", F.sha2("body", 256).alias("sha"), "first_id"), "line-classes")
        hits = chunks.select("id", "th", "first", "n", "digest", F.sha2("body", 256).alias("sha")).join(classes, ["digest", "sha"]).dropDuplicates(["id", "th", "first"])
        order = F.row_number().over(Window.partitionBy("digest", "sha", "id", "th").orderBy("first"))
        removed = hits.withColumn("nth", order).where("id <> first_id or nth > 1")
        lines = removed.groupBy("id", "th").agg(F.flatten(F.collect_list(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).alias("gone"))
        joined = cut.join(lines, ["id", "th"], "left")
        stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
        kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
        told = joined.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("ends").cast("long").alias("n_chunks"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"), kept.alias("kept_text"))
        self.result = told.withColumn("kept_sha256", F.sha2("kept_text", 256))
