"""Event streams: windowed counts, sessions, first rows. State is bounded by the watermark.

A stream is drained to a table: all that is there now comes through, and what comes later continues from the same
checkpoint, with the watermark and the state where they stood. A replay brings slices of a table one after the other
through such a resumed stream, so rows that arrive behind the watermark are dropped as they would be live.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.shared import shared_path
from .membership import rocks_state


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The events under a path as a stream; ``path`` is a pattern of files or folders."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, keys: list[str], length: str, slide: str | None = None, delay: str = "2 hours") -> DataFrame:
    """Events per key and window; a window comes out once the watermark has passed its end, later rows are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = stream.withWatermark("ts", delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def session_counts(stream: DataFrame, key: str, gap: str, delay: str = "2 hours") -> DataFrame:
    """Events per key and session; a session ends when nothing came for the gap."""
    counts = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


def first_within(stream: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark passes it by the delay."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


class FirstRow(StatefulProcessor):
    """Passes on the first row of a key, by time and then by the tie, and forgets the key when the watermark passes it by the delay."""

    def __init__(self, time: str, tie: str, delay_ms: int):
        self._time, self._tie, self._delay = time, tie, delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.known = handle, handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:
            first = part.sort_values([self._time, self._tie], kind="stable").head(1)
            best = first if best is None else pd.concat([best, first]).sort_values([self._time, self._tie], kind="stable").head(1)
        if best is None or self.known.exists():
            return
        at = int(best[self._time].iloc[0].timestamp() * 1000)
        if at <= timerValues.getCurrentWatermarkInMs():
            return  # behind the watermark: its key may be forgotten
        self.known.update((at + self._delay,))
        self.handle.registerTimer(at + self._delay)
        yield best

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_rows_within(stream: DataFrame, keys: list[str], delay: str, delay_ms: int, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The first row of each key, whole; of one micro-batch's rows that with the smallest time and tie. A key is forgotten after the delay."""
    rows = stream.withWatermark(time, delay)
    return rows.groupBy(*keys).transformWithStateInPandas(FirstRow(time, tie, delay_ms), T.StructType(stream.schema.fields), "append", "EventTime")


@dataclass
class Drain:
    """A stream's sink and checkpoint; the same ones again continue it. ``dropped`` adds up what the queries' progress says of rows
    behind the watermark, counted after partial aggregation."""

    spark: SparkSession
    out: str
    checkpoint: str
    dropped: int = 0
    batches: list[int] = field(default_factory=list)

    @classmethod
    def new(cls, spark: SparkSession, name: str, checkpoint: str | None = None) -> Drain:
        return cls(spark, shared_path(spark, name), checkpoint or shared_path(spark, f"{name}-state"))

    def run(self, stream: DataFrame) -> DataFrame:
        """All that is there now; returns the table so far."""
        query = stream.writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        for progress in query.recentProgress:
            self.batches.append(progress["batchId"])
            self.dropped += sum(s["numRowsDroppedByWatermark"] for s in progress["stateOperators"])
        return self.spark.read.schema(stream.schema).parquet(self.out)


def drained(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataFrame:
    """All that is there now, through the stream to a table. The checkpoint makes each batch count once."""
    return Drain.new(stream.sparkSession, name, checkpoint).run(stream)


def replayed(rows: DataFrame, slice_col: str, build: Callable[[DataFrame], DataFrame], drain: Drain, rocks: bool = False) -> DataFrame:
    """Brings a table slice by slice, each a batch of its own, through a stream that stops and resumes in between."""
    spark = rows.sparkSession
    staged, arrived = shared_path(spark, "slices"), shared_path(spark, "arrived")
    rows.write.partitionBy(slice_col).parquet(staged)
    schema = T.StructType([f for f in rows.schema if f.name != slice_col])
    slices = sorted(r[0] for r in spark.read.parquet(staged).select(slice_col).distinct().collect())
    out = None
    for one in slices:
        spark.read.schema(schema).parquet(f"{staged}/{slice_col}={one}").write.mode("append").parquet(arrived)
        stream = build(spark.readStream.schema(schema).parquet(arrived))
        if rocks:
            with rocks_state(spark):
                out = drain.run(stream)
        else:
            out = drain.run(stream)
    return spark.createDataFrame([], build(rows.drop(slice_col)).schema) if out is None else out
