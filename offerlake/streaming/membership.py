"""Who is present where, as keyed state inside a stream: misses are counted when a run comes without an item.

A key is a source and one of its shards, since a miss is the absence of a row and only the source's runs tell it; shards
keep a source with very many items from being one task's. A run's header goes to every shard. State is the last
run and a map of items; a run that came before is passed over, so a stream may bring runs twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MISSES, SHARDS = 2, 4
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
CHANGES = "source_id string, external_item_id string, run_no int, last_run int, missed int, is_active boolean"


class Presence(StatefulProcessor):
    """A run makes its items active and unmissed; one that counts adds a miss to the active others, which go at MISSES."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_run", "run_no int")
        self.items = handle.getMapState("items", "external_item_id string", "last_run int, missed int, is_active boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        last = self.last.get()[0] if self.last.exists() else -1
        out = []
        for run_no, run in batch[batch.run_no > last].sort_values("run_no", kind="stable").groupby("run_no"):
            seen = set(run.external_item_id.dropna())
            if bool(run.counts.max()):
                missing = [(item[0], v) for item, v in self.items.iterator() if item[0] not in seen and v[2]]
                for item, (at, missed, _) in missing:
                    now = (int(at), int(missed) + 1, int(missed) + 1 < MISSES)
                    self.items.updateValue((item,), now)
                    out.append((str(key[0]), item, int(run_no), *now))
            for item in sorted(seen):
                self.items.updateValue((item,), (int(run_no), 0, True))
                out.append((str(key[0]), item, int(run_no), int(run_no), 0, True))
            last = int(run_no)
        self.last.update((last,))
        yield pd.DataFrame(out, columns=["source_id", "external_item_id", "run_no", "last_run", "missed", "is_active"])

    def close(self) -> None:
        pass


@contextmanager
def rocks_state(spark: SparkSession):
    """State stores that hold maps and timers, for the queries started within."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def with_headers(observations: DataFrame, runs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source_id, shard, run_no, counts, external_item_id: the items of runs, and a row without an item per run and shard."""
    shard = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int").alias("shard")
    items = observations.select(F.col("source_id").cast("string"), shard("external_item_id"), "run_no", F.lit(False).alias("counts"), F.col("external_item_id").cast("string"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    return items.unionByName(runs.select(F.col("source_id").cast("string"), every, "run_no", "counts", F.lit(None).cast("string").alias("external_item_id")))


def presence_changes(stream: DataFrame) -> DataFrame:
    """A row per item and run that changed it, from rows of ``with_headers``."""
    return stream.groupBy("source_id", "shard").transformWithStateInPandas(Presence(), CHANGES, "append", "None")


def latest_presence(changes: DataFrame) -> DataFrame:
    """What the changes leave."""
    last = F.max_by(F.struct("last_run", "missed", "is_active"), "run_no").alias("now")
    return changes.groupBy("source_id", "external_item_id").agg(last).select("source_id", "external_item_id", "now.*")
