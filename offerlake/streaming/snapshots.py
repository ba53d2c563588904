"""Collection snapshots as a stream: each micro-batch is merged into the state of what was seen where and when.

The state is a bucketed store: a batch rewrites the buckets of its keys as a version named after the batch, so a batch
that is run again changes nothing, and a reader never sees half a state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_path
from .store import BucketedStore


def snapshot_stream(snapshots: DataFrame, files: int = 4) -> DataFrame:
    """A table's rows as a stream of several micro-batches."""
    spark, path = snapshots.sparkSession, shared_path(snapshots.sparkSession, "snapshots")
    snapshots.repartition(files).write.parquet(path)
    return spark.readStream.schema(snapshots.schema).option("maxFilesPerTrigger", 1).parquet(path)


def merged_state(stream: DataFrame, keys: list[str], run: str = "batch_no") -> DataFrame:
    """Per key: the first and the last run that saw it, and in how many rows; the order of the batches doesn't matter."""
    spark: SparkSession = stream.sparkSession
    fields = [T.StructField(k, stream.schema[k].dataType) for k in keys]
    fields += [T.StructField("first_batch", stream.schema[run].dataType), T.StructField("last_batch", stream.schema[run].dataType), T.StructField("times", T.LongType())]
    store = BucketedStore(spark, shared_path(spark, "snapshot-state"), keys, T.StructType(fields))

    def merge(batch: DataFrame, batch_id: int) -> None:
        found = batch.groupBy(*keys).agg(F.min(run).alias("first_batch"), F.max(run).alias("last_batch"), F.count(F.lit(1)).alias("times"))
        touched = store.touched(batch)
        both = found.unionByName(store.read(batch_id - 1, touched))
        store.commit(batch_id, both.groupBy(*keys).agg(F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch"), F.sum("times").alias("times")), touched)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", shared_path(spark, "snapshot-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read()
