"""Collection runs as micro-batches: memberships, known items and routes are merged into bucketed stores, run by run.

Memberships lie in buckets by source, so a run reads and rewrites those of its sources only; what is known of an item
lies in buckets by its content's hash, routed external ids in buckets by the id. A store's version is the run's
number: a run that comes again, in the same batch id or in another, changes nothing, and so does one older than the
last. A run reads the versions before its own, so one that stopped between two stores runs again alike.

A run's figures are observed while its stores are written, so no scan is made for them. Items are judged where they are
read, and rows are shuffled with what the stores need of them; shuffle files go with their job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import runs as R
from ..sources.shared import freed_shuffles
from .store import BucketedStore


def _schema(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split(", "):
        out.add(*part.split(" "))
    return out


MEMBERS = _schema("id string, source_id long, external_item_id string, content_hash string, raw_title string, is_active boolean, last_batch string, missed integer")
KNOWN = _schema("content_hash string, promotion_type string, free_shipping boolean, route string, first_run integer")
ROUTED_IDS = _schema("external_id string")
METRICS = "run_no int, raw long, parsed long, collected long, new long, auto_approved long, deactivated long, errors long, status string"
#: A run with fewer items of a source counts no misses there.
LEAST_ITEMS = 30


def parsed() -> Column:
    """Whether a card gave an item: named and priced."""
    return F.coalesce((F.col("price") > 0) & (F.trim("title") != ""), F.lit(False))


@dataclass
class RunState:
    """The stores under a root, and what a run makes of them. With ``routes_only`` memberships and figures are left out;
    without ``history`` the versions before the last run go."""

    spark: SparkSession
    root: str
    buckets: int = 32
    least_items: int = LEAST_ITEMS
    routes_only: bool = False
    history: bool = True

    def __post_init__(self) -> None:
        self.members = BucketedStore(self.spark, f"{self.root}/members", ["source_id"], MEMBERS, self.buckets)
        self.known = BucketedStore(self.spark, f"{self.root}/known", ["content_hash"], KNOWN, self.buckets)
        self.ids = BucketedStore(self.spark, f"{self.root}/ids", ["external_id"], ROUTED_IDS, self.buckets)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merges a micro-batch, its runs one after the other."""
        for run in sorted(r[0] for r in batch.select("run_no").distinct().collect()):  # a batch holds few runs
            self.apply_run(batch.where(F.col("run_no") == run), run)

    def apply_run(self, items: DataFrame, run: int) -> None:
        done = self.ids.versions()  # the store that is committed last says that all are
        if done and run <= done[-1]:
            return
        good = items.where(parsed())
        of = lambda store, where: F.collect_set(F.when(where, store.bucket()))
        named = parsed() & F.col("external_id").isNotNull()
        by_source, by_hash, by_id = items.agg(of(self.members, F.lit(True)), of(self.known, parsed()), of(self.ids, named)).first()  # numbers of buckets
        known, ids = self.known.read(run - 1, by_hash), self.ids.read(run - 1, by_id)
        known = self._routed(known, ids, good, run)
        if self.routes_only:
            self.known.commit(run, known, by_hash, beside=["routed_id"])
        else:
            self._measured(items, self._seen(self.members.read(run - 1, by_source), good, f"r{run}"), by_source, known, by_hash, run)
        new_ids = self.known.written(run, "routed_id string").select(F.col("routed_id").alias("external_id")).where("external_id is not null")
        self.ids.commit(run, ids.unionByName(new_ids).distinct(), by_id)
        if not self.history:
            for store in (self.members, self.known, self.ids):
                store.forget(run)

    def _measured(self, items: DataFrame, members: DataFrame, by_source: list[int], known: DataFrame, by_hash: list[int], run: int) -> None:
        """Commits memberships and known items, and writes the run's figures."""
        seen, merged, routes = Observation(), Observation(), Observation()
        self.members.commit(run, members.observe(merged, F.count_if("left").alias("deactivated"), F.count_if(F.col("last_batch") == f"r{run}").alias("collected")), by_source)
        fresh = F.col("new_route").isNotNull()
        self.known.commit(run, known.observe(routes, F.count_if(fresh).alias("new"), F.count_if(fresh & (F.col("new_route") == "published")).alias("auto_approved")), by_hash, beside=["routed_id"])
        counted = items.select(parsed().alias("parsed")).observe(seen, F.count(F.lit(1)).alias("raw"), F.count_if("parsed").alias("parsed"))
        counted.write.format("noop").mode("overwrite").save()  # the batch alone, no state
        found = {**seen.get, **merged.get, **routes.get}
        row = (run, found["raw"], found["parsed"], found["collected"], found["new"], found["auto_approved"], found["deactivated"], found["raw"] - found["parsed"], "completed" if found["parsed"] else "failed")
        self.spark.createDataFrame([row], METRICS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/metrics/r{run}")

    @property
    def metrics(self) -> DataFrame:
        """A row per run."""
        return self.spark.read.schema(METRICS).parquet(f"{self.root}/metrics/r*")

    def _seen(self, members: DataFrame, items: DataFrame, run: str) -> DataFrame:
        counted = items.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.least_items)
        return R.with_misses(R.upserted_memberships(members, items, run), run, counted)

    def _routed(self, known: DataFrame, ids: DataFrame, items: DataFrame, run: int) -> DataFrame:
        """Items of known hashes refresh them, others are new; what was never routed, by hash or id, is.
        ``new_route`` and ``routed_id`` tell the route that a hash gets in this run, and the external id it came with."""
        judged, _, _, passes = R.judged(items)
        order = ["position", "item_id"]
        rows = judged.select("content_hash", "external_id", *order, "promotion_type", "free_shipping", F.coalesce(passes, F.lit(False)).alias("passes"))
        named = rows.where("external_id is not null").join(ids.withColumn("_taken", F.lit(True)), "external_id", "left")
        rows = named.unionByName(rows.where("external_id is null"), allowMissingColumns=True)
        came = rows.groupBy("content_hash").agg(
            F.max(F.struct(*order, F.col("promotion_type").alias("promotion"), F.col("free_shipping").alias("free"))).alias("last"),
            F.min(F.when(F.col("_taken").isNull(), F.struct(*order, "passes", "external_id"))).alias("first"),
        )
        fresh = F.col("route").isNull() & F.col("first").isNotNull()
        after = known.join(came, "content_hash", "full").withColumn("new_route", F.when(fresh & F.col("content_hash").isNotNull(), F.when(F.col("first.passes"), "published").otherwise("pending")))
        return after.select(
            "content_hash", F.coalesce("last.promotion", "promotion_type").alias("promotion_type"), F.coalesce("last.free", "free_shipping").alias("free_shipping"),
            F.coalesce("route", "new_route").alias("route"), F.coalesce("first_run", F.lit(run)).alias("first_run"), "new_route", F.when(fresh, F.col("first.external_id")).alias("routed_id"),
        )


def merge_runs(stream: DataFrame, state: RunState, checkpoint: str) -> None:
    """All runs that are there now, from where the checkpoint stands."""
    with freed_shuffles(state.spark):
        query = stream.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
