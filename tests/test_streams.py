"""Streams that are late, stopped, resumed and replayed, against literal cases and the batch operators."""

import datetime
import glob
import os
import random
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from offerlake.operators import runs as R
from offerlake.plans.replays import _merged
from offerlake.sources.bindings import Views
from offerlake.streaming import events as E
from offerlake.streaming import membership as M
from offerlake.streaming.runs import MEMBERS, RunState, merge_runs
from offerlake.streaming.store import BucketedStore

DAY = datetime.datetime(2024, 1, 1)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def at(hours, minutes=0):
    return DAY + datetime.timedelta(hours=hours, minutes=minutes)


class Arrivals:
    """A folder that rows arrive in, and a drained stream over it."""

    def __init__(self, spark, schema, build, rocks=False):
        self.spark, self.schema, self.build, self.rocks = spark, schema, build, rocks
        self.path, self.drain = folder() + "/in", E.Drain.new(spark, "test")

    def __call__(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)
        # A new query each time: what it knows comes from the checkpoint.
        stream = self.build(self.spark.readStream.schema(self.schema).parquet(self.path))
        if self.rocks:
            with E.rocks_state(self.spark):
                return [tuple(r) for r in self.drain.run(stream).collect()]
        return [tuple(r) for r in self.drain.run(stream).collect()]


CLICKS = "event_id long, user_id long, ts timestamp"


def test_windows_take_rows_before_the_watermark_and_drop_those_behind(spark):
    arrive = Arrivals(spark, CLICKS, lambda s: E.windowed_counts(s, ["user_id"], "1 hour", delay="2 hours"))
    assert arrive([(1, 7, at(0, 10)), (2, 7, at(0, 50)), (3, 7, at(3, 30))]) == [(7, at(0), 2)]  # the watermark is 1:30
    # 0:20 lies in a window that is out; 1:10 does not, though it is behind the watermark itself.
    found = arrive([(4, 7, at(0, 20)), (5, 7, at(1, 10)), (6, 7, at(9))])
    assert sorted(found) == [(7, at(0), 2), (7, at(1), 1), (7, at(3), 1)]
    assert arrive.drain.dropped == 1
    assert sorted(arrive([(7, 8, at(20))])) == [(7, at(0), 2), (7, at(1), 1), (7, at(3), 1), (7, at(9), 1)]  # counted once each


def test_sliding_windows_and_searches_resume_without_double_counts(spark):
    arrive = Arrivals(spark, "k string, ts timestamp", lambda s: E.windowed_counts(s, ["k"], "2 hours", "1 hour", delay="1 hour"))
    arrive([("a", at(0, 30)), ("a", at(1, 30))])
    found = arrive([("a", at(1, 40)), ("b", at(8))])
    assert sorted(found) == [("a", at(-1), 1), ("a", at(0), 3), ("a", at(1), 2)]


def test_sessions_go_on_over_a_restart_and_drop_what_is_late(spark):
    arrive = Arrivals(spark, "user_id long, ts timestamp", lambda s: E.session_counts(s, "user_id", "1 hour", delay="2 hours"))
    assert arrive([(1, at(0)), (1, at(0, 30))]) == []
    assert arrive([(1, at(1, 10)), (2, at(6))]) == [(1, at(0), 3)]  # one session over the stop
    assert sorted(arrive([(1, at(2)), (2, at(6, 20)), (3, at(12))])) == [(1, at(0), 3), (2, at(6), 2)]  # 2:00 + 1:00 is behind 4:00
    assert arrive.drain.dropped == 1


def test_first_rows_come_whole_and_are_forgotten_after_the_delay(spark):
    build = lambda s: E.first_rows_within(s, ["user_id"], "2 hours", 2 * 3_600_000)
    arrive = Arrivals(spark, CLICKS, build, rocks=True)
    assert sorted(arrive([(9, 1, at(1)), (5, 1, at(0, 30)), (6, 1, at(0, 30)), (7, 2, at(2))])) == [(5, 1, at(0, 30)), (7, 2, at(2))]
    found = arrive([(1, 1, at(0, 10)), (2, 2, at(3)), (3, 3, at(6))])  # 1 and 2 are known still
    assert sorted(found) == [(3, 3, at(6)), (5, 1, at(0, 30)), (7, 2, at(2))]
    found = arrive([(11, 1, at(7)), (12, 3, at(6, 30)), (13, 4, at(3, 30))])  # 1 was forgotten; 3:30 is behind the watermark of 4:00
    assert sorted(found) == [(3, 3, at(6)), (5, 1, at(0, 30)), (7, 2, at(2)), (11, 1, at(7))]


RUN = "source_id string, shard int, run_no int, counts boolean, external_item_id string"


def headed(spark, *runs):
    """Rows of runs: (run, counts, items)."""
    items = [("s", run, x) for run, _, found in runs for x in found]
    observed = spark.createDataFrame(items or [], "source_id string, run_no int, external_item_id string")
    heads = spark.createDataFrame([("s", run, counts) for run, counts, _ in runs], "source_id string, run_no int, counts boolean")
    return [tuple(r) for r in M.with_headers(observed, heads).collect()]


def test_presence_counts_misses_over_restarts_and_passes_over_repeated_runs(spark):
    arrive = Arrivals(spark, RUN, M.presence_changes, rocks=True)

    def state(*runs):
        changes = spark.createDataFrame(arrive(headed(spark, *runs)), M.CHANGES)
        return {r.external_item_id: (r.last_run, r.missed, r.is_active) for r in M.latest_presence(changes).collect()}

    assert state((1, True, "abc")) == {x: (1, 0, True) for x in "abc"}
    assert state((2, True, "a")) == {"a": (2, 0, True), "b": (1, 1, True), "c": (1, 1, True)}
    assert state((1, True, "abc"), (2, True, "a"))["b"] == (1, 1, True)  # both came before
    assert state((3, False, "b")) == {"a": (2, 0, True), "b": (3, 0, True), "c": (1, 1, True)}  # a run that doesn't count
    assert state((4, True, ""), (5, True, "d")) == {"a": (2, 2, False), "b": (3, 2, False), "c": (1, 2, False), "d": (5, 0, True)}
    assert state((6, True, "c"))["c"] == (6, 0, True)  # it comes back


ITEM = "item_id string, source_id long, external_id string, title string, brand string, image string, content_hash string, price double, original_price double, discount int, free_shipping boolean, promotion_type string, url string, position long, run_no int"


def items_of(run, keys, **changed):
    base = {"title": "Nike Revolution 7 Preto", "brand": "Nike", "image": "https://i.test/1.jpg", "price": 10.0, "original_price": 20.0, "discount": 50, "free_shipping": True, "promotion_type": "general", "url": "https://x.test/p"} | changed
    return [(f"{run}-{k}", 1 + i % 2, f"E{k}", *(base[c] for c in ("title", "brand", "image")), f"h{k}", *(base[c] for c in ("price", "original_price", "discount", "free_shipping", "promotion_type", "url")), i, run) for i, k in enumerate(keys)]


@pytest.fixture(scope="module")
def runs():
    return [items_of(1, range(12)), items_of(2, range(4), promotion_type="lightning") + items_of(2, [99], price=None), items_of(3, range(2, 14))]


def test_runs_equal_the_batch_operators_and_replays_change_nothing(spark, runs):
    root, path, checkpoint = folder(), folder() + "/in", folder()
    state = RunState(spark, root, buckets=4, least_items=2)

    def arrive(rows, checkpoint=checkpoint):
        spark.createDataFrame(rows, ITEM).coalesce(1).write.mode("append").parquet(path)
        merge_runs(spark.readStream.schema(ITEM).parquet(path), state, checkpoint)

    want = spark.createDataFrame([], MEMBERS)
    for run, rows in enumerate(runs, 1):
        arrive(rows)
        items = spark.createDataFrame(rows, ITEM).where("price > 0")
        counted = items.groupBy("source_id").count().where("count >= 2")
        want = R.with_misses(R.upserted_memberships(want, items, f"r{run}"), f"r{run}", counted).select(*MEMBERS.names)
        assert sorted(map(tuple, state.members.read().collect())) == sorted(map(tuple, want.collect()))
    metrics = {r.run_no: r for r in state.metrics.collect()}
    assert [(m.raw, m.parsed, m.new, m.auto_approved, m.errors, m.status) for m in map(metrics.get, (1, 2, 3))] == [(12, 12, 12, 12, 0, "completed"), (5, 4, 0, 0, 1, "completed"), (12, 12, 2, 2, 0, "completed")]
    assert [metrics[i].deactivated for i in (1, 2, 3)] == [0, 0, 0]
    known = {r.content_hash: r for r in state.known.read().collect()}
    assert known["h0"].promotion_type == "lightning" and known["h2"].promotion_type == "general" and known["h13"].first_run == 3
    before = sorted(glob.glob(f"{root}/*/data/**/*.parquet", recursive=True))
    merge_runs(spark.readStream.schema(ITEM).parquet(path), state, folder())  # a checkpoint that was lost: every run comes again
    assert sorted(glob.glob(f"{root}/*/data/**/*.parquet", recursive=True)) == before
    arrive(items_of(4, [0]))
    arrive(items_of(5, [0]))
    assert {r.external_item_id for r in state.members.read().where("not is_active").collect()} == set()  # runs of one item count no misses
    arrive(items_of(6, [0, 1, 2, 3]))
    arrive(items_of(7, [0, 1, 2, 3]))
    assert {r.run_no: r.deactivated for r in state.metrics.collect()}[7] == 10


def test_a_commit_writes_the_buckets_that_it_touches(spark):
    store = BucketedStore(spark, folder(), ["k"], spark.range(0).selectExpr("id k", "id v").schema, buckets=16)
    rows = lambda low, high, v: spark.range(low, high).selectExpr("id k", f"id * 0 + {v} v")
    first = rows(0, 1000, 1)
    assert store.commit(0, first, store.touched(first)) and not store.commit(0, rows(0, 1, 9), [0])
    change = rows(5, 6, 2)
    touched = store.touched(change)
    assert len(touched) == 1
    kept = store.read(0, touched).join(change.select("k"), "k", "left_anti")
    assert store.commit(1, kept.unionByName(change), touched)
    assert os.listdir(f"{store.root}/data/v1") and [n for n in os.listdir(f"{store.root}/data/v1") if n.startswith("_bucket")] == [f"_bucket={touched[0]}"]
    assert store.read().groupBy("v").count().orderBy("v").collect() == [(1, 999), (2, 1)]
    assert store.read(0).where("v = 2").count() == 0 and store.versions() == [0, 1]
    assert store.commit(2, spark.createDataFrame([], store.schema), touched)  # a bucket may empty
    assert store.read().where(F.col("k") == 5).count() == 0 and store.read().count() > 900


def test_a_store_forgets_what_only_older_versions_name(spark):
    store = BucketedStore(spark, folder(), ["k"], spark.range(0).selectExpr("id k", "id v").schema, buckets=4)
    rows = lambda v: spark.range(100).selectExpr("id k", f"id * 0 + {v} v", "id + 1000 extra").where(store.bucket().isin(*range(v, 4)))
    for v in range(3):
        store.commit(v, rows(v), range(v, 4), beside=["extra"])
    assert store.written(2, "k long, extra long").where("extra = k + 1000").count() == rows(2).count()
    before = sorted(map(tuple, store.read().collect()))
    store.forget(2)
    assert store.versions() == [2] and sorted(map(tuple, store.read().collect())) == before and len(before) == 100
    assert {n: len(glob.glob(f"{store.root}/data/{n}/_bucket=*")) for n in os.listdir(f"{store.root}/data")} == {"v0": 1, "v1": 1, "v2": 2}
    store.commit(3, rows(0), range(4))
    store.forget(3)
    assert os.listdir(f"{store.root}/data") == ["v3"] and store.read(3).count() == 100


def shuffled(but=()):
    """Bytes of the shuffle files that are there, by path."""
    return {f: os.path.getsize(f) for f in glob.glob("/tmp/blockmgr-*/*/shuffle_*") if f not in but and os.path.exists(f)}


def test_routes_leave_only_the_last_state_on_disk(spark):
    before = shuffled()
    state = _merged(Views(spark, "/root/testdata/sf0.001"), routes_only=True)
    assert state.known.read().count() > 2000
    root = state.root.removeprefix("file://")
    assert sorted(os.listdir(root)) == ["ids", "known"]  # memberships are no part of the routes
    for name in ("ids", "known"):
        assert os.listdir(f"{root}/{name}/data") == ["v3"] and [n for n in os.listdir(f"{root}/{name}/manifest") if not n.startswith(".")] == ["v3.json"]
    last = max(glob.glob(f"{os.path.dirname(root)}/run-files-*"), key=os.path.getmtime)
    assert not glob.glob(f"{last}/**/*.parquet", recursive=True)  # merged runs are not kept
    for _ in range(50):  # files are deleted in the background
        if sum(shuffled(before).values()) < 10_000:
            break
        time.sleep(0.2)
    assert sum(shuffled(before).values()) < 10_000  # numbers of buckets; a run's items take more


def routes_by_hand(runs):
    """(promotion, shipping, route, first run) of each hash, item by item."""
    known, taken = {}, set()
    for run, rows in enumerate(runs, 1):
        items = sorted((r for r in rows if r[7] is not None and r[7] > 0), key=lambda r: (r[13], r[0]))
        first = {}
        for r in items:
            if (known.get(r[6]) or [None] * 3)[2] is None and r[2] not in taken:
                first.setdefault(r[6], r)
        for r in items:
            old = known.get(r[6])
            known[r[6]] = [r[11], r[10], old[2] if old else None, old[3] if old else run]
        for key, r in first.items():
            known[key][2] = "published" if r[3].startswith("Nike") and r[9] >= 30 else "pending"
        taken |= {r[2] for r in first.values() if r[2] is not None}
    return {k: tuple(v) for k, v in known.items()}


@pytest.mark.parametrize("routes_only", [True, False])
def test_routes_equal_those_made_item_by_item(spark, routes_only):
    draw = random.Random(5)
    one = lambda run, n: (
        f"{run}-{n}", n % 3, draw.choice([None, *(f"E{i}" for i in range(25))]), draw.choice(["Nike Revolution 7 Preto", "Sandalia sem marca"]), "Nike" if n % 2 else None, "https://i.test/1.jpg", f"h{draw.randrange(60)}",
        draw.choice([None, 0.0, 9.0, 10.0, 12.0]), 20.0, draw.choice([10, 30, 50]), draw.random() < 0.5, draw.choice(["general", "lightning"]), "https://x.test/p", draw.randrange(9), run,
    )
    runs = [[one(run, n) for n in range(60)] for run in (1, 2, 3)]
    runs = [[(*r[:4], "Nike" if r[3].startswith("Nike") else None, *r[5:]) for r in rows] for rows in runs]
    state, path, checkpoint = RunState(spark, folder(), buckets=4, routes_only=routes_only, history=False), folder(), folder()
    for run, rows in enumerate(runs, 1):
        spark.createDataFrame(rows, ITEM).write.parquet(f"{path}/r{run}")
        merge_runs(spark.readStream.schema(ITEM).parquet(f"{path}/*"), state, checkpoint)
        found = {r.content_hash: (r.promotion_type, r.free_shipping, r.route, r.first_run) for r in state.known.read().collect()}
        assert found == routes_by_hand(runs[:run])
    assert {r[2] for r in found.values()} == {"published", "pending", None}


def test_routes_of_a_run_that_stopped_between_its_stores_go_on(spark, runs):
    root, path, checkpoint = folder(), folder(), folder()
    state = RunState(spark, root, buckets=4, routes_only=True, history=False)
    commit, state.ids.commit = state.ids.commit, None  # the first try stops when the known items are committed
    spark.createDataFrame(runs[0], ITEM).write.parquet(f"{path}/r1")
    stream = lambda: spark.readStream.schema(ITEM).parquet(f"{path}/*")
    with pytest.raises(Exception):  # noqa: B017
        merge_runs(stream(), state, checkpoint)
    assert state.known.versions() == [1] and state.ids.versions() == []
    state.ids.commit = commit
    merge_runs(stream(), state, checkpoint)
    assert {r.external_id for r in state.ids.read().collect()} == {f"E{k}" for k in range(12)} and state.known.read().where("route = 'published'").count() == 12
