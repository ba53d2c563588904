"""Queries of streams that stop and resume: collection runs as batches, keyed presence, and events that arrive late."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators.catalog import first_rows
from ..registry import query
from ..sources.shared import delete, freed_shuffles, shared_path
from ..streaming import events as E
from ..streaming import membership as M
from ..streaming.runs import RunState, merge_runs
from .runs import _ROUTED

RUNS = 3


def _each_run(text: str) -> str:
    return ",".join(text.format(r=r, p=r - 1) for r in range(1, RUNS + 1))


_NO_MEMBERS = "m0 AS (SELECT NULL::VARCHAR AS id, NULL::BIGINT AS source_id, NULL::VARCHAR AS external_item_id, NULL::VARCHAR AS content_hash, NULL::VARCHAR AS raw_title, true AS is_active, NULL::VARCHAR AS last_batch, 0 AS missed WHERE false)"
_MEMBERS = _each_run("""
    i{r} AS MATERIALIZED (SELECT * FROM v_run_items WHERE run_no = {r} AND price > 0),
    ext{r} AS (SELECT source_id, external_item_id, min(id) AS member FROM m{p} WHERE external_item_id IS NOT NULL GROUP BY ALL),
    hsh{r} AS (SELECT source_id, content_hash, min(id) AS member FROM m{p} GROUP BY ALL),
    met{r} AS MATERIALIZED (SELECT i.*, CASE WHEN i.external_id IS NULL THEN h.member ELSE e.member END AS member, coalesce('e:' || i.external_id, 'h:' || i.content_hash) AS item_key FROM i{r} i
            LEFT JOIN ext{r} e ON e.source_id = i.source_id AND e.external_item_id = i.external_id LEFT JOIN hsh{r} h ON h.source_id = i.source_id AND h.content_hash = i.content_hash),
    seen{r} AS (SELECT DISTINCT ON (member) * FROM met{r} WHERE member IS NOT NULL ORDER BY member, position DESC, item_id DESC),
    new{r} AS (SELECT DISTINCT ON (source_id, item_key) * FROM met{r} WHERE member IS NULL ORDER BY source_id, item_key, position DESC, item_id DESC),
    ups{r} AS (SELECT m.id, m.source_id, m.external_item_id, coalesce(s.content_hash, m.content_hash) AS content_hash, coalesce(s.title, m.raw_title) AS raw_title, s.member IS NOT NULL OR m.is_active AS is_active,
               CASE WHEN s.member IS NOT NULL THEN 'r{r}' ELSE m.last_batch END AS last_batch, CASE WHEN s.member IS NOT NULL THEN 0 ELSE m.missed END AS missed FROM m{p} m LEFT JOIN seen{r} s ON s.member = m.id
             UNION ALL SELECT 'new-' || source_id || '-' || item_key, source_id, external_id, content_hash, title, true, 'r{r}', 0 FROM new{r}),
    cnt{r} AS (SELECT source_id FROM i{r} GROUP BY source_id HAVING count(*) >= 30),
    gon{r} AS (SELECT *, is_active AND last_batch <> 'r{r}' AND source_id IN (SELECT source_id FROM cnt{r}) AS gone FROM ups{r}),
    m{r} AS MATERIALIZED (SELECT id, source_id, external_item_id, content_hash, raw_title, CASE WHEN gone THEN missed + 1 < 2 ELSE is_active END AS is_active, last_batch, CASE WHEN gone THEN missed + 1 ELSE missed END AS missed FROM gon{r})""")


def _merged(v, routes_only: bool = False) -> RunState:
    """A run arrives, and the stream goes on from where it stopped. A run's files go when it is merged, as do the versions before it."""
    spark, items = v.spark, v.v_run_items
    state = RunState(spark, shared_path(spark, "runs"), buckets=8, routes_only=routes_only, history=False)
    checkpoint, files = shared_path(spark, "runs-checkpoint"), shared_path(spark, "run-files")
    for run in range(1, RUNS + 1):
        with freed_shuffles(spark):
            items.where(F.col("run_no") == run).write.option("compression", "zstd").parquet(f"{files}/r{run}")
        merge_runs(spark.readStream.schema(items.schema).parquet(f"{files}/*"), state, checkpoint)
        delete(spark, f"{files}/r{run}")
    return state


@query("stream_run_memberships", f"WITH {_NO_MEMBERS}, {_MEMBERS} SELECT id, source_id, external_item_id, content_hash, raw_title, is_active, last_batch, missed FROM m{RUNS}")
def stream_run_memberships(v):
    return _merged(v).members.read()


_ROUTE_STEPS = re.sub(r"\b(f|b|c|d|routed) AS \(", r"\g<1>{r} AS (", re.sub(r"FROM (f|b|c|d)\b", r"FROM \g<1>{r}", _ROUTED[_ROUTED.index("b AS (") :].replace("{", "{{").replace("}", "}}")))
_ROUTES = "k0 AS (SELECT NULL::VARCHAR AS content_hash, NULL::VARCHAR AS promotion_type, true AS free_shipping, NULL::VARCHAR AS route, 0 AS first_run WHERE false), z0 AS (SELECT NULL::VARCHAR AS external_id WHERE false)," + _each_run(f"""
    f{{r}} AS MATERIALIZED (SELECT DISTINCT ON (content_hash) * FROM v_run_items i WHERE run_no = {{r}} AND price > 0 AND content_hash NOT IN (SELECT content_hash FROM k{{p}} WHERE route IS NOT NULL) AND (external_id IS NULL OR external_id NOT IN (SELECT external_id FROM z{{p}})) ORDER BY content_hash, position, item_id),
    {_ROUTE_STEPS},
    l{{r}} AS (SELECT DISTINCT ON (content_hash) * FROM v_run_items WHERE run_no = {{r}} AND price > 0 ORDER BY content_hash, position DESC, item_id DESC),
    k{{r}} AS MATERIALIZED (SELECT coalesce(l.content_hash, k.content_hash) AS content_hash, coalesce(l.promotion_type, k.promotion_type) AS promotion_type, coalesce(l.free_shipping, k.free_shipping) AS free_shipping,
             coalesce(k.route, CASE q.passes WHEN true THEN 'published' WHEN false THEN 'pending' END) AS route, coalesce(k.first_run, {{r}}) AS first_run
             FROM k{{p}} k FULL JOIN l{{r}} l ON l.content_hash = k.content_hash LEFT JOIN routed{{r}} q ON q.content_hash = l.content_hash),
    z{{r}} AS MATERIALIZED (SELECT external_id FROM z{{p}} UNION SELECT external_id FROM f{{r}} WHERE external_id IS NOT NULL)""")


@query("stream_run_routes", f"WITH {_ROUTES} SELECT * FROM k{RUNS}")
def stream_run_routes(v):
    return _merged(v, routes_only=True).known.read()


_METRICS = " UNION ALL ".join(f"""SELECT {r} AS run_no, a.raw, a.parsed, b.collected, c.new, c.auto_approved, b.deactivated, a.raw - a.parsed AS errors, CASE WHEN a.parsed > 0 THEN 'completed' ELSE 'failed' END AS status
    FROM (SELECT count(*) AS raw, count(*) FILTER (WHERE price > 0) AS parsed FROM v_run_items WHERE run_no = {r}) a,
         (SELECT count(*) FILTER (WHERE last_batch = 'r{r}') AS collected, (SELECT count(*) FROM gon{r} WHERE gone AND missed + 1 >= 2) AS deactivated FROM m{r}) b,
         (SELECT count(*) AS new, count(*) FILTER (WHERE passes) AS auto_approved FROM routed{r}) c""" for r in range(1, RUNS + 1))


@query("run_metrics", f"WITH {_NO_MEMBERS}, {_MEMBERS}, {_ROUTES} {_METRICS}")
def run_metrics(v):
    return _merged(v).metrics


@query("stream_membership_state", """
    WITH l AS (SELECT source_id, external_item_id, max(batch_no) AS last_batch FROM v_observations GROUP BY ALL),
    g AS (SELECT l.*, (SELECT count(*) FROM v_batches b WHERE b.source_id = l.source_id AND b.batch_no > l.last_batch AND b.status = 'completed' AND b.total_collected >= 50) AS gap FROM l)
    SELECT source_id, external_item_id, last_batch, CAST(least(gap, 2) AS INT) AS missed, gap < 2 AS is_active FROM g""")
def stream_membership_state(v):
    """Days come in three slices; the second brings days of the first again."""
    runs = v.v_batches.select("source_id", F.col("batch_no").alias("run_no"), ((F.col("status") == "completed") & (F.col("total_collected") >= 50)).alias("counts"))
    rows = M.with_headers(v.v_observations.withColumnRenamed("batch_no", "run_no"), runs)
    part = lambda n, low, high: rows.where(F.col("run_no").between(low, high)).withColumn("slice", F.lit(n))
    slices = part(0, 0, 12).unionByName(part(1, 8, 20)).unionByName(part(2, 21, 31))
    changes = E.replayed(slices, "slice", M.presence_changes, E.Drain.new(v.spark, "presence"), rocks=True)
    kind = v.v_observations.schema["external_item_id"].dataType
    return M.latest_presence(changes).select("source_id", F.col("external_item_id").cast(kind).alias("external_item_id"), F.col("last_run").alias("last_batch"), "missed", "is_active")


# Events arrive in three slices of ten days; of every seventh event the report comes a slice late.
_SLICES = """a AS (SELECT event_id, user_id, ts, json_extract_string(props, '$.k') AS k, least(2, least(2, CAST(floor((extract(day FROM ts) - 1) / 10) AS INT)) + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS slice FROM events WHERE event_type = '{kind}'),
    marks AS (SELECT s.slice, (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOUR FROM a WHERE a.slice < s.slice) AS mark FROM (SELECT DISTINCT slice FROM a) s),
    kept AS (SELECT a.* FROM a JOIN marks m ON m.slice = a.slice WHERE m.mark IS NULL OR date_trunc('hour', a.ts) + INTERVAL 1 HOUR > m.mark),
    closed AS (SELECT date_trunc('hour', ts) AS window_start, * FROM kept WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM a))"""


def _sliced(v, kind: str):
    rows = v.events.where(F.col("event_type") == kind).withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10))
    late = F.when(F.col("event_id") % 7 == 0, 1).otherwise(0)
    return rows.withColumn("slice", F.least(F.lit(2), own + late).cast("int"))


@query("stream_clicks_late", f"WITH {_SLICES.format(kind='click')} SELECT user_id, window_start, count(*) AS n FROM closed GROUP BY ALL")
def stream_clicks_late(v):
    return E.replayed(_sliced(v, "click"), "slice", lambda s: E.windowed_counts(s, ["user_id"], "1 hour"), E.Drain.new(v.spark, "clicks"))


@query("stream_searches_late", f"""WITH {_SLICES.format(kind='view')}, n AS (SELECT window_start, k, count(*) AS n FROM closed GROUP BY ALL)
    SELECT window_start, k, n FROM n QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, k) <= 3""")
def stream_searches_late(v):
    count = lambda s: E.windowed_counts(s.withColumn("k", F.get_json_object("props", "$.k")), ["k"], "1 hour")
    counts = E.replayed(_sliced(v, "view"), "slice", count, E.Drain.new(v.spark, "searches"))
    return first_rows(counts, ["window_start"], [F.desc("n"), F.col("k")], 3).select("window_start", "k", "n")


@query("stream_first_clicks", f"WITH {_SLICES.format(kind='click')} SELECT DISTINCT ON (user_id) event_id, user_id, ts FROM a ORDER BY user_id, slice, ts, event_id")
def stream_first_clicks(v):
    """The first click of each user to arrive, whole; users are remembered for longer than the events span."""
    build = lambda s: E.first_rows_within(s.select("event_id", "user_id", "ts"), ["user_id"], "60 days", 60 * 86_400_000)
    found = E.replayed(_sliced(v, "click"), "slice", build, E.Drain.new(v.spark, "first-clicks"), rocks=True)
    return found.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
