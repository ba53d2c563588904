"""Queries of event streams: what has come out when all that is there has been read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.catalog import first_rows
from ..registry import query
from ..streaming import events as E

_CLOSED = "(SELECT max(ts) - INTERVAL 2 HOUR FROM {kind})"
_CLICKS = "c AS (SELECT user_id, ts FROM events WHERE event_type = 'click')"
_VIEWS = "c AS (SELECT user_id, ts, json_extract_string(props, '$.k') AS k FROM events WHERE event_type = 'view')"


def _stream(v, kind: str):
    return E.event_stream(v.spark, f"{v.dir}/events*.parquet").where(F.col("event_type") == kind)


@query("stream_clicks_tumbling", f"WITH {_CLICKS} SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM c WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED.format(kind='c')} GROUP BY ALL")
def stream_clicks_tumbling(v):
    return E.drained(E.windowed_counts(_stream(v, "click"), ["user_id"], "1 hour"), "clicks")


@query("stream_clicks_sliding", f"""
    WITH {_CLICKS}, w AS (SELECT user_id, date_trunc('hour', ts) - to_hours(h) AS window_start FROM c, range(0, 3) r(h))
    SELECT user_id, window_start, count(*) AS n FROM w WHERE window_start + INTERVAL 3 HOUR <= {_CLOSED.format(kind='c')} GROUP BY ALL""")
def stream_clicks_sliding(v):
    return E.drained(E.windowed_counts(_stream(v, "click"), ["user_id"], "3 hours", "1 hour"), "clicks")


@query("stream_popular_searches", f"""
    WITH {_VIEWS}, n AS (SELECT date_trunc('hour', ts) AS window_start, k, count(*) AS n FROM c WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED.format(kind='c')} GROUP BY ALL)
    SELECT window_start, k, n FROM (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, k) AS r FROM n) x WHERE r <= 3""")
def stream_popular_searches(v):
    searches = _stream(v, "view").withColumn("k", F.get_json_object("props", "$.k"))
    counts = E.drained(E.windowed_counts(searches, ["k"], "1 hour"), "searches")
    return first_rows(counts, ["window_start"], [F.desc("n"), F.col("k")], 3).select("window_start", "k", "n")


@query("stream_search_sessions", f"""
    WITH {_VIEWS}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS starts FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session HAVING max(ts) + INTERVAL 12 HOUR <= {_CLOSED.format(kind='c')}""")
def stream_search_sessions(v):
    return E.drained(E.session_counts(_stream(v, "view"), "user_id", "12 hours"), "sessions")


@query("stream_dedup", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click'")
def stream_dedup(v):
    return E.drained(E.first_within(_stream(v, "click"), ["user_id"], "60 days").select("user_id"), "first")
