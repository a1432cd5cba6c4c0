"""Queries of state over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from paragrid.sources.tables import table
from paragrid.streaming import state


def _events(spark, folder):
    return table(spark, folder, "events")


def event_log_latest_state(spark, folder):
    return state.latest_state(_events(spark, folder), "user_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "ts", "event_type", "value")


def hourly_counts(spark, folder):
    return state.windowed_counts(_events(spark, folder), "ts", "1 hour", "event_type")


def user_sessions(spark, folder):
    return state.sessions(_events(spark, folder), "user_id", "ts", 1800)


def conversation_latest30(spark, folder):
    return state.newest(_events(spark, folder), "user_id", 30, F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "place")


def attempt_ledger_audit(spark, folder):
    return state.retries(_events(spark, folder), "user_id", "ts", F.col("event_type") == "error")


def frontier_next(spark, folder):
    hosts = table(spark, folder, "chunks").groupBy("document_id").agg(F.min(F.lower("source_host")).alias("host")).where("host is not null")
    rows = table(spark, folder, "parsed_documents").groupBy("document_id").agg(F.min("fetched_at").alias("fetched_at")).join(hosts, "document_id")
    return state.claim_order(rows, "host", F.col("fetched_at"), F.col("document_id")).select("document_id", "host", "turn")


def event_properties(spark, folder):
    rows = _events(spark, folder).select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.countDistinct("k").alias("kinds"))


QUERIES = {
    f.__name__: f
    for f in (event_log_latest_state, hourly_counts, user_sessions, conversation_latest30, attempt_ledger_audit, frontier_next, event_properties)
}

SQL = {
    "event_log_latest_state": "SELECT user_id, event_id, ts, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "user_sessions": """WITH f AS (SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000.0 > 1800 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)
        SELECT user_id, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY 1, 2""",
    "conversation_latest30": "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 30",
    "attempt_ledger_audit": """WITH r AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r),
        l AS (SELECT user_id, run, count(*) AS n, sum(bad) AS bad FROM g GROUP BY 1, 2), e AS (SELECT user_id, arg_max(bad, (ts, event_id)) = 1 AS ends_failed FROM r GROUP BY 1)
        SELECT user_id, CAST(sum(n) AS BIGINT) AS attempts, CAST(sum(bad) AS BIGINT) AS failures, CAST(max(bad) AS BIGINT) AS longest_run, any_value(ends_failed) AS ends_failed FROM l JOIN e USING (user_id) GROUP BY 1""",
    "frontier_next": """SELECT document_id, host, row_number() OVER (PARTITION BY host ORDER BY fetched_at, document_id) AS turn FROM (SELECT document_id, min(fetched_at) AS fetched_at FROM parsed_documents GROUP BY 1)
        JOIN (SELECT document_id, min(lower(source_host)) AS host FROM chunks GROUP BY 1) USING (document_id) WHERE host IS NOT NULL""",
    "event_properties": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS kinds FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1",
}
