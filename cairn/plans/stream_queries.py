"""Queries over the event stream; each works on a batch read of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.registry import query, table
from cairn.streaming import events as E


def _events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("K27_event_dedup", "SELECT min(event_id) AS event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 GROUP BY user_id, event_type")
def event_dedup(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    return E.deduplicated(rows, "ts", "key").select("event_id", "user_id", "event_type")


@query("K33_progress_latest", "SELECT user_id, max_by(event_type, ts) AS stage FROM events GROUP BY 1")
def progress(spark, sf_dir):
    return E.latest_progress(_events(spark, sf_dir), "user_id", "ts", "event_type").select("user_id", "stage")


@query("K31_dead_letters", "SELECT event_type, CASE WHEN length(props) > 50 THEN left(props, 50) || '...' ELSE props END AS error_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def dead_letters(spark, sf_dir):
    return E.dead_letters(_events(spark, sf_dir).filter("event_type = 'error'"), 10, "event_type", "props")


@query("K29_retry_split", "SELECT CASE WHEN event_id % 5 < 3 THEN 'again' ELSE 'dead' END AS kind, count(*) AS n, sum(CASE WHEN event_id % 5 < 3 THEN CASE event_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 30 END ELSE 0 END)::BIGINT AS delay FROM events GROUP BY 1")
def retry_split(spark, sf_dir):
    rows = _events(spark, sf_dir).select("event_id", "ts", (F.col("event_id") % 5).cast("int").alias("retry_count"))
    again, dead = E.with_retry(rows, F.col("ts"))
    delay = F.sum(F.unix_timestamp("due") - F.unix_timestamp("ts"))
    return again.agg(F.lit("again").alias("kind"), F.count(F.lit(1)).alias("n"), delay.alias("delay")).union(dead.agg(F.lit("dead").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("delay")))


@query("event_tumbling", "SELECT time_bucket(INTERVAL 1 day, ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    rows = E.tumbling(_events(spark, sf_dir), "ts", "1 day", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sliding", "WITH s AS (SELECT event_type, unnest(generate_series(time_bucket(INTERVAL 1 day, ts) - INTERVAL 1 day, time_bucket(INTERVAL 1 day, ts), INTERVAL 1 day)) AS start FROM events) SELECT start::VARCHAR AS start, event_type, count(*) AS n FROM s GROUP BY 1, 2")
def sliding(spark, sf_dir):
    rows = E.sliding(_events(spark, sf_dir), "ts", "2 days", "1 day", "event_type")
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("event_session", "WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 hour, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k")
def session(spark, sf_dir):
    return E.sessions(_events(spark, sf_dir), "ts", "6 hours", "user_id").select("user_id", F.unix_micros("start").alias("start_us"), "n")


DELTAS = "SELECT * FROM VALUES ('a', 2, 'lo', NULL, NULL, 0, NULL, NULL, '1}'), ('a', 1, 'hel', 'hm', NULL, 0, 'id1', 'find', '{\"x\":'), ('a', 3, NULL, NULL, 'stop', NULL, NULL, NULL, NULL) AS t(stream_id, seq, content, thinking, finish_reason, call_index, call_id, call_name, call_arguments)"


@query("K40_accumulate", "SELECT 'a' AS stream_id, 'hello' AS content, 'hm' AS thinking, 'stop' AS finish_reason, 'id1' AS id, '{\"x\":1}' AS arguments")
def accumulate(spark, sf_dir):
    return E.accumulate(spark.sql(DELTAS)).select("stream_id", "content", "thinking", "finish_reason", F.col("tool_calls")[0]["id"].alias("id"), F.col("tool_calls")[0]["arguments"].alias("arguments"))
