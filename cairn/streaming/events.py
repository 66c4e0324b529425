"""Event streams (K20-K41): envelopes, deduplication, retries, dead letters, progress, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.text import error_type, stage_progress

#: Fixed values.
RETRY_DELAYS, MAX_RETRIES = [1, 5, 30], 3
DEDUP_HOURS = 24
ENVELOPE = "event_id string, trace_id string, timestamp timestamp, retry_count int, source string, context map<string,string>, user_id string, file_id string, payload string"


def decode(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON messages as rows; what isn't JSON has a null event_id."""
    return raw.select(F.from_json(F.col(column).cast("string"), ENVELOPE).alias("m")).select("m.*")


def encode(events: DataFrame) -> DataFrame:
    """Keyed by user and file."""
    return events.select(F.concat_ws(":", "user_id", "file_id").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def deduplicated(events: DataFrame, time: str = "timestamp", key: str = "event_id") -> DataFrame:
    """One row for each key within a day; works on streams (state ends with the watermark) and batches."""
    if events.isStreaming:
        return events.withWatermark(time, f"{DEDUP_HOURS} hours").dropDuplicatesWithinWatermark([key])
    first = F.row_number().over(Window.partitionBy(key).orderBy(time))
    return events.withColumn("__rn", first).filter("__rn = 1").drop("__rn")


def with_retry(failed: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that come again when due, rows that are dead)."""
    n = F.coalesce("retry_count", F.lit(0))
    delay = F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), F.least(n + 1, F.lit(len(RETRY_DELAYS))))
    again = failed.filter(n < MAX_RETRIES).withColumn("due", F.timestamp_seconds(F.unix_timestamp(now) + delay)).withColumn("retry_count", n + 1)
    return again, failed.filter(n >= MAX_RETRIES)


def dead_letters(dead: DataFrame, top: int = 10, topic: str = "source", error: str = "error") -> DataFrame:
    """The most frequent errors of each topic."""
    return dead.groupBy(topic, error_type(F.col(error)).alias("error_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), topic, "error_type").limit(top)


def latest_progress(events: DataFrame, key: str = "file_id", time: str = "timestamp", stage: str = "stage") -> DataFrame:
    """The last stage of each file; equal times go by stage."""
    return events.groupBy(key).agg(F.max_by(stage, F.struct(time, stage)).alias("stage")).withColumn("progress", stage_progress(F.col("stage")))


def batch_progress(asked: DataFrame, progress: DataFrame, key: str = "file_id", ord_col: str = "ord") -> DataFrame:
    """As asked, nulls for files that are not known."""
    return asked.join(progress, key, "left").orderBy(ord_col)


def worker(process: Callable[[DataFrame], tuple[DataFrame, DataFrame]], done: Callable[[DataFrame], None], failed: Callable[[DataFrame], None], enabled: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: distinct events are processed once from a stored micro-batch."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not enabled:
            return
        rows = batch.dropDuplicates(["event_id"]).persist()
        try:
            good, bad = process(rows)
            done(good)
            failed(bad)
        finally:
            rows.unpersist()

    return run


def tumbling(events: DataFrame, time: str, width: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, time: str, width: str, step: str, *keys: str) -> DataFrame:
    return events.groupBy(F.window(time, width, step).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, *keys: str) -> DataFrame:
    return events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def accumulate(deltas: DataFrame, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """A stream's deltas folded: text in order, each tool call's first id and name, and its arguments in order."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(seq, F.col(c).alias("v"))))), lambda x: x["v"]), "")
    said = deltas.groupBy(stream).agg(text("content").alias("content"), text("thinking").alias("thinking"), F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.col(seq))).alias("finish_reason"))
    calls = deltas.filter("call_index IS NOT NULL").groupBy(stream, "call_index").agg(F.min_by("call_id", F.when(F.col("call_id").isNotNull(), F.col(seq))).alias("id"), F.min_by("call_name", F.when(F.col("call_name").isNotNull(), F.col(seq))).alias("name"), text("call_arguments").alias("arguments"))
    tools = calls.groupBy(stream).agg(F.array_sort(F.collect_list(F.struct("call_index", "id", "name", "arguments"))).alias("tool_calls"))
    return said.join(tools, stream, "left")
