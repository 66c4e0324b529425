"""Writers of change events to stores, and the fan-out of one event into many.

A store is a folder of Parquet tables. A batch of changes has (target, operation, key, row): rows are JSON, which each
target's schema reads. Writing a batch replaces the targets that it names, and returns what could not be written.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import catalog

OPERATIONS = ("insert", "update", "upsert", "delete")
#: Rows and milliseconds after which a batch is written, by kind of store.
TRIGGERS = {"vector": (100, 500), "graph": (500, 2000), "relational": (200, 1000), "document": (100, 500)}
#: What a file's event leads to, by stage: the kinds of rows written, and the next stage.
FAN_OUT = {
    "parse": (("element", "element_data", "file_status"), "split"),
    "split": (("chunk", "chunk_data", "section", "chunk_vector", "file_status"), "section_summary"),
    "section_summary": (("section_data", "section_summary_vector"), "file_summary"),
    "file_summary": (("document_data", "file_summary_vector"), "analyze"),
    "analyze": (("qa", "qa_vector"), None),
}


def trigger(kind: str) -> dict[str, str]:
    """The options of a streaming write, a batch each interval."""
    return {"processingTime": f"{TRIGGERS[kind][1]} milliseconds"}


def groups(changes: DataFrame) -> DataFrame:
    """Q38: how many changes go to each target and operation."""
    return changes.groupBy("target", "operation").agg(F.count(F.lit(1)).alias("n"))


def reject_reason(required: Column | None = None) -> Column:
    """K3, Q39: why a change can't be written, or null: an unknown operation, no key, or a missing field."""
    out = F.when(~F.coalesce(F.col("operation").isin(*OPERATIONS), F.lit(False)), "operation").when(F.col("key").isNull(), "key")
    return out if required is None else out.when(~F.coalesce(required, F.lit(False)) & (F.col("operation") != "delete"), "field")


def apply_changes(old: DataFrame, changes: DataFrame, key: Sequence[str], seq: str = "seq") -> DataFrame:
    """K1, K2: a table after a batch: each key's changes in order, the last of them deciding.

    An insert or upsert replaces the row, an update only what it names (nulls leave a value), a delete removes it.
    An update or delete of an unknown key does nothing.
    """
    last = catalog.latest(changes, key, [seq])
    gone = last.filter("operation = 'delete'").select(*key)
    new = last.filter("operation IN ('insert', 'upsert')").select(*[c for c in old.columns if c in last.columns])
    edits = last.filter("operation = 'update'").select(*[c for c in old.columns if c in last.columns])
    rows = catalog.upsert(old.join(gone, list(key), "left_anti"), new, key, keep=())
    known = edits.join(rows.select(*key), list(key), "left_semi")
    return catalog.upsert(rows, known, key, keep=(), skip_nulls=True)


def merged_nodes(nodes: DataFrame, known: DataFrame, key: Sequence[str] = ("type", "name")) -> DataFrame:
    """K4: nodes (or edges by head, relation and tail) that a graph doesn't hold yet, once each."""
    return nodes.dropDuplicates(list(key)).join(known.select(*key).distinct(), list(key), "left_anti")


def vector_rows(rows: DataFrame, text: str, required: Sequence[str], extra: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """K3: (rows to embed, rows refused): blank texts are passed over, rows that lack a required field refused; other columns go."""
    kept = rows.filter(F.trim(F.coalesce(text, F.lit(""))) != "")
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    names = list(dict.fromkeys([*required, text, *extra]))
    return kept.filter(whole).select(*names), kept.filter(~whole)


def fan_out(events: DataFrame) -> DataFrame:
    """(event_id, file_id, message, kind): a finished stage's writes, and the event of the next stage."""
    out = None
    for stage, (writes, after) in FAN_OUT.items():
        messages = [F.struct(F.lit("write").alias("message"), F.lit(w).alias("kind")) for w in writes]
        if after:
            messages.append(F.struct(F.lit("event").alias("message"), F.lit(after).alias("kind")))
        made = F.when(F.col("stage") == stage, F.array(*messages))
        out = made if out is None else F.coalesce(out, made)
    return events.select("event_id", "file_id", F.explode(out).alias("m")).select("event_id", "file_id", "m.*")


class TableStore:
    """Parquet tables below a folder, each written as a whole into a new version that a batch then reads."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, Sequence[str]]):
        self.spark, self.path, self.keys, self.version = spark, path, keys, dict.fromkeys(keys, 0)

    def read(self, target: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.path, target, f"v{self.version[target]}"))

    def create(self, target: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(os.path.join(self.path, target, "v0"))
        self.version[target] = 0

    def write_batch(self, changes: DataFrame) -> DataFrame:
        """K1-K5: applies a batch and returns the changes that were refused, each with its reason."""
        reason = F.when(~F.col("target").isin(*self.keys), "target").otherwise(reject_reason())
        judged = changes.withColumn("reason", reason)
        named = {r["target"] for r in judged.filter("reason IS NULL").select("target").distinct().collect()}  # of the known targets
        for target in sorted(named):
            old = self.read(target)
            rows = judged.filter((F.col("target") == target) & F.col("reason").isNull())
            fields = rows.select("operation", "seq", F.from_json("row", old.schema).alias("r")).select("operation", "seq", "r.*")
            after = self.version[target] + 1
            apply_changes(old, fields, self.keys[target]).write.mode("overwrite").parquet(os.path.join(self.path, target, f"v{after}"))
            self.version[target] = after
        return judged.filter("reason IS NOT NULL")
