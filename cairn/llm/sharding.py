"""Sharding by jump consistent hashing, with DataFrame functions only.

A key's shards for 1, 2, 3 ... shards change at a few random counts, its jumps. The next jump after b is
floor((b + 1) / r) for a uniform number r that the key and the jump's ordinal decide, and the shard for n shards
is the last jump below n. So no table is kept, and a row moves only into a shard that has been added. The
numbers come from xxhash64(key, ordinal).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm.runtime import cut

#: A key has about ln(shards) jumps; of this many, one key in 10**100 would need more.
MOST_JUMPS = 256
#: Rows that a task numbers, about.
BUCKET_ROWS = 1000
MOST_BUCKETS = 1 << 16


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 .. shards - 1, of a 64-bit key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(a: Column, i: Column) -> Column:
        r = (F.shiftrightunsigned(F.xxhash64(key, i), 11).cast("double") + 1) / F.lit(float(1 << 53))
        jump = F.when(a["j"] < shards, F.least(F.floor((a["j"] + 1) / r), F.lit(1 << 53)).cast("long")).otherwise(a["j"])
        return F.struct(F.when(a["j"] < shards, a["j"]).otherwise(a["b"]).alias("b"), jump.alias("j"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MOST_JUMPS))), start, step, lambda a: a["b"].cast("int"))


def assign_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row for each row of docs.

    size is the text's UTF-8 bytes plus 1 (null: none, so 1); law is ``key``: doc_id and the number of shards
    alone decide. grown_shard is the shard when there is one more. slot numbers a shard's rows from 0 without
    gaps: each shard falls into hashed buckets, whose counts give every bucket its first slot, so that no task
    orders a whole shard. A null doc_id is a key of its own; rows that repeat an id share its shard and get
    slots of their own.
    """
    text, key = F.col(text_col).cast("string"), F.col(id_col)
    rows = docs.select(key.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(key).alias("__key"))
    rows = rows.select("doc_id", "size", "text_crc32", jump_hash(F.col("__key"), shards).alias("shard"), jump_hash(F.col("__key"), shards + 1).alias("grown_shard"))
    rows = cut(rows)  # read twice below, and texts only once
    buckets = max(1, min(MOST_BUCKETS, rows.count() // (shards * BUCKET_ROWS)))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    count = rows.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    first = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = count.select("shard", "__bucket", F.coalesce(F.sum("__n").over(first), F.lit(0)).alias("__base"))
    numbered = rows.withColumn("__at", F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy("doc_id", "size", "text_crc32")) - 1)
    met = numbered.join(base, ["shard", "__bucket"])
    return met.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__base") + F.col("__at")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id") -> None:
    """docs as Parquet, a folder for each shard; every column stays. A shard's rows go to as many files as tasks hold them."""
    docs.withColumn("__shard", jump_hash(F.xxhash64(F.col(id_col)), shards)).write.partitionBy("__shard").mode("overwrite").parquet(path)
