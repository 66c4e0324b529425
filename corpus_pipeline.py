"""From raw documents to token ids: quality, near duplicates, benchmark leaks, personal data, encoding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the
shared folder and rereads them for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe_automaton, decontaminate, near_dedup, pii, quality
from cairn.llm.native import bounded
from cairn.llm.runtime import cut, fresh_path, remove, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of those it is given."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Rows without an id stay. A group's rows that share the smallest id are copies too: one of those with the
    smallest text hash stays. Other texts under a repeated id stay or go by their own groups.
    """
    classes = cut(near_dedup.near_duplicates(docs))
    gone = cut(classes.filter("NOT kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct())
    keyed = docs.withColumn("__of", near_dedup.text_key(F.col("text")))
    kept = keyed.join(bounded(gone), (F.col("doc_id") == F.col("__id")) & (F.col("__of") == F.col("__key")), "left_anti")
    several = classes.filter("kept AND class_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id"), "class_id")
    several = several.agg(F.collect_set("text_key").alias("__keys"), F.min("text_key").alias("__first"), F.count(F.lit(1)).alias("__n"))
    several = cut(several.filter("__n > 1").select("__id", F.explode("__keys").alias("__key"), "__first"))
    if several.isEmpty():
        return kept.drop("__of")
    few = bounded(several)
    on = (F.col("doc_id") == F.col("__id")) & (F.col("__of") == F.col("__key"))
    first = kept.join(few, on).filter(F.col("__of") == F.col("__first")).dropDuplicates(["__id", "__key"])
    return kept.join(few, on, "left_anti").unionByName(first.select(*kept.columns)).drop("__of")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "documents")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked; n_chars follows the text."""
    masked = pii.redact(docs.drop("n_chars"))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""
    ids = bpe_automaton.encode_documents(docs, tokenizer_path(), remember=60_000)  # beside what other stages left
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("pii", without_personal_data),
    ("bpe", encoded),
]

#: No SQL expresses the first two stages and the last; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
