"""The queries of this subpackage: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import chat_format, decontaminate, near_dedup, topk_search
from cairn.llm.runtime import tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.runtime import cut
    from cairn.llm.topk_search import build_index, search

    vectors = _table(spark, sf_dir, "embeddings")
    return search(cut(build_index(vectors)), vectors.filter("vec_id % 50 = 0"), k=5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import score, train

    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.chat_format import digests, format_conversations

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.range(2).selectExpr("-1L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", f"'{control}' AS text")
    return digests(format_conversations(rows.unionByName(more)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.html_render import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.runtime import fresh_path
    from cairn.llm.token_store import read_store, write_store

    path = fresh_path(spark, "tokens")
    write_store(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return read_store(spark, path)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.sharding import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), shards=16)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.bpe_automaton import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.near_dedup import near_duplicates

    # what tells apart several texts of one id stays with the operator: the SQL has these columns alone
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.pii import report

    return report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_decontamination": op4_decontamination,
    "op5_html": op5_html,
    "op6_token_store": op6_token_store,
    "op7_sharding": op7_sharding,
    "op8_bpe": op8_bpe,
    "op9_near_dedup": op9_near_dedup,
    "op10_pii": op10_pii,
}

ORACLES: dict[str, str] = {
    "op1_topk": topk_search.ORACLE,
    "op3_chat": chat_format.ORACLE,
    "op4_decontamination": decontaminate.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
}
