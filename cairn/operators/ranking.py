"""Recall rows, alignment, fusion, pinning, reranking.

A recall row is (route, rank, chunk_id, score, ...): rank is the position in its route, from 1.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RRF_K = 60
#: What an aligned hit keeps of its parent's score, and how many chunks it becomes.
SECTION_SHARE, SUMMARY_SHARE, ALIGN_CHUNKS = 0.9, 0.7, 5
PIN_SCORE, PIN_SOURCES = 0.9, 6


def chunk_items(hits: DataFrame, kind: str, key: str) -> DataFrame:
    """Hits of other kinds get ids that name their kind."""
    return hits.withColumn("kind", F.lit(kind)).withColumn("chunk_id", F.col(key).cast("string") if kind == "chunk" else F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")))


def recall(routes: Mapping[str, DataFrame], key: str = "chunk_id") -> DataFrame:
    """The routes' rows with their ranks; every route must come cut to its top k, so that ranking one is cheap."""
    own = {"route", "route_no", key, "score"}
    ranked = [df.select(F.lit(name).alias("route"), F.lit(i).alias("route_no"), key, F.col("score").cast("double").alias("score"), *(c for c in df.columns if c not in own)).withColumn("rank", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("score"), key))) for i, (name, df) in enumerate(routes.items())]
    return functools.reduce(DataFrame.unionByName, ranked)


def expand(hits: DataFrame, chunks: DataFrame, parent: str, share: float, most: int = ALIGN_CHUNKS, order: str = "sub_rank", how: str = "inner") -> DataFrame:
    """Each hit becomes its parent's first chunks, with a share of its score."""
    met = hits.join(chunks.filter(F.col(order) <= most), parent, how)
    return met.withColumn("score", F.col("score") * share)


def qa_sources(sources: Column, chunk: Column, own: Column, most: int = ALIGN_CHUNKS) -> Column:
    """The first five ids of a question's sources, blank ones left out; else its one chunk; else the question itself."""
    real = F.filter(F.slice(sources.cast("array<string>"), 1, most), lambda s: F.coalesce(s, F.lit("")) != "")
    one = F.coalesce(F.nullif(chunk.cast("string"), F.lit("")), own.cast("string"))
    return F.when(F.coalesce(F.size(real), F.lit(0)) > 0, real).otherwise(F.array(one))


def id_sample(ids: Column, most: int = 20) -> Column:
    """The first ids of a collected list, for a report."""
    return F.slice(ids, 1, most)


def rerank_positions(rows: DataFrame, sub: str = "sub_rank") -> DataFrame:
    """Ranks follow from the positions after expansion."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("route").orderBy("rank", sub)))


def rrf(recalled: DataFrame, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank), occurrences in one route each counting; routes in order of appearance."""
    order = F.struct("route_no", "rank", "route")
    out = recalled.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["route"]).alias("routes"), F.min(F.struct("route_no", "rank")).alias("first"))
    return out.withColumn("score", F.round("score", 12))


def weighted(recalled: DataFrame, weights: Mapping[str, float] | None = None, key: str = "chunk_id") -> DataFrame:
    """Min-max in each route (constant: 1.0; null score: 0), times the route's weight, summed."""
    route = Window.partitionBy("route")
    score = F.coalesce("score", F.lit(0.0))
    low, high = F.min(score).over(route), F.max(score).over(route)
    norm = F.when(high > low, (score - low) / (high - low)).otherwise(1.0)
    pairs = [x for k, v in (weights or {}).items() for x in (F.lit(k), F.lit(float(v)))]
    weight = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("route")), F.lit(1.0)) if pairs else F.lit(1.0)
    scaled = recalled.withColumn("part", norm * weight)
    order = F.struct("route_no", "rank", "route")
    out = scaled.groupBy(key).agg(F.sum("part").alias("score"), F.transform(F.array_sort(F.collect_list(order)), lambda x: x["route"]).alias("routes"), F.min(F.struct("route_no", "rank")).alias("first"))
    return out.withColumn("score", F.round("score", 12))


def fuse(recalled: DataFrame, strategy: str = "rrf", weights: Mapping[str, float] | None = None, key: str = "chunk_id") -> DataFrame:
    """R15."""
    if strategy not in ("rrf", "weighted_sum"):
        raise ValueError(f"unknown fusion {strategy}")
    return rrf(recalled, key) if strategy == "rrf" else weighted(recalled, weights, key)


def best(fused: DataFrame, n: int, key: str = "chunk_id") -> DataFrame:
    """The n best, ties by first appearance."""
    return fused.orderBy(F.desc("score"), "first", key).limit(n)


def pin(qa: DataFrame, threshold: float = PIN_SCORE) -> DataFrame:
    """The best QA hit, if it reaches the threshold and has an answer."""
    return qa.orderBy(F.desc("score"), "rank").limit(1).filter((F.col("score") >= threshold) & (F.trim("answer") != ""))


def evidence_ids(ids: Column, most: int = PIN_SOURCES) -> Column:
    """R17."""
    return F.slice(F.array_distinct(F.filter(ids, lambda x: x != "")), 1, most)


def hydrate(pinned: DataFrame, chunks: DataFrame) -> DataFrame:
    """The pinned answer's sources in order, with the text to show; blanks are dropped."""
    ids = pinned.select("score", F.posexplode(evidence_ids(F.col("source_chunk_ids"))).alias("ord", "chunk_id"))
    text = F.coalesce(F.nullif(F.trim("display_text"), F.lit("")), F.nullif(F.trim("search_text"), F.lit("")))
    return ids.join(chunks, "chunk_id").withColumn("text", text).filter("text IS NOT NULL").select("ord", "chunk_id", "score", "text")


def without(df: DataFrame, gone: DataFrame, key: str = "chunk_id") -> DataFrame:
    """R18."""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def coverage(text: Column, terms: list[str]) -> Column:
    """R20-R22's default scorer: the share of the query's terms that the text holds."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    hit = sum((F.lower(text).contains(t).cast("double") for t in terms), F.lit(0.0))
    return hit / max(1, len(terms))


def rerank(fused: DataFrame, texts: DataFrame, terms: list[str], n: int, top_k: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """The n best get texts, blanks and pseudo ids are dropped, the scorer ranks the rest."""
    real = best(fused, n, key).filter(~F.col(key).cast("string").rlike("^(section|qa|summary):"))
    met = real.join(texts.select(key, text), key).filter(F.trim(text) != "")
    return met.withColumn("fused", F.col("score")).withColumn("score", F.round(coverage(F.col(text), terms), 9)).orderBy(F.desc("score"), F.desc("fused"), key).limit(min(top_k, n))


def route_stats(plan: DataFrame, recalled: DataFrame, aligned: DataFrame, final: DataFrame) -> DataFrame:
    """Counts for every planned route; the final one counts a chunk once for each time it lists the route."""
    count = lambda df, name: df.groupBy("route").agg(F.count(F.lit(1)).alias(name))
    named = final.select(F.explode("routes").alias("route"))
    out = plan
    for df, name in ((recalled, "recalled"), (aligned, "aligned"), (named, "final")):
        out = out.join(count(df, name), "route", "left")
    return out.fillna(0, ["recalled", "aligned", "final"])
