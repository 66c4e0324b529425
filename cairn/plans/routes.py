"""The nine built-in routes over an indexed corpus, and the alignment of their hits to chunks.

A route gives rows (chunk_id, score, kind, key): chunk_id names the hit ("section:7" and so on for hits that are no
chunks) and key is the plain id. All routes rank by score and then key, and are cut to their top k.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import lexical, ranking, vector

#: route -> (collection, kind of its hits). Fixed values.
DENSE = {
    "chunk_dense": ("chunk", "chunk"),
    "enhanced_chunk_dense": ("enhanced_chunk", "chunk"),
    "section_dense": ("section", "section"),
    "section_summary_dense": ("section_summary", "summary"),
    "file_summary_dense": ("file_summary", "summary"),
    "qa_dense": ("qa", "qa"),
}
LEXICAL = ("bm25_sparse", "exact_match", "boolean_search")
NAMES = (*DENSE, *LEXICAL)


@dataclass
class Store:
    """What the routes read. Ids are longs.

    vectors: collection -> (id, embedding). chunks: (chunk_id, section_id, document_id, ord, text). sections:
    (section_id, document_id, ord). qa: (id, answer, source_chunk_ids, chunk_id). embed turns a query into a vector;
    scope, if there is one, holds the document_ids that hits may come from.
    """

    chunks: DataFrame
    sections: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    qa: DataFrame | None = None
    embed: Callable[[str], Sequence[float]] | None = None
    scope: DataFrame | None = None

    def query_vector(self, q: str, params: dict) -> Column:
        """Q19: the vector that params bring, or the query's."""
        if params.get("vector") is None and (self.embed is None or not q):
            raise ValueError("a text or a vector is needed")
        return vector.literal(params["vector"] if params.get("vector") is not None else self.embed(q))

    def texts(self) -> DataFrame:
        return self.chunks.select(F.col("chunk_id").cast("string").alias("chunk_id"), "text")

    def scoped_chunks(self) -> DataFrame:
        """the chunks of the scope's documents, or all."""
        return self.chunks if self.scope is None else self.chunks.join(self.scope.select("document_id").distinct(), "document_id", "left_semi")


def _named(hits: DataFrame, kind: str) -> DataFrame:
    return ranking.chunk_items(hits, kind, "key").select("chunk_id", "score", "kind", "key")


def dense(store: Store, name: str) -> Callable[[str, int, dict], DataFrame]:
    collection, kind = DENSE[name]

    def route(q: str, top_k: int, params: dict) -> DataFrame:
        rows = store.vectors[collection]
        if store.scope is not None and kind == "chunk":
            rows = rows.join(store.scoped_chunks().select(F.col("chunk_id").alias("id")), "id", "left_semi")
        hits = rows.select(F.col("id").alias("key"), F.round(vector.cosine(F.col("embedding"), store.query_vector(q, params)), 9).alias("score"))
        if params.get("threshold") is not None:
            hits = hits.filter(F.col("score") >= params["threshold"])
        return _named(hits.orderBy(F.desc("score"), "key").limit(top_k), kind)

    route.__doc__ = f"{kind} hits by cosine over {collection} vectors"
    return route


def sparse(store: Store) -> Callable[[str, int, dict], DataFrame]:
    def route(q: str, top_k: int, params: dict) -> DataFrame:
        """chunks by BM25 weights"""
        found = vector.sparse_topk(store.scoped_chunks(), sorted(set(q.lower().split())), top_k, "chunk_id", "text")
        return _named(found.withColumnRenamed("chunk_id", "key"), "chunk")

    return route


def exact(store: Store) -> Callable[[str, int, dict], DataFrame]:
    def route(q: str, top_k: int, params: dict) -> DataFrame:
        """chunks that hold one of the keywords (the query itself if none are named); an unknown mode counts as fuzzy"""
        mode = params.get("match_mode")
        hit = F.lit(False)
        for word in params.get("keywords") or [q]:
            hit = hit | lexical.matches(F.col("text"), word, mode if mode in ("exact", "prefix", "regex", "fuzzy") else "fuzzy")
        found = store.scoped_chunks().filter(hit).select(F.col("chunk_id").alias("key"), F.lit(1.0).alias("score"))
        return _named(found.orderBy("key").limit(top_k), "chunk")

    return route


def boolean(store: Store) -> Callable[[str, int, dict], DataFrame]:
    def route(q: str, top_k: int, params: dict) -> DataFrame:
        """chunks that satisfy a boolean expression"""
        found = store.scoped_chunks().filter(lexical.boolean_condition(lexical.parse_boolean(params.get("expression") or q), ["text"]))
        return _named(found.select(F.col("chunk_id").alias("key"), F.lit(1.0).alias("score")).orderBy("key").limit(top_k), "chunk")

    return route


def builtin(store: Store) -> dict[str, Callable[[str, int, dict], DataFrame]]:
    """The nine routes, those of collections that the store lacks left out."""
    out = {name: dense(store, name) for name, (collection, _) in DENSE.items() if collection in store.vectors}
    return out | {"bm25_sparse": sparse(store), "exact_match": exact(store), "boolean_search": boolean(store)}


def _nearest(rows: DataFrame, store: Store, asked: Column | None, by: list[str]) -> DataFrame:
    """Of each hit's chunks: the five nearest to the query where there are more than five and a query vector, else the first five."""
    most = ranking.ALIGN_CHUNKS
    whole, first = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("position", "chunk")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("sub_rank", F.row_number().over(first))
    if asked is None or "chunk" not in store.vectors:
        return rows.filter(F.col("sub_rank") <= most)
    met = rows.join(store.vectors["chunk"].select(F.col("id").alias("chunk"), "embedding"), "chunk", "left")
    near = F.round(F.coalesce(vector.cosine(F.col("embedding"), asked), F.lit(0.0)), 9)
    order = Window.partitionBy(*by).orderBy(F.desc(F.when(F.col("n") > most, near).otherwise(0.0)), "position", "chunk")
    return met.withColumn("sub_rank", F.row_number().over(order)).filter(F.col("sub_rank") <= most)


def align(recalled: DataFrame, store: Store, asked: Column | None = None) -> DataFrame:
    """(route, route_no, rank, chunk_id, score): hits that are no chunks become chunks.

    A section hit becomes its chunks and keeps 0.9 of its score, a summary hit the chunks of its document's first five
    sections at 0.7, a question the chunks that it was taken from, at its score. Hits of sections or documents
    without chunks go; a question or a summary without a source stays. Ranks follow from the expanded order.
    """
    hit = ["route", "route_no", "rank"]
    plain = recalled.filter("kind = 'chunk'").select(*hit, "chunk_id", "score", F.lit(1).alias("sub_rank"))
    chunks = store.chunks.select("section_id", F.col("chunk_id").alias("chunk"), F.col("ord").alias("position"))
    sections = recalled.filter("kind = 'section'").join(chunks, F.col("key") == F.col("section_id"))
    rows = [plain, _share(_nearest(sections, store, asked, hit), ranking.SECTION_SHARE)]
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("ord", "section_id"))
    first = store.sections.withColumn("nth", rank).filter(F.col("nth") <= 5).select("section_id", "document_id", "nth")
    below = first.join(chunks, "section_id").select("document_id", F.struct("nth", "position").alias("position"), "chunk")
    of = store.sections.select(F.col("section_id").alias("__section"), F.col("document_id").alias("__document"))
    summaries = recalled.filter("kind = 'summary'").join(of, (F.col("key") == F.col("__section")) & (F.col("route") == "section_summary_dense"), "left")
    summaries = summaries.withColumn("document_id", F.when(F.col("route") == "section_summary_dense", F.col("__document")).otherwise(F.col("key")))
    stray = summaries.filter("document_id IS NULL").select(*hit, "chunk_id", "score", F.lit(1).alias("sub_rank"))
    rows += [_share(_nearest(summaries.drop("__section", "__document").join(below, "document_id"), store, asked, hit), ranking.SUMMARY_SHARE), stray]
    if store.qa is not None:
        known = store.qa.select(F.col("id").alias("key"), F.col("source_chunk_ids").alias("__sources"), F.col("chunk_id").alias("__own"))
        questions = recalled.filter("kind = 'qa'").join(known, "key", "left")
        rows.append(questions.select(*hit, F.posexplode(ranking.qa_sources(F.col("__sources"), F.col("__own"), F.col("chunk_id"))).alias("sub_rank", "chunk_id"), "score"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("route").orderBy("rank", "sub_rank", "chunk_id"))
    return out.withColumn("rank", rank).select(*hit, "chunk_id", F.round("score", 9).alias("score"))


def _share(rows: DataFrame, share: float) -> DataFrame:
    return rows.select("route", "route_no", "rank", F.col("chunk").cast("string").alias("chunk_id"), (F.col("score") * share).alias("score"), "sub_rank")
