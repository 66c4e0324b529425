"""Queries over recall, alignment, fusion, pinning and reranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.operators import lexical, ranking, vector
from cairn.plans.engine import Engine, Plan, Route
from cairn.plans.retrieval_queries import BM25
from cairn.registry import query, table

TERMS = ["therea", "thinor", "einen"]


def _routes(spark, sf_dir, k: int = 30):
    docs = table(spark, sf_dir, "documents")
    hits = lexical.grep(docs.withColumnRenamed("text", "search_text"), ["therea"], top_k=k, key="doc_id").select(F.col("doc_id").alias("chunk_id"), "score")
    sparse = vector.sparse_topk(docs, TERMS, k, "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")
    return {"exact_match": hits, "bm25_sparse": sparse}


_RECALLED = BM25 + """,
a AS (SELECT 'exact_match' AS route, 0 AS route_no, doc_id AS chunk_id, 1.0 AS score, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains(lower(text), 'therea') ORDER BY doc_id LIMIT 30),
b AS (SELECT 'bm25_sparse' AS route, 1 AS route_no, doc_id AS chunk_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r ORDER BY rank LIMIT 30),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""


@query("R4_recall", _RECALLED + " SELECT route, chunk_id, rank::INTEGER AS rank, round(score, 6) AS score FROM u")
def recall(spark, sf_dir):
    return ranking.recall(_routes(spark, sf_dir)).select("route", "chunk_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


_RRF = _RECALLED + ", fused AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, string_agg(route, ',' ORDER BY route_no, rank) AS routes, min(route_no * 1000 + rank) AS first FROM u GROUP BY chunk_id)"


@query("pipeline_hybrid_rrf", _RRF + " SELECT chunk_id, routes, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, first, chunk_id LIMIT 10")
def rrf(spark, sf_dir):
    top = ranking.best(ranking.rrf(ranking.recall(_routes(spark, sf_dir))), 10)
    return top.select("chunk_id", F.array_join("routes", ",").alias("routes"), F.round("score", 6).alias("score"))


@query("R14_weighted_fusion", _RECALLED + """, m AS (SELECT *, min(score) OVER (PARTITION BY route) AS lo, max(score) OVER (PARTITION BY route) AS hi FROM u),
fused AS (SELECT chunk_id, round(sum((CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END) * CASE route WHEN 'bm25_sparse' THEN 0.7 ELSE 1.0 END), 6) AS score FROM m GROUP BY chunk_id) SELECT chunk_id, score FROM fused""")
def weighted(spark, sf_dir):
    return ranking.weighted(ranking.recall(_routes(spark, sf_dir)), {"bm25_sparse": 0.7}).select("chunk_id", F.round("score", 6).alias("score"))


@query("R24_route_stats", _RRF + """, top AS (SELECT * FROM fused ORDER BY score DESC, first, chunk_id LIMIT 10), n AS (SELECT unnest(string_split(routes, ',')) AS route FROM top),
p(route) AS (VALUES ('exact_match'), ('bm25_sparse'), ('qa_dense'))
SELECT p.route, (SELECT count(*) FROM u WHERE u.route = p.route) AS recalled, (SELECT count(*) FROM u WHERE u.route = p.route) AS aligned, (SELECT count(*) FROM n WHERE n.route = p.route) AS final FROM p""")
def route_stats(spark, sf_dir):
    rows = ranking.recall(_routes(spark, sf_dir))
    plan = spark.sql("SELECT explode(array('exact_match', 'bm25_sparse', 'qa_dense')) AS route")
    return ranking.route_stats(plan, rows, rows, ranking.best(ranking.rrf(rows), 10))


@query("R20_rerank", _RRF + """, top AS (SELECT * FROM fused ORDER BY score DESC, first, chunk_id LIMIT 20)
SELECT chunk_id, round(top.score, 6) AS fused, round((contains(lower(text), 'therea')::INT + contains(lower(text), 'thinor')::INT + contains(lower(text), 'einen')::INT) / 3.0, 6) AS score
FROM top JOIN documents ON doc_id = chunk_id ORDER BY 3 DESC, top.score DESC, chunk_id LIMIT 8""")
def rerank(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    out = ranking.rerank(ranking.rrf(ranking.recall(_routes(spark, sf_dir))), texts, TERMS, 20, 8)
    return out.select("chunk_id", F.round("fused", 6).alias("fused"), F.round("score", 6).alias("score"))


@query("R9_align_sections", """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), h AS (SELECT label AS section, max(list_cosine_similarity(embedding::DOUBLE[], v)) AS score FROM embeddings, q GROUP BY label),
c AS (SELECT label AS section, vec_id, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id) AS sub FROM embeddings, q)
SELECT section, vec_id, round(score * 0.9, 6) AS score, row_number() OVER (ORDER BY score DESC, section, sub)::INTEGER AS rank FROM h JOIN c USING (section) WHERE sub <= 5""")
def align(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    q = vector.literal(rows.filter("vec_id = 7").select("embedding").first()[0])
    scored = rows.select(F.col("label").alias("section"), "vec_id", "embedding")
    hits = scored.withColumn("score", vector.cosine(F.col("embedding"), q)).groupBy("section").agg(F.max("score").alias("score"))  # a row for each label
    hits = hits.withColumn("route", F.lit("section_dense")).withColumn("rank", F.row_number().over(Window.partitionBy("route").orderBy(F.desc("score"), "section")))
    near = vector.rerank_by_vector(scored.select("section", "vec_id"), scored, q, 5, "section", "vec_id").select("section", "vec_id", F.col("rank").alias("sub_rank"))
    out = ranking.rerank_positions(ranking.expand(hits, near, "section", ranking.SECTION_SHARE))
    return out.select("section", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


QA = "SELECT * FROM VALUES ('qa:1', 1, 0.95D, ' yes ', array('a', 'a', '', 'b')), ('qa:2', 2, 0.95D, 'no', array('c')), ('qa:3', 3, 0.5D, 'low', array('d')), ('qa:4', 4, 0.9D, ' ', array('e')) AS t(chunk_id, rank, score, answer, source_chunk_ids)"


@query("R16_R19_qa_pin", "SELECT * FROM (VALUES (0, 'a', 0.95::DOUBLE, 'shown'), (1, 'b', 0.95::DOUBLE, 'found')) t(ord, chunk_id, score, text)")
def qa_pin(spark, sf_dir):
    chunks = spark.sql("SELECT * FROM VALUES ('a', 'shown', 'x'), ('b', ' ', 'found'), ('c', '', '') AS t(chunk_id, display_text, search_text)")
    return ranking.hydrate(ranking.pin(spark.sql(QA)), chunks)


@query("R18_without_pinned", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def without_pinned(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return ranking.without(table(spark, sf_dir, "customer"), gone, "c_custkey").select("c_custkey")


@query("R26_engine_retrieve", _RRF + """, top AS (SELECT * FROM fused ORDER BY score DESC, first, chunk_id LIMIT 50)
SELECT chunk_id, round((contains(lower(text), 'therea')::INT + contains(lower(text), 'thinor')::INT) / 2.0, 6) AS score FROM top JOIN documents ON doc_id = chunk_id
ORDER BY 2 DESC, top.score DESC, chunk_id LIMIT 10""")
def engine(spark, sf_dir):
    e = Engine()
    for name, df in _routes(spark, sf_dir).items():
        e.register(name, lambda q, k, params, df=df: df.orderBy(F.desc("score"), "chunk_id").limit(k))
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    plan = Plan([Route("exact_match", 30), Route("bm25_sparse", 30), Route("unknown", 5)])
    return e.retrieve("therea thinor", texts, plan, top_k=10).select("chunk_id", F.round("score", 6).alias("score"))
