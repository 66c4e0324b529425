"""Queries over lexical, dense and sparse retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import lexical, vector
from cairn.registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumnRenamed("text", "search_text")


def _grep(name: str, keyword: str, mode: str, condition: str):
    @query(name, f"SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE {condition}")
    def run(spark, sf_dir):
        return lexical.grep(_docs(spark, sf_dir), [keyword], mode, top_k=None, key="doc_id").select("doc_id", "score")

    return run


_grep("L4_grep_fuzzy", "THEREA", "fuzzy", "contains(lower(text), 'therea')")
_grep("L2_grep_prefix", "the", "prefix", "starts_with(lower(text), 'the')")
_grep("L3_grep_regex", r"\+1 \(\d{3}\) 555", "regex", r"regexp_matches(text, '\+1 \(\d{3}\) 555', 'i')")
_grep("L1_grep_exact", "nothing but this", "exact", "lower(text) = 'nothing but this'")


@query("L5_grep_limited", "SELECT doc_id, 1.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'apache') ORDER BY doc_id LIMIT 10")
def grep_limited(spark, sf_dir):
    return lexical.grep(_docs(spark, sf_dir), ["idiot", "Apache"], key="doc_id").select("doc_id", "score")


@query("L6_L9_boolean", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'that') OR contains(lower(text), 'die')) AND NOT contains(lower(text), 'with') ORDER BY doc_id LIMIT 30")
def boolean(spark, sf_dir):
    return lexical.boolean_search(_docs(spark, sf_dir), "(that OR 'die') AND NOT \"With\"", top_k=30, key="doc_id").select("doc_id")


@query("L12_snippet", """
WITH h AS (SELECT doc_id, text, strpos(lower(text), 'license') AS pos FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 20)
SELECT doc_id, (CASE WHEN greatest(pos - 40, 1) > 1 THEN '...' ELSE '' END) || substr(text, greatest(pos - 40, 1), pos - greatest(pos - 40, 1)) || '>>>' || substr(text, pos, 7) || '<<<' || substr(text, pos + 7, 40) || (CASE WHEN pos + 47 <= length(text) THEN '...' ELSE '' END) AS snippet FROM h""")
def snippet(spark, sf_dir):
    return lexical.grep_chunks(_docs(spark, sf_dir), "license", top_k=20, context=40, key="doc_id").select("doc_id", "snippet")


def _query_vector(spark, sf_dir, vec_id: int):
    """The stored vector of one id, as a literal."""
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]


def _topk_sql(where: str = "true", threshold: str = "-2") -> str:
    return f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q WHERE {where} ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 20) SELECT * FROM s WHERE score >= {threshold}"""


@query("V1_vector_topk", _topk_sql())
def vector_topk(spark, sf_dir):
    best = vector.vector_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 7), 20, "vec_id")
    return best.select("vec_id", F.round("score", 6).alias("score"))


@query("V3_vector_filtered", _topk_sql("label = 3"))
def vector_filtered(spark, sf_dir):
    best = vector.vector_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 7), 20, "vec_id", where=F.col("label") == 3)
    return best.select("vec_id", F.round("score", 6).alias("score"))


@query("F4_vector_threshold", _topk_sql(threshold="0.3"))
def vector_threshold(spark, sf_dir):
    best = vector.vector_topk(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir, 7), 20, "vec_id", threshold=0.3)
    return best.select("vec_id", F.round("score", 6).alias("score"))


_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
BM25 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
t AS (SELECT doc_id, len(w) AS length, unnest(list_filter(w, lambda x: x IN ('therea', 'thinor', 'einen'))) AS term FROM d),
f AS (SELECT doc_id, length, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
r AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score FROM f JOIN df USING (term), s GROUP BY doc_id)"""


@query("V10_sparse_topk", BM25 + " SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 20")
def sparse_topk(spark, sf_dir):
    best = vector.sparse_topk(table(spark, sf_dir, "documents"), ["therea", "thinor", "einen"], 20, "doc_id", "text")
    return best.select("doc_id", F.round("score", 6).alias("score"))


@query("V2_sparse_map", "SELECT l_orderkey * 10 + l_linenumber AS id, round(0.5 * l_quantity + 2.0 * l_tax, 6) AS score FROM lineitem ORDER BY 0.5 * l_quantity::FLOAT + 2.0 * l_tax::FLOAT DESC, 1 LIMIT 15")
def sparse_map(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), vector.sparse_map(F.array(F.lit(1), F.lit(2)), F.array("l_quantity", "l_tax")).alias("w"))
    return vector.sparse_product(rows, "id", "w", {1: 0.5, 2: 2.0}, 15).select("id", F.round("score", 6).alias("score"))


@query("V13_rerank_by_vector", """
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 7), s AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) SELECT label, vec_id, rank::INTEGER AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def rerank_by_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    best = vector.rerank_by_vector(rows.select("label", "vec_id"), rows, vector.literal(_query_vector(spark, sf_dir, 7)), 5, "label", "vec_id")
    return best.select("label", "vec_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))
