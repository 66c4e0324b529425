"""Dense and sparse retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BM25_K1, BM25_B = 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a missing or a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, F.coalesce(dot(a, b) / norms, F.lit(0.0))).otherwise(0.0)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def vector_topk(df: DataFrame, query: Sequence[float] | Column, k: int, key: str, vector: str = "embedding", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """V1, V3: filter, cosine, the k best with ties to the smaller key, and only then the threshold.

    One scan without a shuffle: each task keeps its k best, and k rows a task are merged.
    """
    q = query if isinstance(query, Column) else literal(query)
    scored = (df.filter(where) if where is not None else df).withColumn("score", cosine(F.col(vector), q))
    best = scored.orderBy(F.desc("score"), key).limit(k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def rerank_by_vector(candidates: DataFrame, vectors: DataFrame, query: Column, n: int, group: str, key: str, vector: str = "embedding") -> DataFrame:
    """The n best candidates of each group by cosine; one without a vector scores 0."""
    met = candidates.join(vectors.select(key, vector), key, "left").withColumn("score", cosine(F.col(vector), query))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), key))
    return met.withColumn("rank", rank).filter(F.col("rank") <= n).drop(vector)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, length): lower-case runs of letters and digits of ASCII, and all other letters."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")
    rows = docs.select(key, F.transform(F.array(terms), lambda t: F.struct(t.alias("t"), F.size(t).alias("n")))[0].alias("x")).select(key, F.explode("x.t").alias("term"), F.col("x.n").alias("length"))
    return rows.groupBy(key, "term", "length").agg(F.count(F.lit(1)).alias("tf"))


def sparse_topk(docs: DataFrame, terms: Sequence[str], k: int, key: str, text: str, threshold: float | None = None) -> DataFrame:
    """Inner product of BM25 weights, keyed by the term itself, with a query that weighs each term 1.

    Only the query's terms leave the scan; corpus counts come from all documents. Scores are rounded to 9 places before
    they are ranked, so that ties don't hang on the order of a sum.
    """
    terms = list(dict.fromkeys(terms))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda t: t != "")
    sized = docs.select(key, words.alias("w")).select(key, F.size("w").alias("length"), F.filter("w", lambda t: t.isin(terms)).alias("w"))
    held = [F.count_if(F.array_contains("w", t)).alias(f"df{i}") for i, t in enumerate(terms)]
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *held)  # one row
    met = sized.filter(F.size("w") > 0).crossJoin(F.broadcast(stats))
    times = lambda t: F.size(F.filter("w", lambda x: x == t))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        tf = times(t)
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))
    best = met.groupBy(key).agg(F.round(F.sum(score), 9).alias("score")).orderBy(F.desc("score"), key).limit(k)
    return best if threshold is None else best.filter(F.col("score") >= threshold)


def sparse_product(rows: DataFrame, key: str, weights: str, query: dict[int, float], k: int) -> DataFrame:
    """V2 for stored map<int, float> vectors."""
    q = F.create_map(*[x for d, w in query.items() for x in (F.lit(int(d)), F.lit(float(w)))])
    shared = F.filter(F.map_keys(weights), lambda d: d.isin([int(d) for d in query]))
    score = F.aggregate(shared, F.lit(0.0), lambda s, d: s + F.element_at(F.col(weights), d).cast("double") * F.element_at(q, d))
    return rows.filter(F.size(shared) > 0).select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(k)


def sparse_map(indices: Column, values: Column) -> Column:
    """X19."""
    return F.map_from_arrays(indices.cast("array<int>"), values.cast("array<float>"))


def enrich_hits(hits: DataFrame, details: DataFrame, key: str) -> DataFrame:
    """V9: hits without details stay."""
    return hits.join(details, key, "left")
