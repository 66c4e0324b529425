"""Queries over the containment hierarchy customer > orders > lineitem and region > nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import navigation as N
from cairn.registry import query, table


def _sections(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("section_id"), F.col("o_orderdate").alias("at"))


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), F.col("l_linenumber").alias("seq"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_partkey").alias("element_id"))


@query("N1_document_sections", """
WITH s AS (SELECT o_custkey AS document_id, o_orderkey AS section_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT l_orderkey AS section_id, count(*) AS k FROM lineitem GROUP BY 1)
SELECT document_id, section_id, rn::INTEGER AS rn, round(1 - (rn - 1) / n, 6) AS score, coalesce(k, 0) AS chunk_count FROM s LEFT JOIN c USING (section_id)""")
def document_sections(spark, sf_dir):
    return _document_sections(spark, sf_dir, table(spark, sf_dir, "customer"))


def _document_sections(spark, sf_dir, customers):
    docs = customers.select(F.col("c_custkey").alias("document_id"))
    rows = N.sections_of(docs, _sections(spark, sf_dir), _chunks(spark, sf_dir), ["at"])
    return rows.select("document_id", "section_id", F.col("rn").cast("int").alias("rn"), F.round("score", 6).alias("score"), "chunk_count")


@query("N2_document_chunks", """
WITH c AS (SELECT o_custkey AS document_id, l_orderkey * 10 + l_linenumber AS chunk_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT c_custkey FROM customer) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber))
SELECT document_id, chunk_id, rn::INTEGER AS rn, round(1 - (rn - 1) / n, 6) AS score FROM c""")
def document_chunks(spark, sf_dir):
    return _document_chunks(spark, sf_dir, table(spark, sf_dir, "customer"))


def _document_chunks(spark, sf_dir, customers):
    docs = customers.select(F.col("c_custkey").alias("document_id"))
    rows = _chunks(spark, sf_dir).join(_sections(spark, sf_dir), "section_id")
    return N.children_of(docs, rows, "document_id", ["at", "section_id", "seq"], "chunk_id").select("document_id", "chunk_id", F.col("rn").cast("int").alias("rn"), F.round("score", 6).alias("score"))


@query("N4_section_chunks", """
WITH c AS (SELECT l_orderkey AS section_id, l_orderkey * 10 + l_linenumber AS chunk_id, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_orderkey * 10 + l_linenumber))
SELECT section_id, chunk_id, rn::INTEGER AS rn, round(1 - (rn - 1) / n, 6) AS score FROM c""")
def section_chunks(spark, sf_dir):
    own = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("section_id"))
    return N.children_of(own, _chunks(spark, sf_dir), "section_id", ["seq"], "chunk_id").select("section_id", "chunk_id", F.col("rn").cast("int").alias("rn"), F.round("score", 6).alias("score"))


@query("N5_section_elements", """
WITH e AS (SELECT DISTINCT l_orderkey AS section_id, l_partkey AS element_id FROM lineitem)
SELECT section_id, element_id, row_number() OVER (PARTITION BY section_id ORDER BY p_size, p_partkey)::INTEGER AS rn FROM e JOIN part ON p_partkey = element_id WHERE p_size > 10""")
def section_elements(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).select("section_id", F.array("element_id", "element_id").alias("element_ids"))
    elements = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("element_id"), F.when(F.col("p_size") > 10, "text").otherwise("image").alias("element_type"), F.col("p_size").alias("page_index"), F.col("p_partkey").alias("element_index"))
    return N.elements_of(chunks, elements, "section_id", ["text"]).select("section_id", "element_id", F.col("rn").cast("int").alias("rn"))


@query("N8_N13_roll_up", "SELECT DISTINCT o_custkey AS document_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (1, 2, 3))")
def roll_up(spark, sf_dir):
    anchors = table(spark, sf_dir, "part").filter("p_partkey IN (1, 2, 3)").select(F.col("p_partkey").alias("element_id"))
    sections = N.rolled_up(anchors, _chunks(spark, sf_dir), "element_id", "section_id")
    return N.rolled_up(sections, _sections(spark, sf_dir), "section_id", "document_id")


@query("N15_context_window", """
WITH r AS (SELECT l_orderkey AS section_id, l_orderkey * 10 + l_linenumber AS chunk_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem)
SELECT a.chunk_id AS anchor, b.chunk_id, round(1 - abs(b.rn - a.rn) / 3.0, 6) AS score FROM r a JOIN r b ON a.section_id = b.section_id AND abs(b.rn - a.rn) BETWEEN 1 AND 2""")
def context_window(spark, sf_dir):
    rows = _chunks(spark, sf_dir)
    return N.context_window(rows, rows, "section_id", ["seq"], "chunk_id", 2).select("anchor", "chunk_id", F.round("score", 6).alias("score"))


#: A tree with an unknown parent, a null one, and a depth over the limit.
NODES = "VALUES (1, NULL), (2, 1), (3, 2), (4, 3), (5, 4), (6, 99), (7, 6), (8, NULL)"


@query("N16_outline", f"""
WITH RECURSIVE n(section_id, parent_id) AS ({NODES}), t AS (SELECT section_id, 0 AS depth, section_id::VARCHAR AS path FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT section_id FROM n)
UNION ALL SELECT n.section_id, depth + 1, path || '/' || n.section_id FROM n JOIN t ON n.parent_id = t.section_id WHERE depth < 3) SELECT section_id, depth, path FROM t""")
def outline(spark, sf_dir):
    return N.outline(spark.sql(f"SELECT * FROM {NODES} AS t(section_id, parent_id)"))


@query("N16_region_outline", "SELECT 'r' || r_regionkey AS id, 0 AS depth, 'r' || r_regionkey AS path FROM region UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey || '/n' || n_nationkey FROM nation")
def region_outline(spark, sf_dir):
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    rest = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    return N.outline(top.union(rest), "id", "parent", 2)


@query("N19_descendants", "SELECT * FROM (VALUES (2), (3), (4), (5)) t(section_id)")
def descendants(spark, sf_dir):
    return N.descendants(spark.sql(f"SELECT * FROM {NODES} AS t(section_id, parent_id)"), 1, "section_id", "parent_id")


@query("N14_document_result", "SELECT o_custkey AS document_id, count(*) AS sections FROM orders GROUP BY 1")
def document_result(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("document_id").agg(F.count(F.lit(1)).alias("sections"))


@query("N20_outline_text", "SELECT n_nationkey, '  - ' || n_name AS line FROM nation")
def outline_text(spark, sf_dir):
    return table(spark, sf_dir, "nation").withColumn("depth", F.lit(1)).select("n_nationkey", N.outline_text(None, "n_name").alias("line"))
