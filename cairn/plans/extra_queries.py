"""Queries of the catalog's, the index's and the conversation's remaining operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import catalog, conversation, ingest, navigation, ranking
from cairn.plans import routes
from cairn.registry import query, table
from cairn.streaming import sinks

# customers are documents, orders their sections (a binary heap by rank), line items chunks
_SECTIONS = "s AS (SELECT o_custkey AS document_id, o_orderkey AS section_id, rank, p.parent AS parent_id, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) o LEFT JOIN (SELECT o_custkey AS c, o_orderkey AS parent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) p ON c = o_custkey AND r = rank // 2)"


def _sections(spark, sf_dir):
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("section_id"), rank.alias("rank"), "o_totalprice")
    up = rows.select(F.col("document_id").alias("__d"), F.col("section_id").alias("parent_id"), F.col("rank").alias("__r"))
    on = (F.col("document_id") == F.col("__d")) & (F.floor(F.col("rank") / 2) == F.col("__r"))
    return rows.join(up, on, "left").select("document_id", "section_id", "rank", "parent_id", "o_totalprice")


@query("N16_skeleton", f"WITH {_SECTIONS} SELECT document_id, section_id, (floor(log2(rank))::INTEGER % 3 + 1)::INTEGER AS depth, CASE WHEN floor(log2(rank))::INTEGER % 3 > 0 THEN parent_id END AS parent_id FROM s")
def skeleton(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumnRenamed("rank", "ord")
    return navigation.skeleton(rows).select("document_id", "section_id", "depth", "parent_id")


@query("N17_section_order", "WITH f AS (SELECT l_orderkey, min(l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity <= 40 GROUP BY 1) SELECT o_orderkey AS section_id, coalesce(n, 0)::INTEGER AS ord FROM orders LEFT JOIN f ON l_orderkey = o_orderkey")
def section_order(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    element = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("element_id")
    links = lines.select(F.col("l_orderkey").alias("section_id"), element, (F.col("l_returnflag") == "R").alias("deleted"))
    elements = lines.select(element, F.col("l_linenumber").alias("ord"), (F.col("l_quantity") > 40).alias("deleted")).dropDuplicates(["element_id"])
    return navigation.section_order(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("section_id")), links, elements)


@query("T30_T37_leaves", f"WITH {_SECTIONS} SELECT section_id FROM s WHERE section_id NOT IN (SELECT parent_id FROM s WHERE parent_id IS NOT NULL)")
def leaves(spark, sf_dir):
    return ingest.leaf_sections(_sections(spark, sf_dir)).select("section_id")


@query("T31_summary_inputs", f"WITH {_SECTIONS}, m AS (SELECT * FROM s WHERE rank % 4 <> 0) SELECT document_id, section_id, row_number() OVER (PARTITION BY document_id ORDER BY rank % 2 DESC, rank)::INTEGER AS nth FROM m")
def summary_inputs(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumn("summary", F.when(F.col("rank") % 4 == 0, " ").otherwise("s")).withColumn("is_leaf", F.col("rank") % 2 == 1)
    return ingest.summary_inputs(rows.withColumnRenamed("rank", "ord")).select("document_id", "section_id", "nth")


@query("T32_leaf_chunks", f"WITH {_SECTIONS}, n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT document_id, sum(CASE WHEN rank % 2 = 1 THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS chunks FROM s LEFT JOIN n ON l_orderkey = section_id GROUP BY 1")
def leaf_chunks(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("section_id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    return ingest.leaf_chunks(_sections(spark, sf_dir).withColumn("is_leaf", F.col("rank") % 2 == 1).join(n, "section_id", "left").fillna(0, ["n_chunks"]))


@query("T40_tree_diagnosis", f"WITH {_SECTIONS}, t AS (SELECT document_id, section_id, rank, CASE WHEN rank % 5 = 0 THEN -1 ELSE parent_id END AS p FROM s) SELECT a.document_id, count(*) AS sections, count(*) FILTER (a.p IS NULL) AS roots, count(*) FILTER (a.p = -1) AS orphans, count(*) FILTER ((a.rank % 3 = 0) <> (a.section_id NOT IN (SELECT p FROM t WHERE p IS NOT NULL))) AS wrong_leaves FROM t a GROUP BY 1")
def tree_diagnosis(spark, sf_dir):
    rows = _sections(spark, sf_dir).withColumn("parent_id", F.when(F.col("rank") % 5 == 0, -1).otherwise(F.col("parent_id"))).withColumn("is_leaf", F.col("rank") % 3 == 0)
    return ingest.tree_diagnosis(rows)


@query("T21_totals", "SELECT p_size AS document_id, sum(length(p_name))::BIGINT AS characters, 'en' AS language FROM part WHERE p_partkey % 3 <> 2 GROUP BY 1")
def totals(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return ingest.document_totals(table(spark, sf_dir, "part").select(F.col("p_size").alias("document_id"), kind.alias("chunk_type"), F.col("p_name").alias("text")))


_KIND = "['text', 'table', 'image'][p_partkey % 3 + 1]"


@query("T18_T39_search_text", f"""SELECT p_partkey, CASE {_KIND} WHEN 'text' THEN p_name WHEN 'table' THEN 'table_caption: ' || p_name || chr(10) || 'table_body: ' || p_type || ' | ' || p_size WHEN 'image' THEN p_name END AS search_text,
 CASE {_KIND} WHEN 'text' THEN p_name WHEN 'table' THEN 'table_caption: ' || p_name || chr(10) || 'table_body: <tr><td>' || p_type || '</td><td>' || p_size || '</td></tr>' WHEN 'image' THEN p_name END AS display_text, p_brand || chr(10) || p_name AS enhanced FROM part""")
def search_text(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("text"), F.lit("table"), F.lit("image")), (F.col("p_partkey") % 3 + 1).cast("int"))
    body = F.concat(F.lit("<tr><td>"), "p_type", F.lit("</td><td>"), "p_size", F.lit("</td></tr>"))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", kind.alias("chunk_type"), F.col("p_name").alias("text"), F.col("p_name").alias("caption"), body.alias("body"), F.lit(" ").alias("footnote"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("page"), F.lit("").alias("search_text"))
    texts = T.chunk_texts(*(F.col(c) for c in ("chunk_type", "text", "caption", "body", "footnote", "section", "page")))
    return ingest.filled_search_text(rows).select("p_partkey", "search_text", texts["display"].alias("display_text"), T.enhanced_text(F.col("p_brand"), F.col("text")).alias("enhanced"))


@query("X10_substituted", "SELECT event_id, 'see c1 and c2, not c9' AS shown FROM events")
def substituted(spark, sf_dir):
    one, two = F.concat(F.lit("chunk-"), "event_id"), F.concat(F.lit("chunk-"), "event_id", F.lit("0"))
    pair = lambda i, a: F.struct(i.alias("id"), F.lit(a).alias("alias"))
    shown = T.substitute_ids(F.concat(F.lit("see "), one, F.lit(" and "), two, F.lit(", not c9")), F.array(pair(one, "c1"), pair(two, "c2")))
    return table(spark, sf_dir, "events").select("event_id", shown.alias("shown"))


@query("X12_X13_resolved", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber <= 3 THEN 'id' || l_linenumber || ',' ELSE '' END) || 'x' || l_partkey AS ids, CASE WHEN l_linenumber > 3 THEN 'c' || l_linenumber ELSE '' END AS unresolved FROM lineitem")
def resolved(spark, sf_dir):
    alias = F.concat(F.lit("c"), "l_linenumber")
    names = F.array(alias, F.lit(" "), F.concat(F.lit(" x"), "l_partkey"), alias)
    known = F.array(*(F.struct(F.lit(f"c{i}").alias("alias"), F.lit(f"id{i}").alias("id")) for i in (1, 2, 3)))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.resolve_aliases(names, known).alias("r"))
    return out.select("l_orderkey", "l_linenumber", F.array_join("r.ids", ",").alias("ids"), F.array_join("r.unresolved", ",").alias("unresolved"))


@query("C3_history_tokens", r"""
WITH c AS (SELECT conv_id, length(text) AS n, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS cjk FROM conversations), t AS (SELECT conv_id, sum(CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE greatest(1, floor(cjk / 1.6) + floor((n - cjk) / 4)) END)::BIGINT AS tokens FROM c GROUP BY 1)
SELECT conv_id, tokens, floor(tokens * 1.2)::BIGINT AS cautious FROM t""")
def history_tokens(spark, sf_dir):
    return conversation.message_tokens(table(spark, sf_dir, "conversations"))


@query("C10_C11_composed", """
WITH m AS (SELECT conv_id, 1 AS part, turn AS pos_in, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT DISTINCT conv_id, 0, 0, 'system', 'be brief' FROM conversations UNION ALL SELECT DISTINCT conv_id, 2, 0, 'user', 'and ' || conv_id FROM conversations)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY part, pos_in) - 1)::INTEGER AS pos, role, text FROM m""")
def composed(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    asked = rows.select("conv_id").distinct().withColumn("text", F.concat(F.lit("and "), "conv_id"))
    return conversation.composed(conversation.history_messages(rows), "be brief", asked).select("conv_id", "pos", "role", "text")


def _folders(spark, sf_dir):
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("folder_id"), F.concat(F.lit("/r"), "r_regionkey").alias("full_path"), F.lit(0).alias("deleted"), F.lit(0).alias("user_id"), F.lit(0).alias("knowledge_base_id"))
    rest = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("folder_id"), F.concat(F.lit("/r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("full_path"), (F.col("n_nationkey") % 2).alias("deleted"), (F.col("n_nationkey") % 3).alias("user_id"), F.lit(0).alias("knowledge_base_id"))
    return top.unionByName(rest)


def _files(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("n"), "c_nationkey").alias("folder_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") % 100).alias("document_id"), (F.col("c_custkey") % 3).cast("int").alias("deleted"), (F.col("c_nationkey") % 3).alias("user_id"), F.lit(0).alias("knowledge_base_id"))


@query("C16_folder_documents", "SELECT DISTINCT c_custkey % 100 AS document_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 AND c_custkey % 4 <> 0")
def folder_documents(spark, sf_dir):
    return conversation.folder_documents(_folders(spark, sf_dir), _files(spark, sf_dir), "r2")


@query("C17_file_document", "SELECT 5::BIGINT AS document_id")
def file_document(spark, sf_dir):
    return conversation.file_documents(_files(spark, sf_dir), 105, 0)


@query("C18_mentions", "WITH f AS (SELECT user_id AS session_id, event_type AS kind, min(event_id) AS first_at FROM events WHERE event_type <> 'error' GROUP BY 1, 2) SELECT session_id, kind, upper(kind) AS name, (row_number() OVER (PARTITION BY session_id ORDER BY first_at) - 1)::INTEGER AS pos FROM f")
def mentions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), F.lit(1).alias("id"), F.col("event_id").alias("pos"))
    known = rows.filter("kind <> 'error'").select("kind", "id").distinct().withColumn("name", F.upper("kind"))
    return conversation.mentions_resolved(rows, known).select("session_id", "kind", "name", "pos")


@query("W9_cascade_files", "SELECT c_custkey AS file_id, CASE WHEN n_regionkey = 1 AND c_custkey % 3 = 0 THEN 2 ELSE c_custkey % 3 END::INTEGER AS deleted FROM customer JOIN nation ON n_nationkey = c_nationkey")
def cascade_files(spark, sf_dir):
    below = _folders(spark, sf_dir).filter(F.startswith("full_path", F.lit("/r1")))
    return catalog.cascade_files(_files(spark, sf_dir), below, "delete").select("file_id", "deleted")


@query("W9_purge_files", "SELECT c_custkey AS file_id FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE NOT (n_regionkey = 1 AND c_custkey % 3 <> 0)")
def purge_files(spark, sf_dir):
    below = _folders(spark, sf_dir).filter(F.startswith("full_path", F.lit("/r1")))
    return catalog.cascade_files(_files(spark, sf_dir), below, "purge").select("file_id")


@query("W13_Q50_move_files", """
WITH m AS (SELECT o_orderkey AS file_id, 'n' || o_custkey % 25 AS target_id, o_custkey % 25 AS t FROM orders), c AS (SELECT c_custkey, 'n' || c_nationkey AS was, c_nationkey % 3 AS u FROM customer WHERE c_custkey % 3 = 0)
SELECT file_id, CASE WHEN c_custkey IS NULL THEN 'no_file' WHEN t % 2 = 1 OR t % 3 <> u THEN 'no_folder' WHEN was = target_id THEN 'same' ELSE 'moved' END AS outcome, CASE WHEN c_custkey IS NULL OR t % 2 = 1 OR t % 3 <> u THEN was ELSE target_id END AS folder_id FROM m LEFT JOIN c ON c_custkey = file_id""")
def move_files(spark, sf_dir):
    moves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.concat(F.lit("n"), F.col("o_custkey") % 25).alias("target_id"))
    return catalog.move_files(_files(spark, sf_dir), moves, _folders(spark, sf_dir)).select("file_id", "outcome", "folder_id")


@query("Q14_touched_sessions", "WITH n AS (SELECT user_id, count(*) AS n, max(ts) AS last_at FROM events WHERE event_id % 2 = 0 GROUP BY 1), s AS (SELECT DISTINCT user_id FROM events) SELECT user_id AS session_id, 10 + coalesce(n, 0) AS message_count, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM s LEFT JOIN n USING (user_id)")
def touched_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").alias("at"))
    sessions = events.select("session_id").distinct().select("session_id", F.lit(10).cast("long").alias("message_count"), F.lit(None).cast("timestamp_ntz").alias("last_message_at"))
    out = catalog.touched_sessions(sessions, events.filter("event_id % 2 = 0"))
    return out.select("session_id", "message_count", F.date_format("last_message_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("Q2_Q8_rows_by_ids", "SELECT c_custkey AS file_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 3 = 0 ORDER BY 1 LIMIT 20 OFFSET 5")
def rows_by_ids(spark, sf_dir):
    return catalog.rows_by_ids(_files(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id")), "file_id", 20, 5).select("file_id")


_CHANGE = "CASE event_id % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'upsert' ELSE 'delete' END"


@query("K1_K2_applied", f"""
WITH l AS (SELECT user_id AS k, event_id, {_CHANGE} AS op, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events),
o AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS w FROM customer)
SELECT coalesce(o.k, l.k) AS k, CASE WHEN l.op IS NULL THEN v WHEN op = 'update' THEN coalesce(value, v) ELSE value END AS v, CASE WHEN op IN ('insert', 'upsert') THEN 'new' ELSE w END AS w
FROM o FULL JOIN (SELECT * FROM l WHERE r = 1) l ON o.k = l.k WHERE coalesce(op, '') <> 'delete' AND (o.k IS NOT NULL OR op IN ('insert', 'upsert'))""")
def applied(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, sinks.OPERATIONS)), (F.col("event_id") % 4 + 1).cast("int"))
    changes = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("operation"), F.col("value").alias("v"))
    changes = changes.withColumn("w", F.when(F.col("operation").isin("insert", "upsert"), F.lit("new")))
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("w"))
    return sinks.apply_changes(old, changes, ["k"])


@query("K3_vector_rows", "SELECT s_suppkey AS id, s_name AS text FROM supplier WHERE s_nationkey % 4 > 1")
def vector_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") % 4 != 1, F.col("s_suppkey")).alias("id"), F.when(F.col("s_nationkey") % 4 == 0, " ").otherwise(F.col("s_name")).alias("text"), "s_acctbal")
    return sinks.vector_rows(rows, "text", ["id"])[0]


@query("K4_merged_nodes", "SELECT DISTINCT l_returnflag AS type, l_linestatus AS name FROM lineitem WHERE l_returnflag <> 'R'")
def merged_nodes(spark, sf_dir):
    nodes = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("name"))
    return sinks.merged_nodes(nodes, nodes.filter("type = 'R'"))


@query("K36_fan_out", "WITH k(stage, kind, message) AS (VALUES " + ", ".join([f"('{s}', '{w}', 'write')" for s, (ws, _) in sinks.FAN_OUT.items() for w in ws] + [f"('{s}', '{n}', 'event')" for s, (_, n) in sinks.FAN_OUT.items() if n]) + ") SELECT event_id, message, kind FROM events JOIN k ON stage = CASE event_type WHEN 'view' THEN 'parse' WHEN 'click' THEN 'split' WHEN 'purchase' THEN 'analyze' ELSE 'other' END")
def fan_out(spark, sf_dir):
    stage = F.when(F.col("event_type") == "view", "parse").when(F.col("event_type") == "click", "split").when(F.col("event_type") == "purchase", "analyze").otherwise("other")
    events = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file_id"), stage.alias("stage"))
    return sinks.fan_out(events).select("event_id", "message", "kind")


@query("Q38_change_groups", f"SELECT event_type AS target, {_CHANGE} AS operation, count(*) AS n FROM events GROUP BY 1, 2")
def change_groups(spark, sf_dir):
    op = F.element_at(F.array(*map(F.lit, sinks.OPERATIONS)), (F.col("event_id") % 4 + 1).cast("int"))
    return sinks.groups(table(spark, sf_dir, "events").select(F.col("event_type").alias("target"), op.alias("operation")))


_HITS = "(SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'F') h"


@query("R9_R12_align_all", f"""
WITH h AS (SELECT * FROM {_HITS} WHERE rank <= 50),
f AS (SELECT o_custkey AS d, l_orderkey * 10 + l_linenumber AS chunk, row_number() OVER (PARTITION BY o_custkey ORDER BY nth, l_linenumber, l_orderkey * 10 + l_linenumber) AS sub FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nth FROM orders) JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey WHERE nth <= 5),
e AS (SELECT 'section_dense' AS route, rank, l_orderkey * 10 + l_linenumber AS chunk, o_totalprice * 0.9 AS score, row_number() OVER (PARTITION BY rank ORDER BY l_linenumber) AS sub FROM h JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey
 UNION ALL SELECT 'section_summary_dense', rank, chunk, o_totalprice * 0.7, sub FROM h JOIN f ON d = o_custkey
 UNION ALL SELECT 'chunk_dense', rank, o_orderkey * 10 + 1, o_totalprice, 1 FROM h)
SELECT route, chunk::VARCHAR AS chunk_id, round(score, 4) AS score, row_number() OVER (PARTITION BY route ORDER BY rank, sub)::INTEGER AS rank FROM e WHERE sub <= 5""")
def align_all(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("section_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_linenumber").alias("ord"), F.lit("").alias("text")).distinct()
    sections = orders.select(F.col("o_orderkey").alias("section_id"), F.col("o_custkey").alias("document_id"), F.struct("o_orderdate", "o_orderkey").alias("ord"))
    store = routes.Store(chunks.join(sections.select("section_id", "document_id"), "section_id"), sections)
    best = orders.filter("o_orderstatus = 'F'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("score"))
    found = {"chunk_dense": ranking.chunk_items(best.withColumn("c", F.col("key") * 10 + 1), "chunk", "c"), "section_dense": ranking.chunk_items(best, "section", "key"), "section_summary_dense": ranking.chunk_items(best, "summary", "key")}
    recalled = ranking.recall({name: rows.select("chunk_id", "score", "kind", "key") for name, rows in found.items()})
    return routes.align(recalled, store).select("route", "chunk_id", F.round("score", 4).alias("score"), "rank")
