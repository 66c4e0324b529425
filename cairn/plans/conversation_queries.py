"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import conversation as C
from cairn.registry import query, table

_TURNS = "t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS turn_no FROM conversations)"
_TOKENS = r"CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) / 1.6) + floor((length(text) - len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]'))) / 4)) END"


@query("C1_history_window", f"""WITH {_TURNS}, m AS (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS last, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS sys FROM t)
SELECT conv_id, turn, role FROM m WHERE (turn_no > last - 2 AND turn_no > 0) OR last = 0 OR turn = sys""")
def history_window(spark, sf_dir):
    return C.last_turns(table(spark, sf_dir, "conversations"), 2).select("conv_id", "turn", "role")


@query("C4_token_window", f"""WITH {_TURNS}, g AS (SELECT conv_id, turn_no, sum({_TOKENS}) AS n FROM t GROUP BY 1, 2), s AS (SELECT conv_id, turn_no, sum(n) OVER w AS upto, row_number() OVER w AS i FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn_no DESC))
SELECT t.conv_id, t.turn FROM t JOIN s USING (conv_id, turn_no) WHERE upto <= 300 OR i <= 1""")
def token_window(spark, sf_dir):
    return C.token_window(table(spark, sf_dir, "conversations"), 300).select("conv_id", "turn")


@query("C7_budget", f"WITH x AS (SELECT conv_id, sum({_TOKENS})::BIGINT AS used FROM conversations GROUP BY 1) SELECT conv_id, used, used > 400 * 0.8 AS over FROM x")
def budget(spark, sf_dir):
    return C.budget(table(spark, sf_dir, "conversations"), 500, 100).select("conv_id", "used", "over")


@query("C12_aliases", """WITH s AS (SELECT conv_id, left(text, 3) AS chunk_id, min(turn) AS first_at FROM conversations GROUP BY 1, 2)
SELECT conv_id, chunk_id, 'c' || row_number() OVER (PARTITION BY conv_id ORDER BY first_at, chunk_id) AS alias FROM s""")
def aliases(spark, sf_dir):
    seen = table(spark, sf_dir, "conversations").select("conv_id", F.left("text", F.lit(3)).alias("chunk_id"), "turn")
    return C.assign_aliases(seen, "conv_id", "chunk_id", "turn").select("conv_id", "chunk_id", "alias")


@query("C19_reference_budget", """WITH x AS (SELECT conv_id, turn, left(text, 200) AS text FROM conversations), s AS (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM x) SELECT conv_id, turn, text FROM s WHERE upto <= 600""")
def reference_budget(spark, sf_dir):
    return C.within_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", item=200, total=600).select("conv_id", "turn", "text")


@query("C20_recent_messages", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INTEGER AS position FROM r WHERE rn <= 3")
def recent(spark, sf_dir):
    return C.recent(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", F.col("position").cast("int").alias("position"))


@query("C21_C23_sessions", "SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS turns, max_by(text, turn) FILTER (WHERE role = 'assistant') AS last_assistant FROM conversations GROUP BY 1")
def sessions(spark, sf_dir):
    return C.sessions(table(spark, sf_dir, "conversations"))


@query("C5_compress", f"WITH {_TURNS}, m AS (SELECT *, max(turn_no) OVER (PARTITION BY conv_id) AS last FROM t) SELECT conv_id, string_agg(left(text, 50), chr(10) ORDER BY turn) AS summary FROM m WHERE turn_no <= last - 1 GROUP BY 1")
def compress(spark, sf_dir):
    return C.compress(table(spark, sf_dir, "conversations"), 1, 50)


TOOLS = "SELECT * FROM VALUES ('s', 1, 'user', 'q', CAST(array() AS array<struct<id:string>>), CAST(NULL AS string)), ('s', 2, 'assistant', '', array(named_struct('id', 'k1')), NULL), ('s', 3, 'tool', 'out', array(), 'k1'), ('s', 4, 'tool', 'lost', array(), 'k9'), ('s', 5, 'assistant', 'see [c2] and [C1]', array(), NULL) AS t(session_id, seq, role, content, tool_calls, tool_call_id)"


@query("C2_orphan_tools", "SELECT * FROM (VALUES (1), (2), (3), (5)) t(seq)")
def orphan_tools(spark, sf_dir):
    return C.drop_orphan_tools(spark.sql(TOOLS)).select("seq")


@query("C13_C14_citations", "SELECT * FROM (VALUES ('c1', 'x'), ('c2', 'y')) t(alias, chunk_id)")
def citations(spark, sf_dir):
    rows = spark.sql("SELECT * FROM VALUES ('s', 'c1', 'x'), ('s', 'c2', 'y'), ('s', 'c3', 'z') AS t(session_id, alias, chunk_id)")
    return C.cited(rows, spark.sql(TOOLS).select("session_id", "content")).select("alias", "chunk_id")
