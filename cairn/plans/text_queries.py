"""Queries over text functions and splitters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import numbering, split
from cairn.functions import text as T
from cairn.operators import catalog, filters, ingest
from cairn.registry import query, table

_STRIP = r"[\t\n\v\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_STRIP}+', ''), '{_STRIP}+\z', '')"


_T1 = r"regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{206F}]', '', 'g'), '\r\n?', chr(10), 'g')"
_T2 = rf"regexp_replace({_T1}, '[ \t\v\f\x{{A0}}\x{{3000}}]+', ' ', 'g')"
for _p in "!?,.:;":
    _T2 = rf"regexp_replace({_T2}, '[{_p}]+', '{_p}', 'g')"
_T2 = _strip(rf"regexp_replace({_T2}, '\n{{3,}}', chr(10) || chr(10), 'g')")
_T3 = rf"regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_T2}, chr(10)), lambda l: {_strip('l')}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+\z', '', 'g')"


@query("T1_T5_text_clean", f"SELECT doc_id, {_T3} AS cleaned FROM documents")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_all(F.col("text")).alias("cleaned"))


_COUNTS = ", ".join(f"len(regexp_extract_all(text, '{p}')) AS {n}" for n, p in [("kana", T.KANA), *T.SCRIPTS])


@query("T20_language", f"""
WITH c AS (SELECT doc_id, {_COUNTS} FROM documents), m AS (SELECT *, greatest(zh, ko, ru, ar, hi, th, en) AS most, kana + zh + ko + ru + ar + hi + th + en AS total FROM c)
SELECT doc_id, CASE WHEN kana >= 3 AND kana * 20 >= total THEN 'ja' WHEN most = 0 THEN 'en' WHEN zh = most THEN 'zh' WHEN ko = most THEN 'ko' WHEN ru = most THEN 'ru' WHEN ar = most THEN 'ar' WHEN hi = most THEN 'hi' WHEN th = most THEN 'th' ELSE 'en' END AS language FROM m""")
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query("X6_token_estimate", r"""
WITH c AS (SELECT conv_id, turn, length(text) AS n, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS cjk FROM conversations)
SELECT conv_id, turn, CASE WHEN n = 0 THEN 0 ELSE greatest(1, floor(cjk / 1.6) + floor((n - cjk) / 4)) END::BIGINT AS tokens FROM c""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("X8_truncate_middle", r"""SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 280) || chr(10) || '...[omitted]...' || chr(10) || right(text, 120) END AS shown FROM documents""")
def truncate_middle(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate_middle(F.col("text"), 400).alias("shown"))


@query("X9_fallback_title", rf"""SELECT doc_id, regexp_replace(left(replace({_strip('text')}, chr(10), ' '), 20), '[,.!?;:，。！？；： ]+\z', '') AS title FROM documents""")
def fallback_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fallback_title(F.col("text")).alias("title"))


@query("X17_error_type", "SELECT event_id, CASE WHEN length(split_part(props, chr(10), 1)) > 50 THEN left(split_part(props, chr(10), 1), 50) || '...' ELSE split_part(props, chr(10), 1) END AS error_type FROM events")
def error_type(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.error_type(F.col("props")).alias("error_type"))


@query("X18_backoff", "SELECT nation.n_nationkey, array_to_string(list_transform(range(0, n_nationkey % 7), lambda i: least(2.0 ** i, 20.0)::BIGINT), ',') AS delays FROM nation")
def backoff(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.array_join(F.transform(T.backoff(F.col("n_nationkey") % 7, 1.0, 20.0), lambda x: x.cast("long").cast("string")), ",").alias("delays"))


@query("T6_structure_first")
def structure_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.split_structure_first(F.regexp_replace("text", "\n", "\n\n"), 600, 60)).alias("seq", "chunk"))
    return rows


@query("T6_pack_lines", r"""
WITH RECURSIVE p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM documents WHERE doc_id < 1000000),
w AS (SELECT doc_id, lines, 1 AS i, 0 AS seq, '' AS held FROM p
 UNION ALL SELECT doc_id, lines, i + 1, CASE WHEN held = '' OR length(held) + length(lines[i]) + 2 <= 1500 THEN seq ELSE seq + 1 END, CASE WHEN held = '' THEN lines[i] WHEN length(held) + length(lines[i]) + 2 <= 1500 THEN held || chr(10) || chr(10) || lines[i] ELSE lines[i] END FROM w WHERE i <= len(lines))
SELECT doc_id, seq, max_by(held, i) AS chunk FROM w WHERE held <> '' GROUP BY doc_id, seq""")
def pack_lines(spark, sf_dir):
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.pack(lines, 1500)).alias("seq", "chunk"))


@query("T7_recursive_split")
def recursive_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.split_recursive(F.col("text"), 800, 100)).alias("seq", "chunk"))


@query("T9_token_windows", r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) > 20 THEN range(0, len(w) - 20, 108) WHEN len(w) > 0 THEN [0] ELSE [] END) AS i FROM t)
SELECT doc_id, (i // 108)::INTEGER AS seq, array_to_string(w[i + 1:i + 128], ' ') AS chunk FROM s""")
def token_windows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(split.split_tokens(F.col("text"), 128, 20)).alias("seq", "chunk"))


@query("T14_T16_element_chunks")
def element_chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n", -1)).alias("element_index", "text"))
    level = F.when(F.length("text") < 40, 1).otherwise(0)
    elements = lines.select("document_id", "element_index", F.concat_ws("-", F.lit("e"), "document_id", "element_index").alias("element_id"), F.lit("text").alias("element_type"), level.alias("text_level"), "text")
    return ingest.chunks(ingest.buffers(elements), 600, 60).select("document_id", "section_no", "island", "split_seq", "text", F.array_join("element_ids", ",").alias("elements"))


@query("T14_islands", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
h AS (SELECT *, length(text) < 40 AS heading FROM l),
s AS (SELECT *, sum(heading::INT) OVER o AS section_no, CASE WHEN heading OR coalesce(lag(heading) OVER o, true) THEN 1 ELSE 0 END AS edge FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, section_no::BIGINT AS section_no, count(*)::BIGINT AS elements, (max(island) - min(island) + 1)::BIGINT AS islands FROM (SELECT *, sum(edge) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM s) GROUP BY doc_id, section_no""")
def text_islands(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("element_index", "text")).withColumns({"text_level": F.when(F.length("text") < 40, 1).otherwise(0), "element_type": F.lit("text")})
    rows = ingest.islands(lines, "doc_id")
    return rows.groupBy("doc_id", "section_no").agg(F.count(F.lit(1)).alias("elements"), (F.max("island") - F.min("island") + 1).alias("islands"))


#: Forms of headings; %s is a number that the row decides. The number of each follows from the form alone.
_FORMS = [("Chapter %s Scope", "{n}"), ("## %s.1 Terms", "{n}.1"), ("%s.1.2 Names", "{n}.1.2"), ("Introduction", None), ("%s.1.2.9. Deep", "{n}.1.2.9"), ("Appendix B.%s Data", "B.{n}"), ("B.%s.4 Tables", "B.{n}.4"), ("%s", None), ("Part IV", None), ("IIII wrong", None), ("II.%s More", "2.{n}"), ("XIV. Last", "14")]
_FORM = "(o_orderkey % 12)"
_TITLE = "CASE " + " ".join(f"WHEN {_FORM} = {i} THEN replace('{f}', '%s', (o_custkey % 7)::VARCHAR)" for i, (f, _) in enumerate(_FORMS)) + " END"
_NUMBER = "CASE " + " ".join(f"WHEN {_FORM} = {i} THEN replace('{n}', '{{n}}', (o_custkey % 7)::VARCHAR)" for i, (_, n) in enumerate(_FORMS) if n) + " END"


def _headings(spark, sf_dir):
    form = F.col("o_orderkey") % 12
    title = F.lit(None).cast("string")
    for i, (f, _) in enumerate(_FORMS):
        title = F.when(form == i, F.replace(F.lit(f), F.lit("%s"), (F.col("o_custkey") % 7).cast("string"))).otherwise(title)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("section_id"), F.col("o_orderkey").alias("ord"), title.alias("title"))


@query("T22_numbering", f"SELECT o_orderkey AS section_id, {_NUMBER} AS number FROM orders")
def headings(spark, sf_dir):
    return _headings(spark, sf_dir).select("section_id", F.array_join(numbering.numbering(F.col("title")), ".").alias("number"))


@query("T22_T23_section_tree", f"""
WITH h AS (SELECT o_custkey AS document_id, o_orderkey AS section_id, {_NUMBER} AS number FROM orders),
u AS (SELECT a.document_id, a.section_id, b.section_id AS parent_id, row_number() OVER (PARTITION BY a.document_id, a.section_id ORDER BY length(b.number) DESC, b.section_id DESC) AS r
      FROM h a JOIN h b ON a.document_id = b.document_id AND b.section_id < a.section_id AND starts_with(a.number, b.number || '.'))
SELECT h.document_id, h.section_id, h.number, u.parent_id FROM h LEFT JOIN u ON h.document_id = u.document_id AND h.section_id = u.section_id AND r = 1""")
def section_tree(spark, sf_dir):
    return numbering.section_tree(_headings(spark, sf_dir)).select("document_id", "section_id", "number", "parent_id")


@query("T38_content_ids", "SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS document_id, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def content_ids(spark, sf_dir):
    return catalog.content_ids(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "sha256", "document_id", "copies")


@query("F10_file_search", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') ORDER BY p_name, p_partkey LIMIT 20")
def file_search(spark, sf_dir):
    return filters.by_name(table(spark, sf_dir, "part"), "p_name", "a", 20).select("p_partkey", "p_name")


@query("F1_metadata_filter", "SELECT count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (1, 2, 3, 5, 8, 13)")
def metadata_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnsRenamed({"o_orderstatus": "type", "o_custkey": "document_id"})
    return rows.filter(filters.metadata_filter(type="O", document_ids=[1, 2, 3, 5, 8, 13])).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("F2_scope_semi_join", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
def scope(spark, sf_dir):
    own = table(spark, sf_dir, "orders").filter("o_custkey % 7 = 0").select("o_orderkey")
    return filters.in_scope(table(spark, sf_dir, "lineitem"), "l_orderkey", own).select("l_orderkey", "l_linenumber")


@query("F15_scope_violations", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def violations(spark, sf_dir):
    own = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return filters.outside(table(spark, sf_dir, "orders").select("o_custkey").distinct(), own, "o_custkey")


@query("S6_page_ranges", "SELECT p_partkey, i::INTEGER AS first, least(i + 7, p_size)::INTEGER AS last FROM (SELECT p_partkey, p_size, unnest(range(0, p_size, 7)) AS i FROM part)")
def page_ranges(spark, sf_dir):
    from cairn.sources.readers import page_ranges as ranges

    return table(spark, sf_dir, "part").select("p_partkey", F.explode(ranges(F.col("p_size"), 7)).alias("r")).select("p_partkey", "r.first", "r.last")


@query("S16_byte_range", "SELECT p_partkey, least(p_size, 29) AS start, 29 AS stop FROM part WHERE p_size < 30")
def byte_range(spark, sf_dir):
    r = T.byte_range(F.concat(F.lit("bytes="), F.col("p_size").cast("string"), F.lit("-")), F.lit(30))
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r")).filter("r IS NOT NULL").select("p_partkey", F.col("r.start").cast("int").alias("start"), F.col("r.end").cast("int").alias("stop"))


@query("X1_html_rows", "SELECT page_id, html AS shown FROM pages WHERE NOT contains(lower(html), '<tr')")
def html_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_table_text(F.col("html")).alias("shown"))
