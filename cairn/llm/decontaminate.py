"""Benchmark decontamination with DataFrame functions only.

The benchmark's distinct word windows are hashed into a table that is broadcast. One larger than the bound (in rows or
bytes) is dealt by hash into several tables, each broadcast for a scan of its own, so memory stays bounded and
no text is shuffled at any size. Every document emits the hashes of its own windows, position by position; the few
that meet the table are verified word by word in the same stage, while the document's words are still at hand.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm import native
from cairn.llm.native import ascii_lower, bounded, let, parts_of, run_of, scan, sums, weight
from cairn.llm.runtime import cut

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of the text as it stands, so with A-Z in them.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The text's words in order: A-Z lower-cased, digits, a-z and all beyond ASCII; null has none."""
    return F.coalesce(F.filter(F.split(ascii_lower(text), SEPARATORS, -1), lambda w: w != ""), F.array().cast("array<string>"))


def _window(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, n), " ")


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(h, length, gram, items): each distinct window with the items, as strings, that hold it."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col).cast("string")).alias("words"))
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window))).filter("length > 0")
    at = items.select("item", "length", "words", F.explode(run_of(F.size("words") - F.col("length") + 1)).alias("at"))
    grams = at.select("item", "length", F.slice("words", F.col("at") + 1, F.col("length")).alias("gram"))
    return grams.groupBy(F.xxhash64("gram").alias("h"), "length", F.array_join("gram", " ").alias("gram")).agg(F.collect_set("item").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(doc_id, text_key, spans, items) for the documents that hold a benchmark window.

    spans are the sorted (start, end) word positions of the windows, end exclusive. text_key hashes the text, so
    that rows which share an id but not a text are told apart.
    """
    windows = cut(benchmark_windows(benchmark, item_col, item_text_col, window))
    rows, size = weight(windows)
    passes = max(1, -(-rows // native.BROADCAST_ROWS), -(-size // native.BROADCAST_BYTES))
    if passes == 1:
        met = _met(docs, windows, id_col, text_col)
    else:
        met = reduce(DataFrame.union, (cut(_met(docs, cut(windows.filter(F.pmod("h", F.lit(passes)) == i)), id_col, text_col)) for i in range(passes)))
    return met.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _met(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, span, items): each place of a document that holds one of the windows, which are few enough to broadcast."""
    found = windows.groupBy("length").count().orderBy("length").collect()  # at most `window` rows
    lengths = [r["length"] for r in found]
    hashes = lambda w, n: F.transform(run_of(F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i + 1, n)))
    every = lambda w: F.concat(F.array().cast("array<bigint>"), *(hashes(w, n) for n in lengths))
    text = F.col(text_col).cast("string")
    both = let(words_of(text), lambda w: F.struct(w.alias("words"), every(w).alias("hashes")))
    table = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), both.alias("t"))
    table = table.select("doc_id", "text_key", "t.words", "t.hashes")
    rows = table.select("doc_id", "text_key", "words", F.posexplode("hashes").alias("at", "h"))
    met = rows.join(F.broadcast(windows), "h")
    # hashes of the shorter windows come first
    start, before = F.lit(-1), F.lit(0)
    for n in lengths:
        count = F.greatest(F.size("words") - n + 1, F.lit(0))
        here = (F.col("length") == n) & (F.col("at") >= before) & (F.col("at") < before + count)
        start = F.when(here, F.col("at") - before).otherwise(start)
        before = before + count
    met = met.withColumn("start", start).filter("start >= 0")
    met = met.filter(_window(F.col("words"), F.col("start"), F.col("length")) == F.col("gram"))
    return met.select("doc_id", "text_key", F.struct("start", (F.col("start") + F.col("length")).alias("end")).alias("span"), "items")


def covered(spans: Column) -> Column:
    """How many word positions sorted spans cover."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    more = lambda a, s: F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n"))
    return F.aggregate(spans, zero, more, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): one row for each row of docs.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Null and empty texts have
    no words and are clean; items without words and null items match nothing (a null item_id is not counted, its
    words are). Rows repeating an id are answered each for its own text. A null id keeps its row.
    """
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    found = found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), covered(F.col("spans")).alias("n_hit"), "items")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_key"), F.size(words_of(F.col(text_col).cast("string"))).cast("long").alias("n_words"))
    met = base.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return met.select("doc_id", "n_words", n.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


def _without(text: Column, spans: Column) -> Column:
    """The text without the words in sorted spans; what separates words stays, but for what stood before a removed one."""

    def runs(s: Column) -> Column:
        """Spans that touch or overlap, merged: array<(start, end)>."""
        reach = scan(s, F.lit(-1), lambda a, x: F.greatest(a, x["end"]))
        before = lambda r: F.concat(F.array(F.lit(-1)), F.slice(r, 1, F.size(r) - 1))
        # a run starts where what went before has ended, and ends where the next one's predecessors did
        heads = lambda r: F.filter(F.zip_with(s, before(r), lambda x, b: F.struct(x["start"].alias("start"), b.alias("before"))), lambda x: x["start"] > x["before"])
        return let(reach, lambda r: let(heads(r), lambda h: F.zip_with(h, F.concat(F.transform(F.slice(h, 2, F.size(h)), lambda x: x["before"]), F.array(F.element_at(r, -1))), lambda x, e: F.struct(x["start"].alias("start"), e.alias("end")))))

    def kept(ends: Column) -> Column:
        """The text between the runs: from the end of a run's last word to the end of the word before the next run."""
        end = lambda i: F.when(i > 0, F.element_at(ends, F.greatest(i, F.lit(1)))).otherwise(F.lit(0))

        def pieces(part, r: Column) -> Column:
            to = F.concat(F.transform(r, lambda x: end(x["start"])), F.array(F.length(text)))
            at = F.concat(F.array(F.lit(0)), F.transform(r, lambda x: end(x["end"])))
            return F.array_join(F.zip_with(at, to, part), "")

        return let(runs(spans), lambda r: parts_of(text, lambda part: pieces(part, r)))

    # ends[i] is where word i ends; gaps has what stands before each word, and after the last
    words, gaps = F.regexp_extract_all(text, F.lit(_RAW_WORD), F.lit(0)), F.split(text, _RAW_WORD, -1)
    lengths = let(words, lambda w: F.zip_with(w, F.slice(gaps, 1, F.size(w)), lambda x, g: F.length(x) + F.length(g)))
    return let(sums(lengths), kept)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """docs without what the benchmark holds: whole ``documents``, or only the ``spans`` that were hit.

    All columns and all clean rows stay as they are. Nulls and empty tables are treated as by contamination().
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove}")
    of = ["spans"] if remove == "spans" else []
    found = hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window)
    found = cut(found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), *of).withColumnsRenamed({"spans": "__spans"}))
    keyed = docs.withColumn("__of", F.xxhash64(F.col(text_col).cast("string")))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__key"))
    small = bounded(found)
    if remove == "documents":
        return keyed.join(small, on, "left_anti").drop("__of")
    met = keyed.join(small, on, "left")
    text = F.when(F.col("__spans").isNotNull(), _without(F.col(text_col), F.col("__spans"))).otherwise(F.col(text_col))
    return met.withColumn(text_col, text).drop("__of", "__id", "__key", "__spans")


#: contamination() in DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS gram FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM g),
x AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, lens WHERE len(w) >= n),
h AS (SELECT x.doc_id, x.i, x.n, g.item_id FROM x JOIN g ON g.n = x.n AND g.gram = array_to_string(x.w[x.i:x.i + x.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
