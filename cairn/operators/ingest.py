"""From parsed pages to elements, sections and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.functions.split import split_structure_first
from cairn.functions.text import chunk_texts, language, stable_id

ELEMENT_TYPES = ["text", "image", "table", "equation", "discarded"]


def flatten_pages(parsed: DataFrame, document: str = "document_id", root: str = "root") -> DataFrame:
    """The page tree's elements with ids and positions; a missing box is all zero."""
    pages = parsed.select(document, F.posexplode(root).alias("page_no", "page")).select(document, F.col("page.page_idx").alias("page_index"), F.posexplode("page.page_info").alias("at", "e"))
    rows = pages.select(document, "page_index", "at", "e.*")
    index = F.row_number().over(Window.partitionBy(document).orderBy("page_index", "at")) - 1
    kind = F.when(F.col("type").isin(ELEMENT_TYPES), F.col("type")).otherwise("text")  # S13
    return rows.withColumns({"element_index": index, "element_type": kind, "page_position": F.coalesce("bbox", F.array(*[F.lit(0.0)] * 4))}).withColumn("element_id", stable_id("element", F.col(document), F.col("element_index")))


def total_pages(elements: DataFrame, document: str = "document_id") -> DataFrame:
    """The pages named by the elements."""
    return elements.groupBy(document).agg((F.max("page_index") + 1).alias("total_pages"))


def islands(elements: DataFrame, document: str = "document_id", ord_col: str = "element_index") -> DataFrame:
    """Headings, images and tables end the text before them; island numbers the runs, section the headings so far."""
    order = Window.partitionBy(document).orderBy(ord_col)
    heading = F.coalesce(F.col("text_level"), F.lit(0)) > 0
    alone = heading | F.col("element_type").isin("image", "table")
    return elements.withColumns({"is_heading": heading, "section_no": F.sum(heading.cast("int")).over(order), "island": F.sum((alone | F.coalesce(F.lag(alone).over(order), F.lit(True))).cast("int")).over(order)})


def buffers(elements: DataFrame, document: str = "document_id", ord_col: str = "element_index") -> DataFrame:
    """Each run of texts joined by blank lines, with its elements and their ranges in the joined text."""
    rows = islands(elements, document, ord_col).filter("NOT is_heading").filter(F.col("element_type").isin("text", "equation"))
    parts = rows.groupBy(document, "section_no", "island").agg(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("ord"), "element_id", "text"))).alias("parts"))
    return parts.withColumn("text", F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"))


def ranges(parts: Column, glue: int = 2) -> Column:
    """(element_id, start, end) of each part in the joined text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<element_id:string,start:int,end:int>>").alias("out"))
    step = lambda a, p: F.struct((a["at"] + F.length(p["text"]) + glue).alias("at"), F.array_append(a["out"], F.struct(p["element_id"].cast("string").alias("element_id"), a["at"].alias("start"), (a["at"] + F.length(p["text"])).alias("end"))).alias("out"))
    return F.aggregate(parts, start, step, lambda a: a["out"])


def chunks(buffered: DataFrame, size: int = 1000, overlap: int = 200, document: str = "document_id") -> DataFrame:
    """The chunks of each buffer, in order, with the elements that each overlaps.

    A chunk stands where it is next found in the joined text; one that isn't found belongs to all elements of its buffer.
    """
    rows = buffered.withColumn("ranges", ranges(F.col("parts"))).withColumn("pieces", split_structure_first(F.col("text"), size, overlap))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        found = F.locate(p, "text", a["at"]) if isinstance(p, str) else F.when(F.instr(F.substring(F.col("text"), a["at"], F.length("text")), p) > 0, F.instr(F.substring(F.col("text"), a["at"], F.length("text")), p) + a["at"] - 1).otherwise(0)
        return F.struct(F.when(found > 0, F.greatest(found + F.length(p) - overlap - 50, a["at"])).otherwise(a["at"]).alias("at"), F.array_append(a["out"], F.struct(p.alias("text"), (found - 1).cast("int").alias("start"))).alias("out"))

    placed = rows.withColumn("placed", F.aggregate("pieces", start, step, lambda a: a["out"]))
    out = placed.select(document, "section_no", "island", "ranges", F.posexplode("placed").alias("split_seq", "c"))
    inside = F.filter("ranges", lambda r: (r["start"] < F.col("c.start") + F.length("c.text")) & (F.col("c.start") < r["end"]))
    ids = F.transform(F.when((F.col("c.start") >= 0) & (F.size(inside) > 0), inside).otherwise(F.col("ranges")), lambda r: r["element_id"])
    return out.select(document, "section_no", "island", "split_seq", F.col("c.text").alias("text"), F.col("c.start").alias("start"), ids.alias("element_ids")).withColumn("chunk_id", stable_id("chunk", F.col(document), F.col("island"), F.col("split_seq")))


def section_text(sections: DataFrame, chunk_rows: DataFrame, most: int | None = None) -> DataFrame:
    """A section's chunks in its list's order, missing and blank ones skipped, joined by blank lines."""
    ids = sections.select("section_id", F.posexplode("chunk_ids").alias("ord", "chunk_id"))
    met = ids.join(chunk_rows.select("chunk_id", F.when(F.col("chunk_type") == "image", F.lit("[image]")).otherwise(F.col("text")).alias("text")), "chunk_id").filter(F.trim("text") != "")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    return met.groupBy("section_id").agg((F.left(text, F.lit(most)) if most else text).alias("text"))


def roll_up(levels: DataFrame, summaries: DataFrame, deepest: int) -> DataFrame:
    """parents' summaries from the bottom up, a level a step: the own one first, then 'title：summary' of each child."""
    done = summaries
    for depth in range(deepest - 1, -1, -1):
        kids = levels.filter(F.col("depth") == depth + 1).join(done, "section_id").select(F.col("parent_id").alias("section_id"), F.struct("ord", F.concat("title", F.lit("：")).alias("t"), "summary").alias("k"))
        joined = kids.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("k")), lambda k: F.concat(k["t"], k["summary"])), "\n\n").alias("__kids"))
        here = joined.join(done, "section_id", "left").select("section_id", F.concat_ws("\n\n", "summary", "__kids").alias("summary"))
        done = done.join(here, "section_id", "left_anti").unionByName(here)
    return done


def qa_batches(rows: DataFrame, section: str = "section_id", ord_col: str = "ord", size: int = 6) -> DataFrame:
    """Chunks in batches, with local codes C1 .. Cn."""
    rn = F.row_number().over(Window.partitionBy(section).orderBy(ord_col))
    return rows.withColumn("batch", F.floor((rn - 1) / size).cast("int")).withColumn("code", F.concat(F.lit("C"), ((rn - 1) % size + 1).cast("string")))


_QA = "array<struct<question:string,answer:string,type:string,relevance:double,sources:array<string>>>"


def qa_items(answers: DataFrame, batches: DataFrame, key: tuple[str, str] = ("section_id", "batch"), types: tuple[str, ...] = ("factual", "conceptual", "procedural")) -> DataFrame:
    """A model's raw JSON answers as rows; codes become chunk ids; unknown codes mean the whole batch."""
    raw = F.regexp_extract("raw", r"(?s)(\[.*\])", 1)
    rows = answers.select(*key, F.posexplode(F.from_json(raw, _QA)).alias("n", "q")).select(*key, "n", "q.*")
    rows = rows.filter((F.trim("question") != "") & (F.trim("answer") != ""))
    codes = batches.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("code", "chunk_id"))).alias("codes"), F.array_sort(F.collect_list("chunk_id")).alias("all"))
    met = rows.join(codes, list(key))
    found = F.filter(F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda c: F.try_element_at(F.col("codes"), F.regexp_extract(c, r"(C\d+)", 1))), lambda c: c.isNotNull())
    kind = F.when(F.col("type").isin(list(types)), F.col("type")).otherwise("factual")
    return met.select(*key, "n", "question", "answer", kind.alias("type"), F.least(F.greatest(F.coalesce("relevance", F.lit(0.8)), F.lit(0.0)), F.lit(1.0)).alias("relevance"), F.when(F.size(found) > 0, F.array_distinct(found)).otherwise(F.col("all")).alias("source_chunk_ids"))


def summary_fields(raw: Column) -> Column:
    """Summary, keywords and topics of a model's JSON; what is no JSON is the summary."""
    got = F.from_json(F.regexp_extract(raw, r"(?s)(\{.*\})", 1), "summary string, keywords string, topics string, type string")
    items = lambda c: F.filter(F.transform(F.split(F.regexp_replace(c, r"[\[\]\"]", ""), r"[,，]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.coalesce(got["summary"], F.trim(raw)).alias("summary"), items(F.coalesce(got["keywords"], F.lit(""))).alias("keywords"), items(F.coalesce(got["topics"], F.lit(""))).alias("topics"), got["type"].alias("type"))


def document_totals(chunk_rows: DataFrame, document: str = "document_id", text: str = "text") -> DataFrame:
    """(document, characters, language): over text and table chunks; the language of the first 20 000 characters of the longest."""
    real = chunk_rows.filter(F.col("chunk_type").isin("text", "table"))
    longest = F.max_by(F.left(F.col(text), F.lit(20_000)), F.struct(F.length(text), text))
    return real.groupBy(document).agg(F.sum(F.length(text)).alias("characters"), language(longest).alias("language"))


def summary_inputs(sections: DataFrame, document: str = "document_id") -> DataFrame:
    """Sections with a summary, leaves first, in order: (document, section_id, nth)."""
    real = sections.filter(F.trim(F.coalesce("summary", F.lit(""))) != "")
    nth = F.row_number().over(Window.partitionBy(document).orderBy(F.desc("is_leaf"), "ord", "section_id"))
    return real.select(document, "section_id", "summary", nth.alias("nth"))


def leaf_chunks(sections: DataFrame, document: str = "document_id") -> DataFrame:
    """(document, chunks): parents repeat their leaves' chunks, so only leaves count."""
    return sections.groupBy(document).agg(F.sum(F.when(F.col("is_leaf"), F.col("n_chunks")).otherwise(0)).cast("long").alias("chunks"))


def leaf_sections(sections: DataFrame, key: str = "section_id", parent: str = "parent_id") -> DataFrame:
    """Sections that are no section's parent; only these feed the questions."""
    parents = sections.select(F.col(parent).alias(key)).filter(F.col(key).isNotNull()).distinct()
    return sections.join(parents, key, "left_anti")


def filled_search_text(chunk_rows: DataFrame) -> DataFrame:
    """Rows without a search text get the one that their parts give; running it again changes nothing."""
    made = chunk_texts(*(F.col(c) for c in ("chunk_type", "text", "caption", "body", "footnote", "section", "page")))["search"]
    return chunk_rows.withColumn("search_text", F.coalesce(F.nullif(F.trim("search_text"), F.lit("")), made))


def tree_diagnosis(sections: DataFrame, key: str = "section_id", parent: str = "parent_id", document: str = "document_id") -> DataFrame:
    """(document, sections, roots, orphans, wrong_leaves): unknown parents, and leaf marks that the tree contradicts."""
    known = sections.select(F.col(document).alias("__d"), F.col(key).alias("__k"))
    has = sections.filter(F.col(parent).isNotNull()).select(F.col(document).alias("__pd"), F.col(parent).alias("__p")).distinct()
    met = sections.join(known, (F.col(document) == F.col("__d")) & (F.col(parent) == F.col("__k")), "left").join(has, (F.col(document) == F.col("__pd")) & (F.col(key) == F.col("__p")), "left")
    orphan = F.col(parent).isNotNull() & F.col("__k").isNull()
    return met.groupBy(document).agg(F.count(F.lit(1)).alias("sections"), F.count_if(F.col(parent).isNull()).alias("roots"), F.count_if(orphan).alias("orphans"), F.count_if(F.col("is_leaf") != F.col("__p").isNull()).alias("wrong_leaves"))
