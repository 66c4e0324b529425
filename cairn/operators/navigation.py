"""Navigation over document > section > chunk > element.

Tables: sections(document_id, section_id, parent_id, ord...), chunks(section_id, chunk_id, ord...). Reading order is
given by order columns, always ended by the id.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEVEL = {"document": 4, "section": 3, "chunk": 2, "element": 1, "link": 0}
LAST = 999_999


def check_direction(anchor: str, target: str, down: bool) -> None:
    """N7."""
    if LEVEL[anchor] == LEVEL[target] or (LEVEL[anchor] > LEVEL[target]) != down:
        raise ValueError(f"{anchor} does not lead {'down' if down else 'up'} to {target}")


def order_key(page: Column, index: Column, seq: Column | None = None, known: Column | None = None) -> list[Column]:
    """Nulls count as 0; what has no position at all goes last."""
    keys = [F.coalesce(page, F.lit(0)), F.coalesce(index, F.lit(0)), *([F.coalesce(seq, F.lit(0))] if seq is not None else [])]
    return keys if known is None else [F.when(known, k).otherwise(LAST) for k in keys]


def placed(rows: DataFrame, parent: str, order: Sequence[str | Column], key: str) -> DataFrame:
    """Position and score 1 - i/n of each row below its parent."""
    below = Window.partitionBy(parent)
    rn = F.row_number().over(below.orderBy(*order, key))
    n = F.count(F.lit(1)).over(below)
    return rows.withColumn("rn", rn).withColumn("score", 1 - (rn - 1) / n)


def sections_of(documents: DataFrame, sections: DataFrame, chunks: DataFrame, order: Sequence[str]) -> DataFrame:
    """A document's sections with their numbers of chunks, those without any included."""
    n = chunks.groupBy("section_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    rows = placed(sections.join(documents.select("document_id").distinct(), "document_id", "left_semi"), "document_id", order, "section_id")
    return rows.join(n, "section_id", "left").fillna(0, ["chunk_count"])


def children_of(anchors: DataFrame, rows: DataFrame, parent: str, order: Sequence[str], key: str) -> DataFrame:
    """N2-N4, N6, N18."""
    return placed(rows.join(anchors.select(parent).distinct(), parent, "left_semi"), parent, order, key)


def elements_of(chunks: DataFrame, elements: DataFrame, parent: str, types: Sequence[str] | None = None) -> DataFrame:
    """The union of the chunks' element arrays, each element once."""
    ids = chunks.select(parent, F.explode("element_ids").alias("element_id")).dropDuplicates([parent, "element_id"])
    rows = ids.join(elements.filter(F.col("element_type").isin(list(types))) if types else elements, "element_id")
    return placed(rows, parent, order_key(F.col("page_index"), F.col("element_index")), "element_id")


def rolled_up(anchors: DataFrame, rows: DataFrame, key: str, up: str) -> DataFrame:
    """The distinct parents of the anchors."""
    return rows.join(anchors.select(key).distinct(), key, "left_semi").select(up).distinct()


def context_window(anchors: DataFrame, rows: DataFrame, parent: str, order: Sequence[str], key: str, k: int, side: str = "both") -> DataFrame:
    """Up to k neighbours of each anchor below the same parent, scored 1 - distance / (k + 1)."""
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(parent).orderBy(*order, key)))
    a = ranked.join(anchors.select(key).distinct(), key, "left_semi").select(F.col(parent), F.col(key).alias("anchor"), F.col("rn").alias("at"))
    low, high = (-k if side != "next" else 1), (k if side != "prev" else -1)
    steps = [i for i in range(low, high + 1) if i]
    # an equi join on (parent, position): each anchor names the positions that it wants
    wanted = a.withColumn("step", F.explode(F.array(*map(F.lit, steps)))).withColumn("rn", F.col("at") + F.col("step"))
    return wanted.join(ranked, [parent, "rn"]).withColumn("score", 1 - F.abs("step") / (k + 1))


def outline(nodes: DataFrame, key: str = "section_id", parent: str = "parent_id", max_depth: int = 3) -> DataFrame:
    """(key, depth, path) from the roots down, a level a step.

    Roots have no parent or an unknown one. max_depth bounds the number of steps. Cycles and what lies deeper are not
    in it: skeleton() takes those up too.
    """
    known = nodes.select(F.col(key).alias("__k")).distinct()
    rows = nodes.join(known, F.col(parent) == F.col("__k"), "left")
    root = F.col(parent).isNull() | F.col("__k").isNull() | (F.col(parent) == F.col(key))
    level = rows.filter(root).select(key, F.lit(0).alias("depth"), F.col(key).cast("string").alias("path"))
    found = level
    for depth in range(1, max_depth + 1):
        up = level.select(F.col(key).alias("__up"), F.col("path").alias("__path"))
        level = nodes.filter(F.col(parent) != F.col(key)).join(up, F.col(parent) == F.col("__up")).select(key, F.lit(depth).alias("depth"), F.concat("__path", F.lit("/"), F.col(key).cast("string")).alias("path"))
        found = found.unionByName(level)
    return found


def skeleton(sections: DataFrame, document: str = "document_id", key: str = "section_id", parent: str = "parent_id", ord_col: str = "ord", max_depth: int = 3) -> DataFrame:
    """(document, key, depth, parent, pos) for every section: its place in its document's outline, read in order.

    Roots have no parent or one that is unknown in the document; siblings go by ord and then key. A section is taken up
    once, so cycles end. What was not reached, deeper than max_depth or in a cycle, starts again at the top, in
    order. A document's sections are one group; their number is bounded by what a document holds.
    """
    kind = {f.name: f.dataType.simpleString() for f in sections.schema}

    def one(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("ord", "ascending"), ("key", "ascending")]).to_pylist()
        known = {r["key"] for r in rows}
        children: dict = {}
        for r in rows:
            children.setdefault(r["parent"], []).append(r["key"])
        seen, out = set(), []
        tops = [r["key"] for r in rows if r["parent"] is None or r["parent"] not in known]
        for top in (*tops, *(r["key"] for r in rows)):
            work = [(top, None, 1)]
            while work:
                node, above, depth = work.pop()
                if node in seen:
                    continue
                seen.add(node)
                out.append({"document": rows[0]["document"], "key": node, "depth": depth, "parent": above, "pos": len(out)})
                if depth < max_depth:
                    work += [(c, node, depth + 1) for c in reversed(children.get(node, []))]
        return pa.Table.from_pylist(out, schema=pa.schema([("document", table.schema.field("document").type), ("key", table.schema.field("key").type), ("depth", pa.int32()), ("parent", table.schema.field("key").type), ("pos", pa.int32())]))

    rows = sections.select(F.col(document).alias("document"), F.col(key).alias("key"), F.col(parent).cast(kind[key]).alias("parent"), F.col(ord_col).alias("ord"))
    out = rows.groupBy("document").applyInArrow(one, f"document {kind[document]}, key {kind[key]}, depth int, parent {kind[key]}, pos int")
    return out.withColumnsRenamed({"document": document, "key": key, "parent": parent})


def section_order(sections: DataFrame, links: DataFrame, elements: DataFrame) -> DataFrame:
    """Sections of documents with the place of their first live element; deleted links and elements don't hide a section."""
    first = links.filter("NOT deleted").select("section_id", "element_id").join(elements.filter("NOT deleted").select("element_id", "ord"), "element_id")
    return sections.join(first.groupBy("section_id").agg(F.min("ord").alias("ord")), "section_id", "left").withColumn("ord", F.coalesce("ord", F.lit(0)))


def outline_text(rows: DataFrame, title: str, path: str = "path", depth: str = "depth") -> Column:
    """One indented line."""
    return F.concat(F.repeat(F.lit("  "), F.col(depth)), F.lit("- "), F.col(title))


def descendants(nodes: DataFrame, root, key: str, parent: str, max_depth: int = 16) -> DataFrame:
    """All nodes below a root, once each; max_depth ends cycles."""
    rows = nodes.select(F.col(key).alias("k"), F.col(parent).alias("p"))
    sql = "WITH RECURSIVE t(k, d) AS (SELECT k, 1 FROM {rows} WHERE p = {root} UNION ALL SELECT n.k, d + 1 FROM {rows} n JOIN t ON n.p = t.k WHERE d < {most}) SELECT DISTINCT k FROM t"
    return nodes.sparkSession.sql(sql, rows=rows, root=root, most=max_depth).withColumnRenamed("k", key)


def position(chunks: DataFrame, elements: DataFrame, page_order: str | None = None) -> DataFrame:
    """Each chunk's known elements in order with their boxes, and the page to open: that of the first element with one.

    page_order names an array beside element_ids by which an element comes first for the page, where the list's own order
    doesn't decide; of equal ones the list's first does.
    """
    order = F.get(page_order, F.col("ord")) if page_order else F.lit(0)
    ids = chunks.select("chunk_id", F.col("page_index").alias("chunk_page"), F.posexplode("element_ids").alias("ord", "element_id"), *([page_order] if page_order else []))
    ids = ids.select("chunk_id", "chunk_page", "ord", "element_id", order.alias("page_order"))
    met = ids.join(elements.select("element_id", F.col("page_index").alias("element_page"), "page_position", F.lit(True).alias("known")), "element_id", "left")
    shown = F.when(F.col("known"), F.struct("ord", "element_id", "page_position"))
    page = F.min_by("element_page", F.when(F.col("element_page").isNotNull(), F.struct("page_order", "ord")))
    out = met.groupBy("chunk_id", "chunk_page").agg(F.array_sort(F.collect_list(shown)).alias("elements"), page.alias("page"))
    return out.withColumn("page", F.coalesce("page", "chunk_page"))
