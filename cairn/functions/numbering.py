"""Numbers of headings and the section tree that they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values. Numerals of titles go up to 99.
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
HAN = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def _lookup(values: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(0))


def roman(c: Column) -> Column:
    """A smaller numeral before a larger one is taken off."""
    n = F.transform(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), lambda x: _lookup(ROMAN, x))
    return F.aggregate(F.reverse(n), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top")), lambda a, x: F.struct((a["sum"] + F.when(x < a["top"], -x).otherwise(x)).alias("sum"), F.greatest(a["top"], x).alias("top")), lambda a: a["sum"])


def han(c: Column) -> Column:
    """One numeral, or tens and ones around 十, each of which may be missing; null for anything else."""
    digit = "[零一二三四五六七八九]"
    value = lambda i: _lookup(HAN, F.regexp_extract(c, rf"^({digit}?)十({digit}?)$", i))
    tens = F.when(F.left(c, F.lit(1)) == "十", 1).otherwise(value(1))
    return F.when(c.rlike(rf"^{digit}$"), _lookup(HAN, c)).when(c.rlike(rf"^{digit}?十{digit}?$"), tens * 10 + value(2))


def numbering(title: Column) -> Column:
    """The heading's number as an array of segments, null if there is none.

    Marks (#) and white space before the title don't count. The forms are tried in this order: Chapter 2, 第二章,
    Appendix A.1, A.1, 2.3.1 (with something after it), IV.2 (a well-formed numeral, with white space after it).
    """
    t = F.trim(F.regexp_replace(title, r"^#+", ""))
    get = lambda p, i=1: F.regexp_extract(t, p, i)
    has = lambda p: t.rlike(p)
    chapter = r"(?i)^\s*(?:chapter|section|part)\s+(\d+)\b"
    zh = r"^\s*第\s*([0-9零一二三四五六七八九十百千]+)\s*[章节篇部]"
    appendix = r"(?i)^\s*(?:appendix|附录)\s+([A-Z])\b(?:\.(\d+(?:\.\d+)*))?"
    short = r"^\s*([A-Z])\.(\d+(?:\.\d+)*)\b"
    arabic = r"^\s*(\d+(?:\.\d+)*)\.?(?=\s|[^\d.\s])"
    romans = r"^\s*(?=[IVXLCDM])(M{0,3}(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3}))(?:\.(\d+(?:\.\d+)*))?\.?\s+"
    one = lambda c: F.array(c.cast("string"))
    tail = lambda p: F.filter(F.split(get(p, 2), r"\."), lambda x: x != "")
    number = F.when(get(zh).rlike(r"^\d+$"), get(zh).try_cast("int")).otherwise(han(get(zh)))
    return (
        F.when(has(chapter), one(get(chapter)))
        .when(has(zh) & number.isNotNull(), one(number))
        .when(has(appendix), F.concat(one(F.upper(get(appendix))), tail(appendix)))
        .when(has(short), F.concat(one(get(short)), tail(short)))
        .when(has(arabic), F.split(get(arabic), r"\."))
        .when(has(romans), F.concat(one(roman(get(romans))), tail(romans)))
    )


def section_tree(headings: DataFrame, document: str = "document_id", ord_col: str = "ord", key: str = "section_id", title: str = "title") -> DataFrame:
    """(document, key, ord, number, parent_id, level).

    The parent is the nearest numbered ancestor that stands earlier: of the longest prefix that occurs before, its last
    occurrence. Headings without a number, or without such an ancestor, are roots. An equi join on (document, prefix)
    finds the candidates.
    """
    rows = headings.select(document, key, ord_col, numbering(F.col(title)).alias("seg")).withColumn("number", F.array_join("seg", "."))
    up = rows.filter(F.size("seg") > 1).select(document, key, F.col(ord_col).alias("at"), F.explode(F.sequence(F.lit(1), F.size("seg") - 1)).alias("n"), "seg")
    up = up.withColumn("number", F.array_join(F.slice("seg", F.lit(1), F.col("n")), "."))
    known = rows.filter("seg IS NOT NULL").select(document, "number", F.col(key).alias("__p"), F.col(ord_col).alias("__at"))
    met = up.join(known, [document, "number"]).filter(F.col("__at") < F.col("at"))
    rn = F.row_number().over(Window.partitionBy(document, key).orderBy(F.desc("n"), F.desc("__at")))
    parent = met.withColumn("rn", rn).filter("rn = 1").select(document, key, F.col("__p").alias("parent_id"))
    return rows.join(parent, [document, key], "left").select(document, key, ord_col, "number", "parent_id")


def post_order(paths: DataFrame, path: str = "path") -> DataFrame:
    """Children before their parents: a path sorts after all that continue it."""
    return paths.withColumn("post_key", F.concat(F.col(path), F.lit("￿"))).orderBy("post_key")
