"""Sources (S1-S17): files to page trees and elements, and streams behind one factory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import file_type, stable_id, strip

#: What may be uploaded, how the content must begin (hex), and how large it may be.
MAGIC = {"pdf": ["25504446"], "docx": ["504B0304"], "pptx": ["504B0304"], "doc": ["D0CF11E0"], "ppt": ["D0CF11E0"], "png": ["89504E47"], "jpg": ["FFD8FF"], "jpeg": ["FFD8FF"], "json": ["7B", "5B"], "csv": [""], "txt": [""], "md": [""]}
MOST_BYTES = 100 * 1024 * 1024

PAGE_TREE = "array<struct<page_idx:int,page_info:array<struct<type:string,text:string,text_level:int,bbox:array<double>,table_body:string>>>>"


def _one_element(kind: str, text: Column) -> Column:
    """A page tree with a single element."""
    element = F.struct(F.lit(kind).alias("type"), (text if kind == "text" else F.lit("")).alias("text"), F.lit(None).cast("int").alias("text_level"), F.lit(None).cast("array<double>").alias("bbox"), (text if kind == "table" else F.lit(None).cast("string")).alias("table_body"))
    return F.array(F.struct(F.lit(0).alias("page_idx"), F.array(element).alias("page_info")))


def read_json_files(spark: SparkSession, path: str) -> DataFrame:
    """S3: each file is one text element, indented by two."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    pretty = F.coalesce(F.to_json(F.try_parse_json("value"), {"pretty": "true"}), F.col("value"))
    return raw.select(stable_id("document", F.col("path")).alias("document_id"), "path", _one_element("text", pretty).alias("root"))


def read_csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one table element; line ends become LF."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n+\z", "")
    return raw.select(stable_id("document", F.col("path")).alias("document_id"), "path", _one_element("table", body).alias("root"))


def read_files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """By format; a glob reads many. Formats that need an outside parser come as bytes for a plug-in."""
    if kind == "json":
        return read_json_files(spark, path)
    if kind == "csv":
        return read_csv_files(spark, path)
    if kind in ("pdf", "word", "ppt", "image"):
        return spark.read.format("binaryFile").load(path).withColumn("type", file_type(F.col("path")))
    raise ValueError(f"no reader for {kind}")


def page_ranges(total: Column, most: int) -> Column:
    """[first, last) of each batch of at most ``most`` pages."""
    return F.when(total > 0, F.transform(F.sequence(F.lit(0), total - 1, F.lit(most)), lambda a: F.struct(a.alias("first"), F.least(a + most, total).alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def merge_pages(batches: DataFrame, document: str = "document_id") -> DataFrame:
    """batches' pages under their absolute numbers, markdown joined in order."""
    rows = batches.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("first", "markdown", "pages"))).alias("b"))
    pages = F.flatten(F.transform("b", lambda x: F.transform(x["pages"], lambda p: F.struct((x["first"] + p["page_idx"]).alias("page_idx"), p["text"].alias("text")))))
    return rows.select(document, F.array_join(F.transform("b", lambda x: x["markdown"]), "\n\n").alias("markdown"), pages.alias("pages")).withColumn("total_pages", F.size("pages"))


def upload_error(name: Column, size: Column, content: Column) -> Column:
    """Why an upload is refused, or null."""
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    head = F.upper(F.hex(F.encode(F.ltrim(F.decode(content, "ISO-8859-1")), "ISO-8859-1")))
    fits = F.lit(False)
    for e, starts in MAGIC.items():
        for s in starts:
            fits = fits | ((ext == e) & head.startswith(s))
    return F.when(~ext.isin(list(MAGIC)), "type").when(size > MOST_BYTES, "size").when(size == 0, "empty").when(~fits, "content")


def stream(spark: SparkSession, source: str, schema: str | None = None, **options: str) -> DataFrame:
    """A directory of files, a rate, or Kafka where its connector is installed."""
    reader = spark.readStream.format(source).options(**options)
    reader = reader.schema(schema) if schema else reader
    return reader.load()


__all__ = ["MAGIC", "merge_pages", "page_ranges", "read_files", "strip", "stream", "upload_error"]
