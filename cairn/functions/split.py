"""Splitters (T6-T13): greedy packing as array folds; recursive and window splits in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators by priority.
SEPARATORS = ["\n", "。", "，", " "]


def recursive_pieces(text: str, size: int, overlap: int, separators: list[str] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the first separator that helps, with overlap between neighbours."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next((i for i, s in enumerate(separators) if s in text), len(separators))
    parts = list(text) if at == len(separators) else [p for p in text.split(separators[at]) if p]
    glue, out, held, room = "" if at == len(separators) else separators[at], [], [], 0

    def flush() -> None:
        nonlocal held, room
        if piece := glue.join(held).strip():
            out.append(piece)
        while held and (room > overlap or not overlap):
            room -= len(held.pop(0)) + (len(glue) if held else 0)

    for p in parts:
        if len(p) > size:
            if held:
                flush()
            held, room = [], 0
            out += recursive_pieces(p, size, overlap, separators[at + 1 :])
            continue
        extra = len(p) + (len(glue) if held else 0)
        if held and room + extra > size:
            flush()
            while held and room + len(p) + len(glue) > size:
                room -= len(held.pop(0)) + (len(glue) if held else 0)
            extra = len(p) + (len(glue) if held else 0)
        held.append(p)
        room += extra
    if piece := glue.join(held).strip():
        out.append(piece)
    return out


def split_recursive(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_pieces(t or "", size, overlap))

    return run(c)


def split_regular(c: Column, separator: str, size: int = 1000) -> Column:
    """Parts between a fixed separator, packed greedily up to size."""
    return pack(F.filter(F.split(c, separator, -1), lambda p: p != ""), size, separator.replace("\\", ""))


def split_tokens(c: Column, size: int = 256, overlap: int = 32) -> Column:
    """Windows of white-space tokens."""
    tokens = F.filter(F.split(c, r"\s+"), lambda t: t != "")
    starts = lambda n: F.when(n > overlap, F.sequence(F.lit(0), n - overlap - 1, F.lit(size - overlap))).otherwise(F.when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
    return F.transform(F.array(tokens), lambda t: F.transform(starts(F.size(t)), lambda i: F.array_join(F.slice(t, i + 1, size), " ")))[0]


def pack(parts: Column, size: int, glue: str = "\n\n") -> Column:
    """Greedy packing: a part joins the open chunk while both and the glue fit."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("held"))

    def step(a: Column, p: Column) -> Column:
        joined = F.when(a["held"] == "", p).otherwise(F.concat(a["held"], F.lit(glue), p))
        fits = (a["held"] == "") | (F.length(a["held"]) + F.length(p) + len(glue) <= size)
        return F.struct(F.when(fits, a["out"]).otherwise(F.array_append(a["out"], a["held"])).alias("out"), F.when(fits, joined).otherwise(p).alias("held"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["held"] == "", a["out"]).otherwise(F.array_append(a["out"], a["held"])))


def split_structure_first(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Paragraphs are packed greedily; one that is too long ends the open chunk and is split by T7.

    The fold stays in the JVM; only texts that hold such a paragraph go through Arrow.
    """
    paragraphs = F.filter(F.transform(F.split(c, r"\n{2,}", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    @F.pandas_udf("array<string>")
    def mixed(lists: pd.Series) -> pd.Series:
        def one(parts) -> list[str]:
            out, held = [], ""
            for p in parts if parts is not None else []:
                if len(p) > size:
                    out += [held] * bool(held) + recursive_pieces(p, size, overlap)
                    held = ""
                elif held and len(held) + len(p) + 2 > size:
                    out.append(held)
                    held = p
                else:
                    held = f"{held}\n\n{p}" if held else p
            return out + [held] * bool(held)

        return lists.map(one)

    return F.when(F.exists(paragraphs, lambda p: F.length(p) > size), mixed(F.when(F.exists(paragraphs, lambda p: F.length(p) > size), paragraphs))).otherwise(pack(paragraphs, size))


def table_rows(body: Column) -> Column:
    """<tr> rows, else lines with a bar, else lines."""
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.trim(x) != "")
    barred = F.filter(lines, lambda x: x.contains("|"))
    return F.when(F.lower(body).contains("<tr>"), F.regexp_extract_all(body, F.lit(r"(?is)(<tr>.*?</tr>)"), F.lit(1))).when(F.size(barred) > 0, barred).otherwise(lines)


def split_table(rows: Column, size: int, caption: Column, footnote: Column) -> Column:
    """Row groups, each under the header row again; a group of the header alone is dropped.

    What a group must not exceed counts caption, footnote, header and 50 more, and starts at the header again.
    """
    cap = F.coalesce(F.length(caption), F.lit(0)) + F.coalesce(F.length(footnote), F.lit(0))

    def run(r: Column) -> Column:
        head = r[0]
        room = F.lit(size) - (cap + F.length(head) + 50)
        start = F.struct(F.array().cast("array<array<string>>").alias("out"), F.array().cast("array<string>").alias("held"), F.length(head).alias("n"))

        def step(a: Column, x: Column) -> Column:
            full = (a["n"] + F.length(x) > room) & (F.size(a["held"]) > 0)
            return F.struct(F.when(full, F.array_append(a["out"], a["held"])).otherwise(a["out"]).alias("out"), F.when(full, F.array(x)).otherwise(F.array_append(a["held"], x)).alias("held"), F.when(full, F.length(head) + F.length(x)).otherwise(a["n"] + F.length(x)).alias("n"))

        groups = F.aggregate(F.slice(r, 2, F.size(r)), start, step, lambda a: F.when(F.size(a["held"]) > 0, F.array_append(a["out"], a["held"])).otherwise(a["out"]))
        return F.transform(groups, lambda g: F.concat_ws("\n", F.concat(F.lit("table_caption: "), caption), head, F.array_join(g, "\n"), F.concat(F.lit("table_footnote: "), footnote)))

    return F.when(F.size(rows) > 0, F.transform(F.array(rows), run)[0]).otherwise(F.array().cast("array<string>"))


#: The splitters' defaults.
SIZE, OVERLAP = 1000, 200
STRATEGIES = ("structure_first", "recursive", "regular", "tokens")


def split_text(c: Column, strategy: str = "structure_first", size: int = SIZE, overlap: int = OVERLAP, separator: str = "\n\n") -> Column:
    """The pieces of a text by a named strategy; a size below 1, or an overlap that isn't smaller, is an error."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError(f"size {size}, overlap {overlap}")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "regular":
        return split_regular(c, separator, size)
    return {"structure_first": split_structure_first, "recursive": split_recursive, "tokens": split_tokens}[strategy](c, size, overlap)
