"""Text functions as Columns: cleaning, language, token estimates, rendering of tables and images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that a strip removes; Java's \s and Spark's trim know fewer.
WHITE = r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Control and zero-width characters; TAB, LF and CR stay.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{7F}-\x{9F}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{2060}-\x{206F}]"
BLANKS = r"[ \t\x0B\f\x{A0}\x{3000}]+"

#: Script classes in the order in which ties are settled.
SCRIPTS = [
    ("zh", r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"),
    ("ko", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"),
    ("ru", r"[\x{0400}-\x{04FF}]"),
    ("ar", r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"),
    ("hi", r"[\x{0900}-\x{097F}]"),
    ("th", r"[\x{0E00}-\x{0E7F}]"),
    ("en", r"[A-Za-z\x{C0}-\x{24F}]"),
]
KANA = r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"
CJK = r"[\x{4E00}-\x{9FFF}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, rf"^{WHITE}+", ""), rf"{WHITE}+\z", "")


def blank_to_null(c: Column) -> Column:
    """The stripped text, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def clean_special(c: Column) -> Column:
    """Control and zero-width characters go, then all line ends become LF."""
    return F.regexp_replace(F.regexp_replace(c, CONTROL, ""), r"\r\n?", "\n")


def clean_text(c: Column) -> Column:
    """Blanks collapse, repeated punctuation collapses, more than two LF become two, ends are stripped."""
    out = F.regexp_replace(c, BLANKS, " ")
    out = F.regexp_replace(out, r"([!?,.:;])\1+", "$1")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def normalize_lines(c: Column) -> Column:
    """Every line is stripped; runs of blank lines become one; none at the ends."""
    lines = F.array_join(F.transform(F.split(c, "\n", -1), strip), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def cap_newlines(c: Column, most: int = 2) -> Column:
    """T4."""
    return F.regexp_replace(c, r"\n{%d,}" % (most + 1), "\n" * most)


def clean_all(c: Column, special: bool = True, text: bool = True, lines: bool = True, newlines: int | None = 2) -> Column:
    """T5: the steps in their order, each of which can be left out."""
    for wanted, step in ((special, clean_special), (text, clean_text), (lines, normalize_lines)):
        c = step(c) if wanted else c
    return cap_newlines(c, newlines) if newlines else c


def language(c: Column, fallback: str = "en") -> Column:
    """Kana first (3 or more, and 5 % of all letters), else the script with most letters, ties in the list's order.

    Texts of ASCII alone can only be of one script. In others each script's letters are counted once.
    """
    left = lambda pattern: F.length(c) - F.length(F.regexp_replace(c, pattern[:-1] + "]+", ""))
    counted = F.struct(left(KANA).alias("kana"), *(left(p).alias(name) for name, p in SCRIPTS))

    def chosen(n: Column) -> Column:
        scripts = [n[name] for name, _ in SCRIPTS]
        most, total = F.greatest(*scripts), sum(scripts, n["kana"])
        out = F.when((n["kana"] >= 3) & (n["kana"] * 20 >= total), "ja").when(most == 0, fallback)
        for name, _ in SCRIPTS:
            out = out.when(n[name] == most, name)
        return out

    plain = F.when(c.rlike("[A-Za-z]"), "en").otherwise(fallback)
    mixed = F.transform(F.array(counted), chosen)[0]
    return F.when(c.isNull(), fallback).when(F.octet_length(c) == F.length(c), plain).otherwise(mixed)


def token_estimate(c: Column) -> Column:
    """max(1, floor(cjk / 1.6) + floor(other / 4)); 0 for nothing."""
    cjk = F.regexp_count(c, F.lit(CJK))
    n = F.floor(cjk / 1.6) + F.floor((F.length(c) - cjk) / 4)
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, 0).otherwise(F.greatest(n, F.lit(1))).cast("long")


def message_text(*parts: Column) -> Column:
    """What is not empty, line by line."""
    return F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts))


def truncate_middle(c: Column, most: int, mark: str = "\n...[omitted]...\n") -> Column:
    """70 % of the room for the head, the rest for the tail."""
    head = int(most * 0.7)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(most - head))))


def fallback_title(c: Column, most: int = 20) -> Column:
    """One line, its first characters, without punctuation at the end."""
    return F.regexp_replace(F.left(F.regexp_replace(strip(c), r"\n", " "), F.lit(most)), r"[,.!?;:，。！？；： ]+\z", "")


def preview(c: Column, most: int = 200) -> Column:
    """X14."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)


def cited_aliases(c: Column) -> Column:
    """X11: distinct [cN] marks, in order of appearance, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\[c(\d{1,6})\]"), F.lit(1)), lambda n: F.concat(F.lit("c"), n)))


def error_type(c: Column) -> Column:
    """The first line, cut to 50 characters."""
    first = F.split(c, "\n")[0]
    return F.when(F.length(first) > 50, F.concat(F.left(first, F.lit(50)), F.lit("..."))).otherwise(first)


#: Fixed values.
STAGE_PROGRESS = {"parse": 0.10, "split": 0.40, "section_summary": 1.00}


def stage_progress(stage: Column) -> Column:
    """An unknown stage counts as done."""
    pairs = [x for k, v in STAGE_PROGRESS.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), stage), F.lit(1.0))


def backoff(n: Column, base: float, most: float, kind: str = "exponential") -> Column:
    """The first n delays."""
    step = {"fixed": lambda i: F.lit(base), "linear": lambda i: F.lit(base) * (i + 1), "exponential": lambda i: F.lit(base) * F.pow(F.lit(2.0), i)}[kind]
    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.least(step(i).cast("double"), F.lit(float(most))))


def html_table_text(c: Column) -> Column:
    """Rows as 'a | b' lines, tags stripped, a cell in one line; a text without a row start stays, and one without a whole row with cells."""
    rows = F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.filter(F.transform(rows, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))), lambda x: F.size(x) > 0)
    cell = lambda x: F.replace(strip(F.regexp_replace(x, r"<[^>]+>", "")), F.lit("\n"), F.lit(" "))
    lines = F.transform(cells, lambda x: F.array_join(F.transform(x, cell), " | "))
    return F.when(~F.lower(c).contains("<tr"), c).when(F.size(cells) > 0, F.array_join(lines, "\n")).otherwise(strip(c))


def table_text(caption: Column, body: Column, footnote: Column) -> Column:
    """The three parts under their names; what is blank is left out."""
    part = lambda name, c: F.concat(F.lit(name + ": "), blank_to_null(c))
    return F.concat_ws("\n", part("table_caption", caption), part("table_body", body), part("table_footnote", footnote))


def table_part(text: Column, name: str) -> Column:
    """One part read back from a table's text."""
    return blank_to_null(F.regexp_extract(text, rf"(?im)^table_{name}:\s*(.*)$", 1))


def image_text(caption: Column, footnote: Column, section: Column, page: Column) -> Column:
    """Caption and footnote, else the section and the page's number from 1."""
    own = F.nullif(F.concat_ws("\n", blank_to_null(caption), blank_to_null(footnote)), F.lit(""))
    return F.coalesce(own, F.concat_ws(" ", blank_to_null(section), F.concat(F.lit("page "), (page + 1).cast("string"))))


def chunk_text(kind: Column, stored: Column, text: Column, image: Column, tab: Column) -> Column:
    """The stored search text, else what the chunk's type says."""
    return F.coalesce(blank_to_null(stored), F.when(kind == "image", image).when(kind == "table", tab).otherwise(text))


def file_type(path: Column) -> Column:
    """The extension, lower case, checked against the known ones; null for others."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    kinds = {"pdf": "pdf", "doc": "word", "docx": "word", "ppt": "ppt", "pptx": "ppt", "xls": "excel", "xlsx": "excel", "csv": "csv", "json": "json", "txt": "txt", "md": "markdown", "png": "image", "jpg": "image", "jpeg": "image"}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), ext)


def byte_range(header: Column, total: Column) -> Column:
    """(start, end, length) of an HTTP range, or null where it is malformed, of several parts or out of reach."""
    part = lambda i: F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", i)
    number = lambda c: F.nullif(c, F.lit("")).cast("long")
    a, b = number(part(1)), number(part(2))
    start = F.when(a.isNotNull(), a).when(b > 0, F.greatest(total - b, F.lit(0)))
    end = F.when(a.isNull(), total - 1).otherwise(F.least(F.coalesce(b, total - 1), total - 1))
    return F.when(header.rlike(r"^bytes=\d*-\d*\z") & start.isNotNull() & (start < total) & (end >= start), F.struct(start.alias("start"), end.alias("end"), (end - start + 1).alias("length")))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Typed ids that are the same in every run."""
    return F.concat(F.lit(f"{prefix}-"), F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256))


def rebased(path: Column, old: Column, new: Column) -> Column:
    """A path under old, moved below new."""
    return F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))


def substitute_ids(c: Column, aliases: Column) -> Column:
    """Full ids in a text replaced by their aliases, an array of (id, alias) structs, longest ids first."""
    longest = F.array_sort(F.transform(aliases, lambda a: F.struct((-F.length(a["id"])).alias("n"), a["id"].alias("id"), a["alias"].alias("alias"))))
    return F.aggregate(longest, c, lambda text, a: F.replace(text, a["id"], a["alias"]))


def looks_like_alias(c: Column) -> Column:
    """X10, Q26."""
    return F.coalesce(c.rlike(r"^c[0-9]+$"), F.lit(False))


def distinct_ids(ids: Column) -> Column:
    """In order of first appearance; blank ones go."""
    return F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))


def resolve_aliases(names: Column, aliases: Column) -> Column:
    """(ids, unresolved): full ids of a list of aliases or ids; aliases that name nothing are reported."""
    known = F.map_from_entries(F.transform(aliases, lambda a: F.struct(a["alias"], a["id"])))
    one = lambda x: F.when(looks_like_alias(x), F.try_element_at(known, x)).otherwise(x)
    found = F.filter(F.transform(distinct_ids(names), one), lambda x: x.isNotNull())
    lost = F.filter(distinct_ids(names), lambda x: looks_like_alias(x) & F.try_element_at(known, x).isNull())
    return F.struct(F.array_distinct(found).alias("ids"), lost.alias("unresolved"))


def page_position(bbox: Column) -> Column:
    """Q33: a box as JSON, if it has four numbers."""
    return F.when(F.size(bbox) == 4, F.to_json(bbox))


def chunk_texts(kind: Column, text: Column, caption: Column, body: Column, footnote: Column, section: Column, page: Column) -> Column:
    """(search, display): what is searched and what is shown of a chunk, by its kind."""
    table = F.struct(table_text(caption, html_table_text(body), footnote).alias("search"), table_text(caption, body, footnote).alias("display"))
    shown = image_text(caption, footnote, section, page)
    image = F.struct(shown.alias("search"), shown.alias("display"))
    return F.when(kind == "table", table).when(kind == "image", image).otherwise(F.struct(text.alias("search"), text.alias("display")))


def enhanced_text(title: Column, text: Column) -> Column:
    """A chunk's text below its section's title."""
    return F.concat_ws("\n", blank_to_null(title), text)
