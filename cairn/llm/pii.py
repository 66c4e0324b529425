"""Personal data in texts: fixed shapes, and contextual patterns that they bootstrap, by DataFrame functions only.

Matches of the fixed shapes (email, ip, card, phone) are the seeds. The two words before a seed are a lexical
pattern for its kind. Patterns and the identifier-like tokens that follow them form a graph, which Spark scores for
some rounds: a pattern is worth what share of its distinct fills is held to be of a kind, a token what its best
patterns are worth. Patterns that could not be sure even if all of their unknown fills were of their best kind are
worth nothing, so plain words need to be counted only after the others. Tokens of patterns that end up with a high confidence are reported as further spans, and are seeds
in turn, until no further token is found.

Kinds are numbered 0 email, 1 ip, 2 card, 3 phone. Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.native import bounded, let, parts_of, run_of, scan, sums
from cairn.llm.runtime import cut

KINDS = ["email", "ip", "card", "phone"]
#: Loops are written over single character classes or with small bounds, as Java's matcher recurses in others.
#: Each finds the leftmost, longest, non-overlapping matches of the plain shape in the comment.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?![A-Za-z0-9-])(?!\.[A-Za-z0-9-])"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"  # [0-9]([\x20-]?[0-9])+ with 12 to 19 digits
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
_PLACED = "array<struct<start:int,kind:int,end:int,value:string,left:string>>"

#: A pattern needs this many distinct seeds, and this confidence, before its other fills count.
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
ROUNDS = 3
_CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Numbers in parts, such as 555 123 4567: runs of two to six words of digits.
_PART = r"[(]?[0-9][0-9().-]*+"
_PARTS = rf"(?<!\S){_PART}(?:\x20{_PART}(?=[\s,;:!?]|\z)){{1,5}}+"
#: A context is two whole words within this many code points before a token.
CONTEXT = 80
_CONTEXT = r"\s(\S+\s+\S+)\s+\z"
#: The matches before a token that reach over a context, as each has at least 3 code points.
_NEAR = 27
#: What may frame an identifier without being part of it.
_EDGES = "\"'()[]{}<>,;:!?.*#$%&|"


def _context(before: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(before, _CONTEXT, 1)), r"\s+", " ")


def _found(text: Column, pattern: str, kind: int, keep) -> Column:
    """array<(start, kind, end, value, left)> of a pattern's matches that keep() accepts; left is what context each has.

    Positions are running sums, and a context is read from the few pieces before its match, so the work
    grows with the text and not with its square.
    """

    def matches(hits: Column, gaps: Column) -> Column:
        # text starts as if after white space, so that its first word counts as whole
        gap = lambda i: F.when(i == 0, F.concat(F.lit(" "), gaps[i])).otherwise(gaps[i])
        pair = lambda i: F.concat(gap(i), hits[i])

        def before(i: Column) -> Column:
            first = F.greatest(i - _NEAR, F.lit(0))
            near = F.concat(F.array_join(F.when(i > 0, F.transform(F.sequence(first, F.greatest(i - 1, F.lit(0))), pair)).otherwise(F.array().cast("array<string>")), ""), gap(i))
            return F.when(F.length(gaps[i]) >= CONTEXT, F.right(gaps[i], F.lit(CONTEXT))).otherwise(F.right(near, F.lit(CONTEXT)))

        def span(i: Column, end: Column) -> Column:
            return F.struct((end - F.length(hits[i])).alias("start"), F.lit(kind).alias("kind"), end.alias("end"), hits[i].alias("value"), i.alias("at"))

        ends = sums(F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.length(h) + F.length(g)))
        kept = F.filter(F.transform(ends, lambda e, i: span(i, e)), lambda s: keep(s["value"]))
        return F.transform(kept, lambda s: F.struct(*(s[c].alias(c) for c in ("start", "kind", "end", "value")), _context(before(s["at"])).alias("left")))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return let(both, lambda m: F.when(F.size(m["hits"]) > 0, matches(m["hits"], m["gaps"])).otherwise(F.array().cast(_PLACED)))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return a + F.when(F.pmod(i, F.lit(2)) == 1, d).otherwise(F.pmod(2 * d, F.lit(10)) + F.floor(2 * d / 10).cast("int"))

    return F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add), F.lit(10)) == 0


def base_spans(text: Column) -> Column:
    """The fixed shapes' spans, by start and then kind: array<(start, kind, end, value, left)>; null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    when = lambda has, spans: F.when(has, spans).otherwise(F.array().cast(_PLACED))
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    digit = text.rlike("[0-9]")
    every = [
        when(text.contains("@"), _found(text, EMAIL, 0, lambda v: F.lit(True))),
        when(digit & text.contains("."), _found(text, IP, 1, lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))),
        when(digit, _found(text, CARD, 2, _luhn)),
        when(text.contains("+") & digit, _found(text, PHONE, 3, lambda v: digits(v).between(9, 15))),
    ]
    return F.array_sort(F.concat(*every))


def _apart(spans: Column, others: Column) -> Column:
    """Of spans that don't meet each other, by start: those that meet none of the others. One sort and two sweeps."""
    event = lambda own: lambda s: F.struct(s["start"].alias("at"), F.lit(own).alias("own"), s["end"].alias("end"))
    far = F.lit((1 << 31) - 1)

    def swept(events: Column) -> Column:
        reach = scan(events, F.lit(-1), lambda a, e: F.greatest(a, F.when(e["own"] == 0, e["end"]).otherwise(-1)))
        ahead = F.reverse(scan(F.reverse(events), far, lambda a, e: F.when(e["own"] == 0, e["at"]).otherwise(a)))
        free = F.zip_with(F.zip_with(events, reach, lambda e, r: F.struct(e.alias("e"), (r <= e["at"]).alias("free"))), ahead, lambda x, n: F.struct(x["e"]["own"].alias("own"), (x["free"] & (n >= x["e"]["end"])).alias("free")))
        marked = F.zip_with(spans, F.filter(free, lambda x: x["own"] == 1), lambda s, x: F.struct(s.alias("s"), x["free"].alias("free")))
        return F.transform(F.filter(marked, lambda x: x["free"]), lambda x: x["s"])

    both = F.array_sort(F.concat(F.transform(spans, event(1)), F.transform(others, event(0))))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(both, swept))


def _tokens(text: Column, has: str, pattern: str) -> Column:
    """A pattern's matches without what frames them: array<(start, kind -1, end, value, left)>."""

    def trim(s: Column) -> Column:
        left = F.ltrim(s["value"], F.lit(_EDGES))
        value = F.rtrim(left, F.lit(_EDGES))
        start = s["start"] + F.length(s["value"]) - F.length(left)
        return F.struct(start.alias("start"), s["kind"].alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"), s["left"].alias("left"))

    return F.when(text.rlike(has), F.transform(_found(text, pattern, -1, lambda v: F.lit(True)), trim)).otherwise(F.array().cast(_PLACED))


def _scanned(table: DataFrame) -> DataFrame:
    """(doc_id, text_key, base, seeds, tokens): the base spans, and the identifier-like tokens that meet none of them.

    A number in parts is one token, unless a base span meets it; then its words are tokens. Step by step, as
    one expression of all of this would be too deep for the analyzer; all steps run in one stage.
    """
    some = lambda s: (F.length(s["value"]) >= 4) & (s["left"] != "")
    rows = table.withColumn("base", base_spans(F.col("text")))
    rows = rows.withColumn("parts", _tokens(F.col("text"), r"[0-9][().-]*\x20[(]?[0-9]", _PARTS)).withColumn("words", _tokens(F.col("text"), "[0-9@]", _CANDIDATE))
    rows = rows.withColumn("parts", _apart(F.col("parts"), F.col("base")))
    rows = rows.withColumn("words", _apart(F.col("words"), F.concat("base", "parts")))
    tokens = F.filter(F.concat("parts", "words"), some)
    base = F.transform("base", lambda s: s.dropFields("left"))
    seeds = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), s["left"].alias("left")))
    return rows.select("doc_id", "text_key", base.alias("base"), seeds.alias("seeds"), F.transform(tokens, lambda s: s.dropFields("kind")).alias("tokens"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, base, found): base spans of every row of docs, and the spans that contexts add.

    Both are arrays of (start, kind, end, value) by start and kind. A found span never overlaps a base one. Null
    texts count as empty and have none; rows that repeat an id are answered each for its own text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    table = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    scanned = cut(_scanned(table))

    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.*").filter("left <> ''").select("left", "value", "kind").distinct()
    tokens = scanned.select("doc_id", "text_key", F.explode("tokens").alias("t")).select("doc_id", "text_key", "t.*")
    # fills of accepted patterns are seeds of the next turn, until none is new; what is accepted stays
    known = good = plain = placed = None
    while True:
        held = seeds if known is None else seeds.union(tokens.join(bounded(known), "value").select("left", "value", "kind")).distinct()
        patterns = held.groupBy("left").agg(*(F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(4)))
        patterns = cut(patterns.filter(F.greatest("k0", "k1", "k2", "k3") >= MIN_SEEDS).select("left"))
        if patterns.isEmpty():
            break
        few = bounded(patterns)
        placed = cut(tokens.join(few, "left"))
        edges = held.join(few, "left").select("left", "value", "kind").union(placed.select("left", "value", F.lit(-1).alias("kind")))
        edges = cut(edges.groupBy("left", "value").agg(F.max("kind").alias("kind")))
        patterns = cut(_viable(edges))
        if patterns.isEmpty():
            break
        edges = cut(edges.join(bounded(patterns), "left"))
        fresh = patterns if plain is None else cut(patterns.join(plain, "left", "left_anti"))
        if not fresh.isEmpty():
            words = fresh.join(_plain_fills(table, fresh), "left", "left").fillna(0, ["plain"])
            plain = cut(words if plain is None else plain.union(words))
        score = _scored(edges, plain)
        best = F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind")
        sure = score.filter((F.col("confidence") >= MIN_CONFIDENCE) & (F.col("seeds") >= MIN_SEEDS))
        sure = sure.groupBy("left").agg(best, F.max("confidence").alias("confidence"))
        good = cut(sure if good is None else good.union(sure.join(good, "left", "left_anti")))
        fills = placed.join(bounded(good), "left").groupBy("value").agg(best)
        new = cut(fills if known is None else fills.join(known, "value", "left_anti"))
        if new.isEmpty():
            break
        known = cut(new if known is None else known.union(new))
    if good is not None:
        found = placed.join(bounded(good), "left").select("doc_id", "text_key", F.struct("start", "kind", "end", "value").alias("span"))
    else:
        found = tokens.select("doc_id", "text_key", F.struct("start", F.lit(0).alias("kind"), "end", "value").alias("span")).limit(0)
    found = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.array_sort(F.collect_set("span")).alias("found"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    met = scanned.select("doc_id", "text_key", "base").join(found, on, "left")
    return met.select("doc_id", "text_key", "base", F.coalesce("found", F.array().cast(_SPANS)).alias("found"))


def _viable(edges: DataFrame) -> DataFrame:
    """(left) of the patterns that would be sure enough if all of their unknown fills, and no plain word, were of their best kind."""
    count = edges.groupBy("left").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(-1, 4)))
    return count.filter((F.greatest("k0", "k1", "k2", "k3") + F.col("k-1")) / (F.col("n") + 1) >= MIN_CONFIDENCE).select("left")


def _scored(edges: DataFrame, plain: DataFrame) -> DataFrame:
    """(left, kind, seeds, confidence) of all patterns, after some rounds over the graph."""
    sure = edges.filter("kind >= 0").select("value", "kind", F.lit(1.0).alias("held")).distinct()
    whole = cut(edges.groupBy("left").agg(F.count(F.lit(1)).alias("fills")).join(plain, "left").select("left", (F.col("fills") + F.col("plain")).alias("fills")))
    belief = sure
    for _ in range(ROUNDS):
        worth = edges.select("left", "value").join(belief, "value").groupBy("left", "kind").agg(F.sum("held").alias("held"), F.count_if(F.col("held") == 1).alias("seeds"))
        # the share of fills that are held to be of the kind, where one unseen fill counts against it
        score = cut(worth.join(whole, "left").select("left", "kind", "seeds", (F.col("held") / (F.col("fills") + 1)).alias("confidence")))
        guess = edges.filter("kind < 0").select("left", "value").join(score.filter(F.col("seeds") >= MIN_SEEDS).select("left", F.col("kind").alias("as"), "confidence"), "left").groupBy("value", "as").agg(F.max("confidence").alias("held"))
        belief = cut(sure.union(guess.select("value", F.col("as").alias("kind"), "held").filter("held < 1")))
    return score


def _plain_fills(table: DataFrame, patterns: DataFrame) -> DataFrame:
    """(left, plain): how many distinct plain words, without digit or @, follow each pattern anywhere."""
    words = table.select(F.split(F.lower("text"), r"\s+", -1).alias("w")).select("w", F.explode(run_of(F.size("w") - 2)).alias("i"))
    rows = words.select(F.xxhash64(F.col("w")[F.col("i")], F.col("w")[F.col("i") + 1]).alias("h"), F.col("w")[F.col("i") + 2].alias("next"))
    two = F.split("left", " ")
    hashed = cut(patterns.select("left", F.xxhash64(two[0], two[1]).alias("h")))
    met = rows.join(bounded(hashed), "h").filter(~F.col("next").rlike("[0-9@]"))
    return cut(met.groupBy("left").agg(F.count_distinct(F.xxhash64("next")).alias("plain")))


def digest(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found): counts are of base spans."""
    rows = personal_data(docs, id_col, text_col)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *(count(k) for k in range(4)), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.concat("base", "found")).alias("spans"), F.size("found").cast("long").alias("n_found"))


def _masked(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by the label of the first."""
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def replaced(part, reach: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1))
        heads = F.filter(F.zip_with(spans, before, lambda s, b: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), b.alias("before"))), lambda s: s["start"] >= s["before"])
        shown = F.transform(heads, lambda s: F.concat(part(s["before"], s["start"]), labels[s["kind"]]))
        return F.concat(F.array_join(shown, ""), part(F.element_at(reach, -1), F.length(text)))

    return let(scan(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"])), lambda reach: parts_of(text, lambda part: replaced(part, reach)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all personal data in the text replaced by [EMAIL], [IP], [CARD] or [PHONE]; other columns, nulls and clean texts stay."""
    rows = personal_data(docs, id_col, text_col)
    rows = rows.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.concat("base", "found").alias("__spans"))
    rows = cut(rows.filter(F.size("__spans") > 0).dropDuplicates(["__id", "__key"]))
    keyed = docs.withColumn("__of", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    on = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__of") == F.col("__key"))
    met = keyed.join(bounded(rows), on, "left")
    text = F.when(F.col("__spans").isNotNull(), _masked(F.col(text_col), F.array_sort("__spans"))).otherwise(F.col(text_col))
    return met.withColumn(text_col, text).drop("__of", "__id", "__key", "__spans")
