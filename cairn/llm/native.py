"""Column helpers for the operators that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A broadcast table has at most this many rows and about this many bytes; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
#: Code points of the pieces that parts_of() cuts a text into.
PIECE = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and no other letter changed; plain ASCII texts take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def weight(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of df, about: the length of its rows as JSON. One aggregate reaches the driver."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return n, size


def bounded(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if its counted rows and bytes are few enough. It is read twice, so it should be cut."""
    rows, size = weight(df)
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def run_of(size: Column) -> Column:
    """0 .. size - 1; empty for 0 or less."""
    return F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """The running states of a fold: step(zero, x0), step(step(zero, x0), x1), ...

    A fold that appends to one array copies it each time. Here about sqrt(n) items are folded at once and then
    appended together, so n items cost about n * sqrt(n) copies of a state.
    """

    def over(array: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1))
        none = F.slice(F.array(zero), 2, 1)

        def one(a: Column, x: Column) -> Column:
            return let(step(a["state"], x), lambda s: F.struct(s.alias("state"), F.array_append(a["out"], s).alias("out")))

        def many(a: Column, i: Column) -> Column:
            part = F.aggregate(F.slice(array, i * width + 1, width), F.struct(a["state"].alias("state"), none.alias("out")), one)
            return let(part, lambda p: F.struct(p["state"].alias("state"), F.array_append(a["out"], p["out"]).alias("out")))

        start = F.struct(zero.alias("state"), F.slice(F.array(none), 2, 1).alias("out"))
        return F.aggregate(run_of(F.ceil(F.size(array) / width).cast("int")), start, many, lambda a: F.flatten(a["out"]))

    return let(items, over)


def sums(values: Column) -> Column:
    """Running sums of an array of ints, each with its own value in it."""
    return scan(values, F.lit(0), lambda a, x: a + x)


def parts_of(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """body(part), where part(start, end) is the text between two code points, found without reading all before it."""

    def with_pieces(pieces: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            last = F.floor(end / PIECE).cast("int")
            near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.substring(near, start - first * PIECE + 1, end - start)

        return body(part)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), with_pieces)
