"""Lexical search: match modes, boolean expressions, snippets."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.filters import mentions, some

FIELDS = ("search_text",)


def quoted(keyword: str) -> str:
    """A Java pattern for the keyword itself."""
    return "\\Q" + keyword.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def matches(field: Column, keyword: str, mode: str = "fuzzy") -> Column:
    """L1-L4: exact, prefix, regex or fuzzy, without regard to case; a null field doesn't match."""
    pattern = {"exact": rf"(?iu)^{quoted(keyword)}\z", "prefix": f"(?iu)^{quoted(keyword)}", "regex": f"(?i){keyword}"}
    hit = field.rlike(pattern[mode]) if mode in pattern else F.lower(field).contains(keyword.lower())
    return F.coalesce(hit, F.lit(False))


def grep(df: DataFrame, keywords: Sequence[str], mode: str = "fuzzy", fields: Sequence[str] = FIELDS, top_k: int | None = 10, key: str = "chunk_id") -> DataFrame:
    """Rows with any keyword in any field, score 1.0, the first top_k by key."""
    hits = df.filter(some(matches(F.col(f), k, mode) for k in keywords for f in fields)).withColumn("score", F.lit(1.0))
    return hits if top_k is None else hits.orderBy(key).limit(top_k)


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Op:
    name: str
    parts: tuple


_LEXEME = re.compile(r"\s*(?:(\()|(\))|\"([^\"]*)\"|'([^']*)'|([^\s()\"']+))")


def _lexemes(expression: str) -> list[tuple[str, str]]:
    """L6."""
    out, at, text = [], 0, expression.rstrip()
    while at < len(text):
        m = _LEXEME.match(text, at)
        if not m:
            raise ValueError(f"unbalanced quote at {at}")
        at = m.end()
        word = m[5]
        if m[1] or m[2]:
            out.append((m[1] or m[2], ""))
        elif word is not None and word.upper() in ("AND", "OR", "NOT"):
            out.append((word.upper(), ""))
        else:
            out.append(("term", next(g for g in (m[3], m[4], word) if g is not None)))
    return out


def parse_boolean(expression: str) -> Term | Op:
    """NOT binds before AND, AND before OR; two terms need an operator between them.

    Operators wait on a stack until one that binds less comes.
    """
    binds = {"OR": 1, "AND": 2, "NOT": 3}
    values: list[Term | Op] = []
    waiting: list[str] = []

    def settle(least: int) -> None:
        while waiting and waiting[-1] != "(" and binds[waiting[-1]] >= least:
            name = waiting.pop()
            if len(values) < (1 if name == "NOT" else 2):
                raise ValueError(f"{name} lacks a term")
            right = values.pop()
            values.append(Op(name, (right,) if name == "NOT" else (values.pop(), right)))

    wants_term = True
    for kind, text in _lexemes(expression):
        if kind in ("term", "(", "NOT"):
            if not wants_term:
                raise ValueError(f"an operator is missing before {text or kind}")
            if kind == "term":
                values.append(Term(text))
                wants_term = False
            else:
                waiting.append(kind)
        elif wants_term:
            raise ValueError(f"a term is missing before {kind}")
        elif kind == ")":
            settle(1)
            if not waiting:
                raise ValueError("unbalanced )")
            waiting.pop()
        else:
            settle(binds[kind])
            waiting.append(kind)
            wants_term = True
    if wants_term:
        raise ValueError("the expression ends early")
    settle(1)
    if waiting:
        raise ValueError("unbalanced (")
    return values[0]


def boolean_condition(tree: Term | Op, fields: Sequence[str] = FIELDS) -> Column:
    """Two-valued; a null field counts as no match."""
    if isinstance(tree, Term):
        return mentions(tree.text, *fields)
    parts = [boolean_condition(p, fields) for p in tree.parts]
    return ~parts[0] if tree.name == "NOT" else parts[0] & parts[1] if tree.name == "AND" else parts[0] | parts[1]


def boolean_search(df: DataFrame, expression: str, fields: Sequence[str] = FIELDS, top_k: int | None = 10, key: str = "chunk_id") -> DataFrame:
    """L9."""
    hits = df.filter(boolean_condition(parse_boolean(expression), fields)).withColumn("score", F.lit(1.0))
    return hits if top_k is None else hits.orderBy(key).limit(top_k)


def resolve_mode(q: str, mode: str) -> str:
    """A literal with an operator in it is a boolean expression."""
    if mode not in ("literal", "regex", "boolean"):
        mode = "literal"
    return "boolean" if mode == "literal" and re.search(r"\b(AND|OR|NOT)\b", q, re.I) else mode


def grep_chunks(df: DataFrame, q: str, mode: str = "literal", top_k: int = 10, context: int = 80, field: str = "search_text", key: str = "chunk_id") -> DataFrame:
    """Checked arguments, hits and their snippets."""
    if not q or len(q) > 500:
        raise ValueError("the query needs 1 to 500 characters")
    top_k, context, mode = min(30, max(1, top_k)), min(300, max(20, context)), resolve_mode(q, mode)
    if mode == "regex":
        re.compile(q)
    hits = boolean_search(df, q, [field], top_k, key) if mode == "boolean" else grep(df, [q], "regex" if mode == "regex" else "fuzzy", [field], top_k, key)
    return hits.withColumn("snippet", snippet(F.col(field), q, mode, context))


def snippet(text: Column, q: str, mode: str = "literal", n: int = 80) -> Column:
    """...before>>>hit<<<after..., n characters on each side; a boolean query shows the beginning."""
    if mode == "boolean":
        return F.when(F.length(text) > 2 * n, F.concat(F.left(text, F.lit(2 * n)), F.lit("..."))).otherwise(text)
    hit = F.regexp_substr(text, F.lit(q)) if mode == "regex" else None
    at = F.instr(text, hit) if mode == "regex" else F.instr(F.lower(text), q.lower())
    size = F.length(hit) if mode == "regex" else F.lit(len(q))
    first = F.greatest(at - n, F.lit(1))
    last = at + size
    shown = F.concat(F.when(first > 1, "...").otherwise(""), F.substring(text, first, at - first), F.lit(">>>"), F.substring(text, at, size), F.lit("<<<"), F.substring(text, last, F.lit(n)), F.when(last + n <= F.length(text), "...").otherwise(""))
    return F.when(F.coalesce(at, F.lit(0)) > 0, shown).otherwise(F.left(text, F.lit(2 * n)))


def effective_query(q: str, params: dict | None) -> str:
    """L13."""
    own = (params or {}).get("query_text")
    return own if own and own.strip() else q
