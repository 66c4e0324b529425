"""Predicates and scopes."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def every(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def some(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def metadata_filter(user_id=None, document_id=None, document_ids: Sequence | None = None, knowledge_base_id=None, label_id=None, type=None) -> Column:  # noqa: A002
    """what is given must hold; nothing given, nothing filtered."""
    equal = {"user_id": user_id, "document_id": document_id, "knowledge_base_id": knowledge_base_id, "label_id": label_id, "type": type}
    out = [F.col(k) == v for k, v in equal.items() if v is not None]
    return every(out + ([F.col("document_id").isin(list(document_ids))] if document_ids else []))


def equal_to(**values: Any) -> Column:
    """equality of each named column; None asks for null."""
    return every(F.col(k).isNull() if v is None else F.col(k) == v for k, v in values.items())


def live(df: DataFrame, deleted: str = "deleted") -> DataFrame:
    """F6."""
    return df.filter(F.col(deleted) == 0)


def in_scope(df: DataFrame, key: str, scope: DataFrame | Sequence | None) -> DataFrame:
    """None leaves df as it is, an empty list leaves nothing, ids or a table of them keep their rows."""
    if scope is None:
        return df
    if isinstance(scope, DataFrame):
        return df.join(scope.select(F.col(scope.columns[0]).alias(key)).distinct(), key, "left_semi")
    return df.filter(F.col(key).isin(list(scope))) if scope else df.limit(0)


def above(df: DataFrame, threshold: float | None, score: str = "score") -> DataFrame:
    """after any limit."""
    return df if threshold is None else df.filter(F.col(score) >= threshold)


def overlapping(first: str, last: str, a: int, b: int) -> Column:
    """F8."""
    return (F.col(first) <= b) & (F.col(last) >= a)


def mentions(keyword: str, *fields: str) -> Column:
    """the keyword stands in some field, whatever its case."""
    return some(F.coalesce(F.lower(F.col(f)).contains(keyword.lower()), F.lit(False)) for f in fields)


def by_name(df: DataFrame, name: str, q: str, limit: int = 20) -> DataFrame:
    """no keyword finds all; at most 50."""
    found = df.filter(F.col(name).contains(q)) if q else df
    return found.orderBy(name, *[c for c in df.columns if c != name][:1]).limit(min(50, max(1, limit)))


def below_path(prefix: str, path: str = "full_path") -> Column:
    """F11."""
    return F.col(path).startswith(prefix)


def holds(array: str, value: Any) -> Column:
    """F12."""
    return F.array_contains(array, value)


def array_edit(array: Column, add: Any = None, remove: Any = None) -> Column:
    """F13."""
    out = F.array_remove(array, remove) if remove is not None else array
    return F.when(F.array_contains(out, add), out).otherwise(F.array_append(out, add)) if add is not None else out


def nested(df: DataFrame, array: str, key: str, ids: Sequence, parent: str) -> DataFrame:
    """the array's structs with a wanted key, and the parent's id."""
    return df.select(parent, F.explode(array).alias("x")).select(parent, "x.*").filter(F.col(key).isin(list(ids)))


def outside(asked: DataFrame, scope: DataFrame, key: str) -> DataFrame:
    """asked ids that the scope doesn't hold."""
    return asked.join(scope.select(key).distinct(), key, "left_anti")
