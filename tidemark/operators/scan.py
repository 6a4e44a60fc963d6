"""Range scans with conjunctive predicates."""

from __future__ import annotations

import operator
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.types import SEQ, TS, Columns, SchemaError, fits

Predicate = tuple[str, str, Any]
_COMPARE = {"=": operator.eq, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}


def condition(columns: Columns, predicate: Predicate) -> Column | None:
    """A comparison of a column with a literal; None if there is no such column or the literal is of another type.

    Null satisfies none. NaN satisfies none either, although Spark orders it above all numbers.
    """
    name, op, literal = predicate
    if op not in _COMPARE:
        raise SchemaError(f"no comparison {op!r}")
    kind = dict(columns).get(name)
    if kind is None or literal is None or not fits(literal, kind):
        return None
    if literal != literal:  # NaN
        return F.lit(False)
    column = F.col(f"`{name}`")
    found = _COMPARE[op](column, F.lit(literal))
    return found & ~F.isnan(column) if kind == "f64" and op in ("=", ">", ">=") else found


def filtered(rows: DataFrame, columns: Columns, start: int, end: int, predicates: Iterable[Predicate] = ()) -> DataFrame:
    """Rows with start <= ts_ms <= end that satisfy all predicates; the comparisons reach the Parquet reader."""
    conditions = [c for p in predicates if (c := condition(columns, p)) is not None]
    return rows.where(reduce(operator.and_, conditions, F.col(TS).between(start, end)))


def in_order(rows: DataFrame) -> DataFrame:
    """By time; rows of one time in the order in which they were appended."""
    return rows.orderBy(TS, SEQ).drop(SEQ)
