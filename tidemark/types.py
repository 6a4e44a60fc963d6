"""Column types of engine tables: names, schemas, strict checks and INSERT's coercion."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import types as T

TS, ALIAS, SEQ = "ts_ms", "ts", "_seq"
LEAST, MOST = -(2**63), 2**63 - 1

#: The type names that tables are declared with.
NAMES = {
    "f64": "f64", "float": "f64", "double": "f64", "real": "f64",
    "i64": "i64", "int": "i64", "integer": "i64", "bigint": "i64",
    "bool": "bool", "boolean": "bool",
    "text": "utf8", "string": "utf8", "utf8": "utf8", "str": "utf8",
}
SPARK = {"f64": T.DoubleType(), "i64": T.LongType(), "bool": T.BooleanType(), "utf8": T.StringType()}

Columns = list[tuple[str, str]]


class SchemaError(ValueError):
    """A table, row or batch does not fit its declaration."""


def columns_of(declared: Iterable[tuple[str, str]]) -> Columns:
    """Names with canonical types; time columns and what the engine adds can't be declared."""
    out: Columns = []
    for name, kind in declared:
        canonical = NAMES.get(kind.strip().lower())
        if canonical is None:
            raise SchemaError(f"unknown type {kind!r} of column {name!r}")
        if not name or name.lower() in (TS, ALIAS, SEQ):
            raise SchemaError(f"column name {name!r} is reserved")
        if name.lower() in (n.lower() for n, _ in out):
            raise SchemaError(f"column {name!r} is declared twice")
        out.append((name, canonical))
    if not out:
        raise SchemaError("a table needs a value column")
    if len(out) > 65_535:
        raise SchemaError("a table has 65535 columns at most")
    return out


def row_schema(columns: Columns, seq: bool = False) -> T.StructType:
    fields = [T.StructField(TS, T.LongType(), False), *(T.StructField(n, SPARK[k], True) for n, k in columns)]
    return T.StructType([*fields, T.StructField(SEQ, T.LongType(), False)] if seq else fields)


def fits(value: Any, kind: str) -> bool:
    """Whether a value is of exactly this type; null fits any."""
    if value is None:
        return True
    if kind == "bool":
        return isinstance(value, bool)
    if kind == "i64":
        return isinstance(value, int) and not isinstance(value, bool) and LEAST <= value <= MOST
    return isinstance(value, float if kind == "f64" else str)


def check_ts(ts_ms: Any) -> int:
    if isinstance(ts_ms, bool) or not isinstance(ts_ms, int) or not LEAST <= ts_ms <= MOST:
        raise SchemaError(f"time {ts_ms!r} is no 64-bit integer")
    return ts_ms


def check_row(columns: Columns, values: Sequence[Any]) -> tuple:
    if len(values) != len(columns):
        raise SchemaError(f"{len(values)} values for {len(columns)} columns")
    for value, (name, kind) in zip(values, columns, strict=True):
        if not fits(value, kind):
            raise SchemaError(f"{value!r} in column {name!r} is not {kind}")
    return tuple(values)


def coerced(value: Any, kind: str) -> Any:
    """What INSERT stores for a literal: whole numbers and doubles convert where nothing is lost."""
    if fits(value, kind):
        return value
    if kind == "f64" and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if kind == "i64" and isinstance(value, float) and math.isfinite(value) and value.is_integer() and LEAST <= value <= MOST:
        return int(value)
    raise SchemaError(f"{value!r} can't be stored as {kind}")
