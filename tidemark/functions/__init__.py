"""The engine's scalar functions, as SQL functions and for columns; both expand to built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BUCKET = """CASE WHEN {step} IS NULL OR {ts} IS NULL THEN NULL
  WHEN {step} <= 0 THEN CAST(raise_error('time_bucket interval must be positive') AS BIGINT)
  ELSE coalesce(try_subtract({ts}, pmod({ts}, {step})), -9223372036854775807L - 1L) END"""

#: Name, parameters, result, body. Functions that other SQL dialects have and Spark lacks come after the engine's own.
SQL_FUNCTIONS = [
    ("time_bucket", "step BIGINT, ts BIGINT", "BIGINT", _BUCKET.format(step="step", ts="ts")),
    ("delta", "a DOUBLE, b DOUBLE", "DOUBLE", "a - b"),
    ("delta_i64", "a BIGINT, b BIGINT", "BIGINT", "a - b"),
    ("rate", "a DOUBLE, b DOUBLE, dt_ms BIGINT", "DOUBLE", "(a - b) / nullif(CAST(dt_ms AS DOUBLE), 0)"),
    ("strpos", "s STRING, part STRING", "BIGINT", "CAST(instr(s, part) AS BIGINT)"),
    ("starts_with", "s STRING, part STRING", "BOOLEAN", "startswith(s, part)"),
    ("ends_with", "s STRING, part STRING", "BOOLEAN", "endswith(s, part)"),
    ("date_bin", "step INTERVAL DAY TO SECOND, t TIMESTAMP, origin TIMESTAMP", "TIMESTAMP", "timestamp_micros(unix_micros(t) - pmod(unix_micros(t) - unix_micros(origin), unix_micros(origin + step) - unix_micros(origin)))"),
    ("gcd_i64", "a BIGINT, b BIGINT", "BIGINT", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE aggregate(sequence(1, 96), struct(abs(a) AS x, abs(b) AS y), (s, i) -> struct(CASE WHEN s.y = 0 THEN s.x ELSE s.y END AS x, CASE WHEN s.y = 0 THEN 0L ELSE s.x % s.y END AS y), s -> s.x) END"),
    ("trunc_number", "x DOUBLE, digits INT", "DOUBLE", "CASE WHEN x < 0 THEN -floor(-x * power(10D, digits)) / power(10D, digits) ELSE floor(x * power(10D, digits)) / power(10D, digits) END"),
]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL; they inline into plans. Can be called again."""
    for name, parameters, result, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def _column(x: Column | str | int | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def time_bucket(step: Column | int, ts: Column | str) -> Column:
    """The largest multiple of step that is ts or less; null if either is, an error if step isn't positive."""
    step, ts = _column(step).cast("long"), _column(ts)
    least = F.expr("-9223372036854775807L - 1L")
    return (
        F.when(step.isNull() | ts.isNull(), None)
        .when(step <= 0, F.raise_error(F.lit("time_bucket interval must be positive")).cast("long"))
        .otherwise(F.coalesce(F.try_subtract(ts, F.pmod(ts, step)), least))
    )


def delta(a: Column | str, b: Column | str) -> Column:
    return _column(a).cast("double") - _column(b).cast("double")


def delta_i64(a: Column | str, b: Column | str) -> Column:
    return _column(a).cast("long") - _column(b).cast("long")


def rate(a: Column | str, b: Column | str, dt_ms: Column | str) -> Column:
    """(a - b) per millisecond; null if any is, or if no time passed."""
    return delta(a, b) / F.nullif(_column(dt_ms).cast("double"), F.lit(0.0))


def array_has(xs: Column | str, x: Column | str | int) -> Column:
    return F.array_contains(_column(xs), _column(x))


def array_length(xs: Column | str) -> Column:
    return F.array_size(_column(xs)).cast("long")


def make_array(*xs: Column | str | int) -> Column:
    return F.array(*map(_column, xs))


def approx_distinct(x: Column | str) -> Column:
    return F.approx_count_distinct(_column(x))
