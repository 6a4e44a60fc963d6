"""A rewrite that Catalyst lacks: conditions on time_bucket as ranges of time, which reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import time_bucket
from tidemark.types import LEAST, MOST, TS


def in_buckets(rows: DataFrame, step: int, first: int, last: int | None = None, column: str = TS) -> DataFrame:
    """Rows whose bucket is from first to last (first alone by default), both multiples of step: as a range of column.

    A bucket that isn't a multiple of step has no rows.
    """
    if step <= 0:
        raise ValueError("time_bucket interval must be positive")
    last = first if last is None else last
    low = first + (-first) % step
    high = last - last % step + step - 1
    return rows.where(F.col(column).between(max(low, LEAST), min(high, MOST))) if low <= high else rows.where(F.lit(False))


def aggregate(rows: DataFrame, step: int, *aggregates, by: tuple[str, ...] = (), column: str = TS) -> DataFrame:
    """One row for each bucket (and by): a partial aggregation before the one shuffle."""
    return rows.groupBy(time_bucket(step, column).alias("bucket"), *by).agg(*aggregates)
