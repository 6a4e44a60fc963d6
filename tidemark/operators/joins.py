"""Joins that Spark SQL has no syntax for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with the values of the latest right row of the same by whose on isn't later.

    One shuffle by the keys and one sort: sides are tagged, united, and the last right row is carried on. Of right rows at
    one time the one that sorts last by its values is taken. Rows with a null on or by match none.
    """
    carried = F.struct(*(F.col(v) for v in values))
    lefts = left.select(F.struct(*left.columns).alias("~row"), *by, F.col(on).alias("~on"), F.lit(1).alias("~side"), F.lit(None).cast(right.select(carried.alias("x")).schema["x"].dataType).alias("~value"))
    rights = right.where(F.col(on).isNotNull()).select(F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("~row"), *by, F.col(on).alias("~on"), F.lit(0).alias("~side"), carried.alias("~value"))
    w = Window.partitionBy(*by).orderBy("~on", "~side", "~value").rowsBetween(Window.unboundedPreceding, 0)
    both = lefts.union(rights).withColumn("~last", F.last("~value", ignorenulls=True).over(w)).where("`~side` = 1")
    matched = F.col("`~on`").isNotNull()
    for b in by:
        matched &= F.col(b).isNotNull()
    return both.select("`~row`.*", *(F.when(matched, F.col(f"`~last`.{v}")).alias(v) for v in values))


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs with start <= at <= end: spans are replicated to the buckets of width that they touch, so that pairs meet in an
    equi-join that partitions, not in a nested loop. A width near the usual span's length replicates least."""
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    touched = spans.withColumn("~bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    return points.withColumn("~bucket", bucket(at)).join(touched.where(F.col(start) <= F.col(end)), "~bucket").where(F.col(at).between(F.col(start), F.col(end))).drop("~bucket")


def right_semi(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """Right rows with a match on the left."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: str | list[str] | Column) -> DataFrame:
    """Right rows without a match on the left."""
    return right.join(left, on, "left_anti")
