"""Windows and distincts that Spark SQL has no syntax for, and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import time_bucket


def distinct_on(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("~n", F.row_number().over(w)).where("`~n` = 1").drop("~n")


def over_groups(rows: DataFrame, name: str, aggregate: Column, by: list[str], order: str, before: int, after: int) -> DataFrame:
    """rows with name: aggregate over a GROUPS frame, the rows of the before ... after groups of peers around the own one."""
    peers = rows.withColumn("~group", F.dense_rank().over(Window.partitionBy(*by).orderBy(order)))
    return peers.withColumn(name, aggregate.over(Window.partitionBy(*by).orderBy("~group").rangeBetween(-before, after))).drop("~group")


def gap_fill(rows: DataFrame, step: int, by: list[str], column: str, value: Column, name: str) -> DataFrame:
    """(by, bucket, name): value aggregated by bucket, with a row for each bucket between a key's first and last; a bucket
    without rows has the value of the one before it."""
    found = rows.groupBy(*by, time_bucket(step, column).alias("bucket")).agg(value.alias(name))
    # Only the gap up to the next bucket is generated by each row, so long series stay distributed by key.
    following = F.lead("bucket").over(Window.partitionBy(*by).orderBy("bucket"))
    return found.withColumn("~next", F.coalesce(following, F.col("bucket") + step)).select(*by, F.explode(F.sequence(F.col("bucket"), F.col("~next") - step, F.lit(step).cast("long"))).alias("bucket"), name)


def sessions(rows: DataFrame, by: list[str], column: str, gap: int) -> DataFrame:
    """rows with session, numbered from 1 by key: a row over gap after the one before it starts a session."""
    w = Window.partitionBy(*by).orderBy(column)
    new = F.coalesce((F.col(column) - F.lag(column).over(w) > gap).cast("long"), F.lit(1))
    return rows.withColumn("~new", new).withColumn("session", F.sum("~new").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("~new")
