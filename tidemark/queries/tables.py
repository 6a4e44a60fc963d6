"""Reading the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()

#: events as an engine table, in DuckDB. epoch_ms() would round, Spark's unix_millis() floors.
EV = "(SELECT epoch_us(ts) // 1000 AS ts_ms, event_id, user_id, event_type, value, props, event_type = 'purchase' AS bought FROM events)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with ts_ms and a boolean."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    found = read(spark, sf_dir, "events")
    return found.select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id", "user_id", "event_type", "value", "props", (F.col("event_type") == "purchase").alias("bought"))


def sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query in Spark SQL over views of the tables and ev, the events with ts_ms."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from tidemark.functions import register

        register(spark)
        for t in TABLES:
            if f" {t}" in text or f"({t}" in text:
                read(spark, sf_dir, t).createOrReplaceTempView(t)
        events(spark, sf_dir).createOrReplaceTempView("ev")
        return spark.sql(text)

    return run
