from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.operators import joins, windows
from tidemark.plans import buckets
from tidemark.streaming import append_stream, bucketed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_asof_join_ties_nulls_and_strangers(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 5, 3), (None, 5, 4), ("a", None, 5)], "k string, t long, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, "z"), (None, 1, "n"), ("a", None, "m")], "k string, t long, v string")
    found = joins.asof_join(left, right, "t", ["k"], ["v"])
    assert found.columns == ["k", "t", "id", "v"]
    assert {r.id: r.v for r in found.collect()} == {1: "y", 2: None, 3: None, 4: None, 5: None}


def test_range_join_matches_the_theta_join(spark):
    points = spark.range(200).select((F.col("id") * 7 - 500).alias("t"))
    spans = spark.range(40).select((F.col("id") * 31 - 500).alias("a"), (F.col("id") * 31 - 520 + F.pmod(F.col("id") * 13, F.lit(90))).alias("b"))
    theta = points.join(spans, F.col("t").between(F.col("a"), F.col("b")))
    assert rows(joins.range_join(points, spans, "t", "a", "b", 50)) == rows(theta)


def test_gap_fill_and_sessions(spark):
    ev = spark.createDataFrame([("a", 0, 1.0), ("a", 35, 2.0), ("b", -11, 3.0)], "k string, t long, v double")
    assert rows(windows.gap_fill(ev, 10, ["k"], "t", F.max("v"), "m")) == [("a", 0, 1.0), ("a", 10, 1.0), ("a", 20, 1.0), ("a", 30, 2.0), ("b", -20, 3.0)]
    assert [r.session for r in windows.sessions(ev, ["k"], "t", 30).orderBy("k", "t").collect()] == [1, 2, 1]


def test_buckets_push_down(spark, tmp_path):
    spark.range(1000).selectExpr("id AS ts_ms").write.parquet(str(tmp_path / "x"))
    found = buckets.in_buckets(spark.read.parquet(str(tmp_path / "x")), 100, 200, 300)
    assert found.count() == 200 and "GreaterThanOrEqual(ts_ms,200)" in found._jdf.queryExecution().executedPlan().toString()
    assert buckets.in_buckets(spark.range(10).selectExpr("id AS ts_ms"), 100, 50, 99).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"))
    engine.create_table_typed("s", [("v", "i64")])
    source = str(tmp_path / "in")
    for part in range(3):
        spark.range(part * 100, part * 100 + 100).selectExpr("id * 250 AS ts_ms", "id AS v").coalesce(1).write.parquet(f"{source}/{part}")
    stream = lambda: spark.readStream.schema("ts_ms long, v long").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    append_stream(engine, "s", stream(), str(tmp_path / "c1")).awaitTermination()
    assert engine.snapshot("s").count() == 300
    query = bucketed(stream(), 10_000, 5_000, F.sum("v").alias("total")).writeStream.format("memory").queryName("totals").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = buckets.aggregate(engine.snapshot("s"), 10_000, F.sum("v").alias("total"))
    assert rows(spark.table("totals").select("bucket", "total")) == rows(batch.select("bucket", "total"))
