from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn

LEAST = -(2**63)


@pytest.fixture
def sql(spark):
    fn.register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS x").first().x


@pytest.mark.parametrize(("ts", "bucket"), [(-1001, -2000), (-1000, -1000), (-1, -1000), (0, 0), (999, 0), (1000, 1000), (LEAST, LEAST), (None, None)])
def test_time_bucket(spark, sql, ts, bucket):
    assert sql(f"time_bucket(1000, {'CAST(NULL AS BIGINT)' if ts is None else f'CAST({ts} AS BIGINT)' if ts > LEAST else '-9223372036854775807L - 1L'})") == bucket
    assert spark.createDataFrame([(ts,)], "t long").select(fn.time_bucket(1000, "t").alias("x")).first().x == bucket


def test_time_bucket_null_comes_before_the_sign(sql):
    assert sql("time_bucket(CAST(NULL AS BIGINT), 5L)") is None and sql("time_bucket(0L, CAST(NULL AS BIGINT))") is None
    for step in (0, -5):
        with pytest.raises(Exception, match="time_bucket interval must be positive"):
            sql(f"time_bucket({step}L, 5L)")


@pytest.mark.parametrize(("dt", "expected"), [("2", 1.0), ("0", None), ("NULL", None), ("-2", -1.0)])
def test_rate(sql, dt, expected):
    assert sql(f"rate(5D, 3D, CAST({dt} AS BIGINT))") == expected


def test_delta(spark, sql):
    assert sql("delta(5D, 3D)") == 2.0 and sql("delta(5L, 3L)") == 2.0 and sql("delta(NULL, 3D)") is None
    assert sql("delta_i64(5L, 8L)") == -3 and sql("delta_i64(5L, NULL)") is None
    with pytest.raises(Exception, match="(?i)overflow"):
        spark.range(1).select(fn.delta_i64(F.lit(2**63 - 1), F.lit(-1)).alias("x")).first()


def test_functions_expand_to_built_in_expressions(spark):
    fn.register(spark)
    spark.range(10).createOrReplaceTempView("numbers")
    plan = spark.sql("SELECT time_bucket(10L, id) AS b FROM numbers")._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan and "pmod" in plan


def test_other_dialects(sql):
    assert sql("strpos('abc', 'c')") == 3 and sql("starts_with('abc', 'ab')") and sql("ends_with('abc', 'bc')")
    assert sql("gcd_i64(54L, -24L)") == 6 and sql("gcd_i64(0L, 7L)") == 7 and sql("trunc_number(-1.29D, 1)") == -1.2
    assert str(sql("date_bin(INTERVAL '15' MINUTE, TIMESTAMP '2024-01-01 00:16:00', TIMESTAMP '2024-01-01 00:05:00')")) == "2024-01-01 00:05:00"
