"""Tables of the engine: what goes in by each way comes out, before and after maintenance."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine import Engine
from tidemark.queries.tables import EV, events, read
from tidemark.types import SEQ

ALL = (-(2**62), 2**62)
CUTOFF = 1_705_017_600_000
DECLARED = [("event_id", "i64"), ("user_id", "i64"), ("event_type", "utf8"), ("value", "f64"), ("bought", "bool")]
#: A table made of the nations: a day for each, from before 1970 on, with nulls in every column that can hold them.
PORTS = [("name", "utf8"), ("region", "i64"), ("share", "f64"), ("coastal", "bool")]
DAY = 86_400_000


def ports(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """(time, name, region, share, coastal) of each nation, in the order of keys."""
    found = read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    return [(DAY * (k - 5), None if r == 2 else n, r, None if k % 5 == 0 else k / 8, None if k % 7 == 0 else k % 3 == 0) for k, n, r in found]


def _engine(spark: SparkSession) -> Engine:
    return Engine(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/tidemark-{uuid.uuid4().hex}")


def _loaded(spark: SparkSession, sf_dir: str) -> Engine:
    """The events in a table of two commits, the second with later times."""
    engine = _engine(spark)
    engine.create_table_typed("ev", DECLARED)
    rows = events(spark, sf_dir).select("ts_ms", *(n for n, _ in DECLARED))
    engine.append_dataframe("ev", rows.where(F.col("ts_ms") < CUTOFF - 86_400_000))
    engine.append_dataframe("ev", rows.where(F.col("ts_ms") >= CUTOFF - 86_400_000))
    return engine


def typed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most rows as one batch of columns, the rest one by one, half of them flushed."""
    engine, rows = _engine(spark), ports(spark, sf_dir)
    engine.create_table_typed("ports", PORTS)
    times, *columns = (list(c) for c in zip(*rows[4:], strict=True))
    engine.append_batch("ports", times, columns)
    for t, *values in rows[:2]:
        engine.append_row("ports", t, values)
    engine.flush()
    for t, *values in rows[2:4]:
        engine.append_row_typed("ports", t, values)
    return engine.range("ports", *ALL)


def create_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as literals of INSERT, with and without a list of columns; columns that are left out are null."""
    engine, rows = _engine(spark), ports(spark, sf_dir)
    literal = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)
    engine.execute("CREATE TABLE ports (name utf8, region i64, share f64, coastal bool)")
    engine.execute("INSERT INTO ports VALUES " + ", ".join(f"({', '.join(map(literal, r))})" for r in rows[:20]))
    engine.execute("INSERT INTO ports (coastal, ts_ms, name) VALUES " + ", ".join(f"({literal(r[4])}, {r[0]}, {literal(r[1])})" for r in rows[20:]))
    return engine.sql("SELECT * FROM ports")


def arrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name in any order; one that the table has not is passed over."""
    engine, rows = _engine(spark), ports(spark, sf_dir)
    engine.create_table_typed("ports", PORTS)
    engine.append_arrow("ports", _arrow(rows, extra=True))
    return engine.range("ports", *ALL)


def _arrow(rows: list[tuple], extra: bool = False) -> pa.Table:
    times, *columns = (list(c) for c in zip(*rows, strict=True))
    named = dict(zip([n for n, _ in PORTS], columns, strict=True))
    more = {"weight": list(range(len(rows)))} if extra else {}
    return pa.table({"coastal": named["coastal"], **more, "ts": pa.array(times, pa.int64()), "share": named["share"], "name": named["name"], "region": pa.array(named["region"], pa.int64())})


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark)
    for i in range(20):
        engine.append("s", 1000 - i % 7, float(i))
    return engine.range("s", 995, 999)


def dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).range("ev", *ALL)


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir)
    seen = engine.snapshot("ev")
    engine.append_row("ev", 0, [0, 0, "later", 0.0, False])
    engine.flush()
    return seen


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).range("ev", CUTOFF, CUTOFF + 86_400_000, [("value", ">", 100.0), ("bought", "=", False)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).sql(f'SELECT "event_type", count(*) AS n, round(avg(value), 6) AS m FROM ev WHERE ts >= {CUTOFF} GROUP BY event_type')


def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir)
    engine.compact_retention(CUTOFF)
    return engine.snapshot("ev")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir)
    engine.pack_table("ev", 2000)
    return engine.snapshot("ev")


def packed_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _loaded(spark, sf_dir)
    engine.pack_table_tiered("ev", 1_000_000)
    return engine.snapshot("ev")


def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([_loaded(spark, sf_dir).table_time_range("ev")], "min_ts long, max_ts long")


def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(c["column"], c["logical_bytes"], c["rows"], c["nulls"]) for c in _loaded(spark, sf_dir).column_stats("ev")]
    return spark.createDataFrame(rows, "column string, logical_bytes long, rows long, nulls long")


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _loaded(spark, sf_dir).stats("ev")
    names = ["rows", "columns", "raw_ts_bytes", "raw_value_bytes"]
    return spark.createDataFrame([tuple(s[n] for n in names)], T.StructType([T.StructField(n, T.LongType()) for n in names]))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers are distinct and later commits' are larger."""
    engine = _loaded(spark, sf_dir)
    rows = engine.catalog.frame(engine.catalog.table("ev"))
    return rows.agg(F.count("*").alias("n"), F.count_distinct(SEQ).alias("distinct_n"), (F.max(F.when(F.col("ts_ms") < CUTOFF - 86_400_000, F.col(SEQ))) < F.min(F.when(F.col("ts_ms") >= CUTOFF - 86_400_000, F.col(SEQ)))).alias("in_order"))


PORTS_SQL = f"""SELECT {DAY} * (CAST(n_nationkey AS BIGINT) - 5) AS ts_ms, CASE WHEN n_regionkey <> 2 THEN n_name END AS name, CAST(n_regionkey AS BIGINT) AS region,
CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS DOUBLE) / 8 END AS share, CASE WHEN n_nationkey % 7 <> 0 THEN n_nationkey % 3 = 0 END AS coastal FROM nation"""
_ROWS = f"SELECT ts_ms, event_id, user_id, event_type, value, bought FROM {EV}"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "typed_roundtrip_nulls": typed_roundtrip,
    "sql_create_insert": create_insert,
    "append_batch_arrow": arrow,
    "append_points": points,
    "append_dataframe": dataframe,
    "snapshot_scan": snapshot,
    "table_range_predicates": scan,
    "table_sql": query,
    "retention_cutoff": retention,
    "pack_preserves_rows": packed,
    "pack_tiered_preserves_rows": packed_tiered,
    "time_range": time_range,
    "column_stats": column_stats,
    "table_stats_raw_bytes": table_stats,
    "sequence_numbers": sequence,
}
SQL = {
    "typed_roundtrip_nulls": PORTS_SQL,
    "sql_create_insert": f"SELECT ts_ms AS ts, ts_ms, name, CASE WHEN ts_ms < {15 * DAY} THEN region END AS region, CASE WHEN ts_ms < {15 * DAY} THEN share END AS share, coastal FROM ({PORTS_SQL})",
    "append_batch_arrow": PORTS_SQL,
    "append_points": "SELECT 1000 - i % 7 AS ts_ms, CAST(i AS DOUBLE) AS value FROM range(20) x(i) WHERE 1000 - i % 7 BETWEEN 995 AND 999",
    "append_dataframe": _ROWS,
    "snapshot_scan": _ROWS,
    "table_range_predicates": f"{_ROWS} WHERE ts_ms BETWEEN {CUTOFF} AND {CUTOFF + 86_400_000} AND value > 100 AND NOT bought",
    "table_sql": f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS m FROM {EV} WHERE ts_ms >= {CUTOFF} GROUP BY event_type",
    "retention_cutoff": f"{_ROWS} WHERE ts_ms >= {CUTOFF}",
    "pack_preserves_rows": _ROWS,
    "pack_tiered_preserves_rows": _ROWS,
    "time_range": f"SELECT min(ts_ms) AS min_ts, max(ts_ms) AS max_ts FROM {EV}",
    "column_stats": f"""SELECT 'event_id' AS "column", 8 * count(*) AS logical_bytes, count(*) AS rows, CAST(0 AS BIGINT) AS nulls FROM {EV} UNION ALL
SELECT 'user_id', 8 * count(*), count(*), 0 FROM {EV} UNION ALL SELECT 'event_type', CAST(sum(strlen(event_type)) AS BIGINT), count(*), 0 FROM {EV} UNION ALL
SELECT 'value', 8 * count(*), count(*), 0 FROM {EV} UNION ALL SELECT 'bought', count(*), count(*), 0 FROM {EV}""",
    "table_stats_raw_bytes": "SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns, 8 * count(*) AS raw_ts_bytes, 25 * count(*) AS raw_value_bytes FROM events",
    "sequence_numbers": "SELECT count(*) AS n, count(*) AS distinct_n, true AS in_order FROM events",
}
