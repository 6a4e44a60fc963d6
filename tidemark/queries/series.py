"""Time functions, range scans and the additions for series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import functions as fn
from tidemark.operators import joins, scan, windows
from tidemark.plans import buckets
from tidemark.queries.tables import EV, events, read, sql
from tidemark.types import Columns

HOUR, DAY = 3_600_000, 86_400_000
#: 2024-01-10 and 2024-01-12 in milliseconds.
START, END = 1_704_844_800_000, 1_705_017_600_000
COLUMNS: Columns = [("event_id", "i64"), ("user_id", "i64"), ("event_type", "utf8"), ("value", "f64"), ("props", "utf8"), ("bought", "bool")]


def bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: hourly averages."""
    return buckets.aggregate(events(spark, sf_dir), HOUR, F.round(F.avg("value"), 6).alias("avg_value"), F.count("*").alias("n"))


def negative(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = events(spark, sf_dir).select("event_id", (F.col("event_id") * 977 - F.lit(4_000_000)).alias("t"))
    return shifted.select("event_id", "t", fn.time_bucket(1000, "t").alias("bucket"))


def lagged(what: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        by_user = Window.partitionBy("user_id").orderBy("ts_ms", "event_id")
        before = events(spark, sf_dir).select("event_id", "user_id", "ts_ms", "value", F.lag("value").over(by_user).alias("v0"), F.lag("ts_ms").over(by_user).alias("t0"))
        change = {"delta": fn.delta("value", "v0"), "delta_i64": fn.delta_i64("ts_ms", "t0"), "rate": fn.rate("value", "v0", fn.delta_i64("ts_ms", "t0"))}[what]
        return before.select("event_id", (change if what == "delta_i64" else F.round(change, 9)).alias("change"))

    return run


def zero_dt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.round(fn.rate("value", F.lit(1.0), F.col("event_id") % 3), 9).alias("r"))


def ranged(start: int, end: int, *predicates: scan.Predicate, columns: tuple[str, ...] = ("ts_ms", "event_id", "value")):
    return lambda spark, sf_dir: scan.filtered(events(spark, sf_dir), COLUMNS, start, end, predicates).select(*columns)


def _scan_sql(where: str, columns: str = "ts_ms, event_id, value") -> str:
    return f"SELECT {columns} FROM {EV} WHERE ts_ms BETWEEN {START} AND {END} AND {where}"


def asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    left = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts_ms")
    right = ev.where("event_type = 'view'").select("user_id", "ts_ms", F.col("value").alias("seen"))
    return joins.asof_join(left, right, "ts_ms", ["user_id"], ["seen"])


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    spans = ev.where("event_type = 'signup'").select(F.col("event_id").alias("span_id"), F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + HOUR).alias("end_ms"))
    points = ev.where("event_type = 'error'").select("event_id", "ts_ms")
    return joins.range_join(points, spans, "ts_ms", "start_ms", "end_ms", HOUR).select("event_id", "span_id")


def bucket_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.in_buckets(events(spark, sf_dir), DAY, START).select("event_id", "ts_ms")


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.gap_fill(events(spark, sf_dir), 6 * HOUR, ["event_type"], "ts_ms", F.max("value"), "top")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sessions(events(spark, sf_dir), ["user_id"], "ts_ms", 12 * HOUR)
    return found.groupBy("user_id", "session").agg(F.min("ts_ms").alias("start_ms"), F.max("ts_ms").alias("end_ms"), F.count("*").alias("n"))


def groups_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    return windows.over_groups(parts, "n", F.count("*"), ["p_brand"], "p_size", 1, 1).select("p_partkey", "n")


def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.distinct_on(events(spark, sf_dir), ["user_id"], [F.desc("ts_ms"), F.col("event_id")]).select("user_id", "event_id", "value")


def right_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.right_semi(orders, read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")


def right_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").where("o_totalprice > 350000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.right_anti(orders, read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_name")


_LAG = f"SELECT event_id, {{change}} AS change FROM (SELECT *, lag(value) OVER w AS v0, lag(ts_ms) OVER w AS t0 FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id))"

QUERIES = {
    "time_bucket_hour_avg": bucketed,
    "time_bucket_sql": sql("SELECT time_bucket(3600000, ts_ms) AS bucket, event_type, round(avg(value), 6) AS avg_value FROM ev GROUP BY 1, 2"),
    "time_bucket_negative": negative,
    "time_bucket_range": bucket_range,
    "delta_lag": lagged("delta"),
    "delta_i64_lag": lagged("delta_i64"),
    "rate_lag": lagged("rate"),
    "rate_zero_dt": zero_dt,
    "functions_sql": sql("SELECT event_id, delta(value, 1.5D) AS d, delta_i64(ts_ms, user_id) AS di, round(rate(value, 2D, event_id % 2), 9) AS r, time_bucket(nullif(event_id % 3, 0) * 1000, ts_ms) AS b FROM ev"),
    "range_closed": ranged(START, END),
    "range_open_bounds": sql(f"SELECT ts_ms, event_id, value FROM ev WHERE ts_ms > {START} AND ts_ms < {END}"),
    "range_empty": ranged(END, START),
    "pred_eq_utf8": ranged(START, END, ("event_type", "=", "click")),
    "pred_gt_f64": ranged(START, END, ("value", ">", 250.0)),
    "pred_le_i64": ranged(START, END, ("user_id", "<=", 50)),
    "pred_bool": ranged(START, END, ("bought", "=", True)),
    "pred_conj": ranged(START, END, ("value", ">=", 100.0), ("event_type", "<", "purchase"), ("user_id", ">", 20)),
    "pred_ignored": ranged(START, END, ("value", "=", "text"), ("nothing", "=", 1)),
    "series_points": ranged(START, END, columns=("ts_ms", "value")),
    "ts_alias": sql(f"SELECT ts, ts_ms, value FROM (SELECT ts_ms AS ts, ts_ms, value FROM ev) WHERE ts >= {START}"),
    "projection_only": lambda spark, sf_dir: events(spark, sf_dir).select("event_type", "value"),
    "timestamp_literal": sql("SELECT event_id, ts_ms FROM ev WHERE ts_ms >= unix_millis(TIMESTAMP '2024-01-15 00:00:00')"),
    "timestamp_literal_micros": sql("SELECT event_id, ts_ms FROM ev WHERE timestamp_millis(ts_ms) > TIMESTAMP '2024-01-15 00:00:00.000500' AND ts_ms < unix_micros(TIMESTAMP '2024-01-16 00:00:00.000999') DIV 1000"),
    "asof_join": asof,
    "range_join": ranges,
    "gap_fill": filled,
    "session_window": sessions,
    "win_groups_frame": groups_frame,
    "distinct_on": distinct_on,
    "join_right_semi": right_semi,
    "join_right_anti": right_anti,
}

_BUCKET = "ts_ms - ((ts_ms % {s}) + {s}) % {s}"
SQL = {
    "time_bucket_hour_avg": f"SELECT {_BUCKET.format(s=HOUR)} AS bucket, round(avg(value), 6) AS avg_value, count(*) AS n FROM {EV} GROUP BY 1",
    "time_bucket_sql": f"SELECT {_BUCKET.format(s=HOUR)} AS bucket, event_type, round(avg(value), 6) AS avg_value FROM {EV} GROUP BY 1, 2",
    "time_bucket_negative": "SELECT event_id, t, t - ((t % 1000) + 1000) % 1000 AS bucket FROM (SELECT event_id, event_id * 977 - 4000000 AS t FROM events)",
    "time_bucket_range": f"SELECT event_id, ts_ms FROM {EV} WHERE {_BUCKET.format(s=DAY)} = {START}",
    "delta_lag": _LAG.format(change="round(value - v0, 9)"),
    "delta_i64_lag": _LAG.format(change="ts_ms - t0"),
    "rate_lag": _LAG.format(change="round((value - v0) / nullif(CAST(ts_ms - t0 AS DOUBLE), 0), 9)"),
    "rate_zero_dt": "SELECT event_id, round((value - 1.0) / nullif(CAST(event_id % 3 AS DOUBLE), 0), 9) AS r FROM events",
    "functions_sql": f"SELECT event_id, value - 1.5 AS d, ts_ms - user_id AS di, round((value - 2) / nullif(CAST(event_id % 2 AS DOUBLE), 0), 9) AS r, CASE WHEN event_id % 3 > 0 THEN ts_ms - ts_ms % ((event_id % 3) * 1000) END AS b FROM {EV}",
    "range_closed": _scan_sql("true"),
    "range_open_bounds": f"SELECT ts_ms, event_id, value FROM {EV} WHERE ts_ms > {START} AND ts_ms < {END}",
    "range_empty": _scan_sql("false"),
    "pred_eq_utf8": _scan_sql("event_type = 'click'"),
    "pred_gt_f64": _scan_sql("value > 250"),
    "pred_le_i64": _scan_sql("user_id <= 50"),
    "pred_bool": _scan_sql("bought"),
    "pred_conj": _scan_sql("value >= 100 AND event_type < 'purchase' AND user_id > 20"),
    "pred_ignored": _scan_sql("true"),
    "series_points": _scan_sql("true", "ts_ms, value"),
    "ts_alias": f"SELECT ts_ms AS ts, ts_ms, value FROM {EV} WHERE ts_ms >= {START}",
    "projection_only": "SELECT event_type, value FROM events",
    "timestamp_literal": f"SELECT event_id, ts_ms FROM {EV} WHERE ts_ms >= 1705276800000",
    "timestamp_literal_micros": f"SELECT event_id, ts_ms FROM {EV} WHERE ts_ms BETWEEN 1705276800001 AND 1705363199999",
    "asof_join": f"SELECT l.event_id, l.user_id, l.ts_ms, r.value AS seen FROM (SELECT * FROM {EV} WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM {EV} WHERE event_type = 'view') r ON l.user_id = r.user_id AND l.ts_ms >= r.ts_ms",
    "range_join": f"SELECT p.event_id, s.event_id AS span_id FROM {EV} p, {EV} s WHERE p.event_type = 'error' AND s.event_type = 'signup' AND p.ts_ms BETWEEN s.ts_ms AND s.ts_ms + {HOUR}",
    "gap_fill": f"""WITH b AS (SELECT event_type, {_BUCKET.format(s=6 * HOUR)} AS bucket, max(value) AS top FROM {EV} GROUP BY 1, 2),
g AS (SELECT event_type, unnest(range(min(bucket), max(bucket) + 1, {6 * HOUR})) AS bucket FROM b GROUP BY 1)
SELECT g.event_type, g.bucket, b.top FROM g ASOF JOIN b ON g.event_type = b.event_type AND g.bucket >= b.bucket""",
    "session_window": f"""WITH x AS (SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER w <= {12 * HOUR} THEN 0 ELSE 1 END AS fresh FROM {EV} WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms)),
y AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts_ms) AS BIGINT) AS session FROM x)
SELECT user_id, session, min(ts_ms) AS start_ms, max(ts_ms) AS end_ms, count(*) AS n FROM y GROUP BY 1, 2""",
    "win_groups_frame": "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM part",
    "distinct_on": f"SELECT DISTINCT ON (user_id) user_id, event_id, value FROM {EV} ORDER BY user_id, ts_ms DESC, event_id",
    "join_right_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "join_right_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 350000)",
}
