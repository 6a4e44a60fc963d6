from __future__ import annotations

import asyncio
import math
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.engine import Engine, Options
from tidemark.sources.catalog import Catalog
from tidemark.types import SEQ, SchemaError


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "root"))


def again(engine):
    """The engine as a new process finds it."""
    return Engine(engine.spark, engine.catalog.store.root)


def rows(df):
    return [tuple(r) for r in df.collect()]


MOORINGS = [("berth", "i64"), ("note", "utf8"), ("depth", "f64"), ("free", "bool")]


def test_flush_and_reopen(engine):
    engine.create_table("sensor", ["temp", "humidity"])
    for i in range(50):
        engine.append_row("sensor", 1000 + i, [25 + 0.01 * i, 60.0])
    engine.flush()
    times, columns = again(engine).columns("sensor", 1010, 1019)
    assert times == list(range(1010, 1020)) and columns[1] == [60.0] * 10


def test_unflushed_rows_are_seen_directly_but_not_in_snapshots(engine):
    engine.append("s", 1, 1.5)
    assert engine.series("s", 0, 10) == [(1, 1.5)]
    assert engine.snapshot("s").count() == 0
    assert engine.sql("SELECT count(*) FROM s").first()[0] == 1
    assert engine.snapshot("s").count() == 1


def test_log_replays_what_no_flush_stored(engine):
    engine.create_table_typed("moorings", MOORINGS)
    engine.append_row("moorings", 77, [4, "a \"quoted\"\nline", -0.25, None])
    engine.append_batch("moorings", [-3, 2**40], [[None, -(2**63)], ["", None], [math.inf, math.nan], [False, True]])
    found = again(engine)
    times, (berth, note, depth, free) = found.range_typed("moorings", -(2**62), 2**62)
    assert times == [-3, 77, 2**40] and berth == [None, 4, -(2**63)] and note == ["", "a \"quoted\"\nline", None]
    assert depth[:2] == [math.inf, -0.25] and math.isnan(depth[2]) and free == [False, None, True] and found.last_seq == 3


def test_torn_log_line_is_left_out(engine):
    engine.append("s", 1, 1.0)
    with open(engine.catalog.store.root + "/log.jsonl", "a") as f:
        f.write('["s", 2, 2')
    found = again(engine)
    assert found.series("s", 0, 9) == [(1, 1.0)]
    found.append("s", 2, 2.0)
    assert again(found).series("s", 0, 9) == [(1, 1.0), (2, 2.0)]


def test_replay_of_one_table_is_not_cut_by_another(engine):
    engine.create_table("a", ["v"])
    engine.create_table("b", ["v"])
    engine.append_row("a", 1, [1.0])
    engine.append_batch("b", list(range(2000)), [[0.0] * 2000])
    assert again(engine).columns("a", 0, 9) == ([1], [[1.0]])


def test_blocks_flush_themselves(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root"), Options(block_rows=4))
    for i in range(5):
        engine.append("s", i, float(i))
    assert engine.snapshot("s").count() == 4 and engine.diagnose()["pending_rows"] == 1


def test_order_ties_and_closed_range(engine):
    engine.create_table_typed("t", [("i", "i64")])
    engine.append_batch("t", [5, 3, 5, 4, 3], [[0, 1, 2, 3, 4]])
    engine.flush()
    engine.append_row("t", 3, [5])
    assert rows(engine.range("t", 3, 5)) == [(3, 1), (3, 4), (3, 5), (4, 3), (5, 0), (5, 2)]
    assert rows(engine.range("t", 4, 4)) == [(4, 3)] and rows(engine.range("t", 6, 2)) == []


def test_predicates(engine):
    engine.create_table_typed("t", [("i", "i64"), ("b", "bool"), ("s", "utf8"), ("f", "f64")])
    engine.append_batch("t", [0, 1, 2, 3], [[1, 2, None, 2**63 - 1], [True, False, None, False], ["a", "é", None, "A"], [math.nan, -0.0, None, math.inf]])
    ts = lambda *p: [r[0] for r in rows(engine.range("t", 0, 9, p))]
    assert ts(("b", "=", True)) == [0] and ts(("b", ">", False)) == [0] and ts(("b", "<=", False)) == [1, 3]
    assert ts(("s", ">", "a")) == [1] and ts(("s", "<", "a")) == [3]
    assert ts(("f", ">", 0.0)) == [3] and ts(("f", "=", 0.0)) == [1] and ts(("f", ">=", -math.inf)) == [1, 3] and ts(("f", "=", math.nan)) == []
    assert ts(("i", ">=", 2), ("b", "=", False)) == [1, 3]
    assert ts(("i", "=", "x")) == ts(("zz", "=", 1)) == ts(("i", ">", None)) == [0, 1, 2, 3]


def test_strict_types(engine):
    engine.create_table_typed("t", [("f", "double"), ("i", "BIGINT ")])
    for values in ([1, 1], [1.0, 1.0], [1.0, True], [1.0], [1.0, 2**63]):
        with pytest.raises(SchemaError):
            engine.append_row("t", 0, values)
    with pytest.raises(SchemaError):
        engine.append_batch("t", [1, 2], [[1.0, 2.0], [1, "x"]])
    with pytest.raises(SchemaError):
        engine.append_row("t", 1.0, [1.0, 1])
    with pytest.raises(KeyError):
        engine.append_row("no", 0, [1.0])
    assert engine.range("t", -(2**63), 2**63 - 1).count() == 0 and engine.append_batch("t", [], [[], []]) == 0


def test_create_is_idempotent_for_the_same_columns(engine):
    engine.create_table("t", ["a"])
    engine.create_table_typed("t", [("a", "float")])
    for columns in ([("a", "i64")], [("a", "f64"), ("b", "f64")], [("b", "f64")]):
        with pytest.raises(SchemaError):
            engine.create_table_typed("t", columns)
    for columns in ([], [("ts", "f64")], [("ts_ms", "i64")], [("a", "decimal")], [("a", "f64"), ("A", "f64")]):
        with pytest.raises(SchemaError):
            engine.create_table_typed("u", columns)
    engine.create_table("b/ä.c", ["v"])
    assert engine.list_tables() == ["b/ä.c", "t"]


def test_create_and_insert(engine):
    for sql in (
        "CREATE TABLE t (a i64, b bool, c utf8, d f64)",
        "create table if not exists t (a i64, b bool, c utf8, d f64);",
        "INSERT INTO t VALUES (1000, 1, true, 'x', 1.5)",
        "INSERT INTO t VALUES (1001, null, false, 'y', 2)",
        "INSERT INTO t (ts_ms, c, d) VALUES (1002, 'z', 3.5), (1003, 'w', 4.5)",
        "",
    ):
        engine.execute(sql)
    times, (a, b, c, d) = engine.range_typed("t", 0, 9999)
    assert times == [1000, 1001, 1002, 1003] and a == [1, None, None, None] and b == [True, False, None, None]
    assert c == ["x", "y", "z", "w"] and d == [1.5, 2.0, 3.5, 4.5]


def test_insert_literals_stay_what_they_are(engine):
    engine.execute("CREATE TABLE values_x (s text, i int)")
    engine.execute("INSERT INTO values_x (ts, s, i) VALUES (1, 'a,b', 2.0), (2, 'it''s', -3), (3, '123', NULL), (4, '', 0), (5, 'null', 1e2)")
    assert engine.range_typed("values_x", 0, 9)[1] == [["a,b", "it's", "123", "", "null"], [2, -3, None, 0, 100]]
    for bad in ("VALUES (6, 'x', 2.5)", "VALUES (6, 'x', 'y')", "VALUES (6, 'x')", "(s) VALUES ('x')", "(ts, zz) VALUES (6, 1)", "VALUES (7, 'ok', 1), (8, 'no', 2.5)", "VALUES (NULL, 'x', 1)"):
        with pytest.raises(SchemaError):
            engine.execute(f"INSERT INTO values_x {bad}")
    for bad in ("DROP TABLE t", "INSERT INTO values_x VALUES (1, 'x)", "CREATE TABLE", "SELECT 1"):
        with pytest.raises(ValueError):
            engine.execute(bad)
    assert engine.range("values_x", 6, 9).count() == 0
    engine.execute('CREATE TABLE "my ""t" (`a b` real)')
    assert engine.table_schema('my "t') == [("a b", "f64")]


def test_arrow(engine):
    engine.create_table_typed("moorings", MOORINGS)
    data = pa.table({"free": [None, True], "depth": [3.25, None], "ts_ms": pa.array([50, 40], pa.int64()), "tide": ["low", "high"], "note": [None, "quay 7"], "berth": [12, None]})
    for form in (data, data.to_batches()[0], data.to_reader()):
        assert engine.append_arrow("moorings", form) == 2
    with pytest.raises(SchemaError):
        engine.append_arrow("moorings", data, strict=True)
    assert engine.append_arrow("moorings", data.drop_columns(["tide"]), strict=True) == 2
    for bad in (data.drop_columns(["note"]), data.drop_columns(["ts_ms"]), data.set_column(2, "ts_ms", pa.array([None, 40], pa.int64())), data.set_column(4, "note", pa.array([7, 8]))):
        with pytest.raises(SchemaError):
            engine.append_arrow("moorings", bad)
    n = 3000
    big = pa.table({"ts": pa.array(range(n), pa.int64()), "berth": list(range(n)), "depth": [k / 4 for k in range(n)], "free": [k % 2 == 0 for k in range(n)], "note": [f"row {k}" for k in range(n)]})
    assert engine.append_arrow("moorings", big) == n
    out = engine.range_arrow("moorings", 40, 40)
    assert out.schema.names == ["ts_ms", "berth", "note", "depth", "free"] and out.column("note").to_pylist() == ["quay 7"] * 4 + ["row 40"] and out.column("depth").to_pylist() == [None] * 4 + [10.0]


def test_dataframe_append_and_sequence(engine, spark):
    engine.create_table_typed("t", [("v", "i64")])
    engine.append_row("t", 0, [-1])
    assert engine.append_dataframe("t", spark.range(100).selectExpr("id AS ts", "id AS v")) == 100
    engine.append_row("t", 0, [-2])
    assert [r[1] for r in rows(engine.range("t", 0, 0))] == [-1, 0, -2]
    with pytest.raises(SchemaError):
        engine.append_dataframe("t", spark.range(1).selectExpr("id AS ts", "CAST(id AS INT) AS v"))


def test_a_batch_is_appended_once(engine, spark):
    engine.create_table("t", ["a"])
    some = spark.range(3).selectExpr("id AS ts", "CAST(id AS DOUBLE) AS a")
    assert [engine.append_dataframe("t", some, ("stream", k)) for k in (0, 0, 1, 1, 0)] == [3, 0, 3, 0, 0]
    engine.pack_table("t", 2)
    engine.append_row("t", 9, [0.0])
    engine.flush()
    assert again(engine).append_dataframe("t", some, ("stream", 1)) == 0 and engine.append_dataframe("t", some, ("other", 1)) == 3


def test_columns_wants_doubles_without_nulls(engine):
    engine.create_table_typed("moorings", MOORINGS)
    engine.create_table("d", ["a"])
    engine.append_row("d", 1, [None])
    for table in ("moorings", "d"):
        with pytest.raises(SchemaError):
            engine.columns(table, 0, 9)
    with pytest.raises(SchemaError):
        engine.series("d", 0, 9)


def test_pack_keeps_rows_of_all_tables(engine):
    for name in ("t", "u"):
        engine.create_table("%s" % name, ["a", "b"])
        for part in range(4):
            engine.append_batch(name, [10_000 + i % 700 for i in range(part, 1500 + part)], [[float(i) for i in range(1500)], [0.5] * 1500])
    before = {n: rows(engine.range(n, 0, 10**6)) for n in ("t", "u")}
    engine.pack_table("t", 512)
    assert {n: rows(engine.range(n, 0, 10**6)) for n in ("t", "u")} == before
    assert {n: rows(again(engine).range(n, 0, 10**6)) for n in ("t", "u")} == before
    assert engine.stats("t")["segments"] >= 12 and engine.vacuum("t") == 4
    engine.pack_table_tiered("u", 100_000)
    assert rows(engine.range("u", 0, 10**6)) == before["u"] and engine.stats("u")["segments"] == 1


def test_retention(engine):
    engine.create_table("t", ["a"])
    engine.append_batch("t", [1, 2], [[1.0, 2.0]])
    engine.flush()
    engine.append_batch("t", [9, 10, 11], [[9.0, 10.0, 11.0]])
    engine.compact_retention(10)
    assert [r[0] for r in rows(engine.range("t", 0, 99))] == [10, 11] and engine.table_time_range("t") == (10, 11)
    kept = Engine(engine.spark, engine.catalog.store.root, Options(retention_ms=5))
    kept.compact_retention_now(now_ms=16)
    assert [r[0] for r in rows(kept.range("t", 0, 99))] == [11] and again(kept).retention_ms == 5
    assert kept.maintain()[0] == "retention" and kept.table_time_range("t") is None


def test_snapshot_outlives_writes(engine):
    engine.append("s", 1, 1.0)
    engine.flush()
    seen = engine.snapshot("s")
    engine.append("s", 2, 2.0)
    engine.flush()
    engine.pack_table("s", 10)
    assert rows(seen) == [(1, 1.0)]


def test_statistics(engine):
    engine.create_table_typed("moorings", MOORINGS)
    engine.append_batch("moorings", [6, 2, 4, 8], [[1, None, None, 4], ["ß", None, "xyz", ""], [0.5, None, None, None], [True, True, None, False]])
    engine.flush()
    s = engine.stats("moorings")
    assert (s["rows"], s["segments"], s["columns"], s["raw_ts_bytes"], s["raw_value_bytes"]) == (4, 1, 4, 32, 68)
    assert s["stored_ts_bytes"] > 0 and s["compression_ratio_total_x"] > 0
    assert [(c["column"], c["logical_bytes"], c["nulls"]) for c in engine.column_stats("moorings")] == [("berth", 16, 2), ("note", 5, 1), ("depth", 8, 3), ("free", 3, 1)]
    found = engine.diagnostics()
    assert found["pending_rows"] == 0 and found["tables"][0]["rows"] == 4 and found["maintenance"]["pack_fail"] == 0


def test_files_take_no_calls_of_their_own(engine, monkeypatch):
    """pack() fills its files, and neither it nor statistics call the JVM for each of them: a table may have many thousand."""
    engine.create_table_typed("moorings", MOORINGS)
    engine.append_batch("moorings", [k * 7 % 3000 for k in range(3000)], [list(range(3000)), [str(k) for k in range(3000)], [None] * 3000, [True] * 3000])
    before, calls = rows(engine.range("moorings", 0, 3000)), []
    client = type(engine.spark.sparkContext._gateway._gateway_client)
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda self, *a, **b: (calls.append(a), send(self, *a, **b))[1])
    engine.pack_table("moorings", 10)
    found = engine.diagnostics()["tables"][0]
    assert 300 <= found["segments"] <= 300 + engine.spark.sparkContext.defaultParallelism and len(calls) < 3000
    monkeypatch.undo()
    assert rows(engine.range("moorings", 0, 3000)) == before


def test_manifest_tells_what_footers_do(engine):
    """Rows, bounds and bytes of columns, over more files than are merged at once; a manifest of before tells no bytes."""
    engine.create_table_typed("moorings", MOORINGS)
    engine.append_batch("moorings", [k - 600 for k in range(1200)], [list(range(1200)), ["ß" * (k % 9) for k in range(1200)], [None] * 1200, [k % 3 == 0 for k in range(1200)]])
    engine.pack_table("moorings", 2)
    (commit,) = engine.catalog.table("moorings").commits
    sizes = {}
    files = list(Path(engine.catalog.store.root).rglob(f"{commit.name}/*.parquet"))
    for f in files:
        footer = pq.read_metadata(f)
        for g in range(footer.num_row_groups):
            for c in map(footer.row_group(g).column, range(footer.num_columns)):
                sizes[c.path_in_schema] = sizes.get(c.path_in_schema, 0) + c.total_compressed_size
    read = engine.catalog.frame(engine.catalog.table("moorings")).selectExpr("count(*)", "min(ts_ms)", "max(ts_ms)", f"min(`{SEQ}`)", f"max(`{SEQ}`)").first()
    assert (commit.rows, commit.min_ts, commit.max_ts, commit.min_seq, commit.max_seq) == tuple(read) and commit.rows == 1200
    assert commit.stored == sizes and commit.files == len(files) > 500 and commit.stored_bytes == sum(f.stat().st_size for f in files)
    told, manifest = engine.stats("moorings"), f"{engine.catalog._at('moorings')}/table.json"
    old = engine.catalog.store.read(manifest)
    del old["commits"][0]["stored"]
    engine.catalog.store.write(manifest, old)
    told.pop("schema_file_bytes")
    assert told.items() <= again(engine).stats("moorings").items()


def test_bounds_without_statistics(engine):
    """A session may turn Parquet's statistics off; then a commit's bounds are read."""
    conf = engine.spark.sparkContext._jsc.hadoopConfiguration()
    conf.setBoolean("parquet.column.statistics.enabled", False)
    try:
        engine.create_table("t", ["a"])
        engine.append_batch("t", [5, -3, 9], [[1.0, 2.0, 3.0]])
        engine.flush()
    finally:
        conf.unset("parquet.column.statistics.enabled")
    (commit,) = engine.catalog.table("t").commits
    assert (commit.rows, commit.min_ts, commit.max_ts, commit.max_seq - commit.min_seq) == (3, -3, 9, 2)


def test_a_flipped_byte_is_found(engine):
    """Pages carry checksums, which reading verifies: without them one wrong byte could pass."""
    engine.create_table("s", ["value"])
    engine.append_batch("s", list(range(5000)), [[math.sin(k) for k in range(5000)]])
    engine.flush()
    path = next(Path(engine.catalog.store.root).rglob("*.parquet"))
    for crc in path.parent.glob(".*.crc"):  # else the local file system's own checksums find it
        crc.unlink()
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        again(engine).columns("s", 0, 9999)


def test_commits_and_row_groups_outside_a_range_are_not_read(engine, spark):
    for day in range(4):
        engine.append_dataframe("s", spark.range(1000).selectExpr(f"{day} * 100000 + id AS ts", "CAST(id AS DOUBLE) AS value")) if day else engine.create_table("s", ["value"])
    inside = engine.range("s", 200_500, 200_600)
    assert len(inside.inputFiles()) == len(engine.catalog.frame(engine.catalog.table("s"), 200_500, 200_600).inputFiles()) < len(engine.snapshot("s").inputFiles())
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts_ms,200500)" in plan and "LessThanOrEqual(ts_ms,200600)" in plan and inside.count() == 101


def test_sql_views_and_exports(engine):
    engine.create_table("sensor", ["value"])
    engine.append_batch("sensor", [1_704_067_200_000 + 1000 * i for i in range(10)], [[float(i) for i in range(10)]])
    assert engine.sql("SELECT avg(value) AS m FROM sensor WHERE ts_ms >= 1704067200000").first().m == 4.5
    assert engine.sql_pandas('SELECT "ts", ts_ms, "value" FROM sensor ORDER BY ts LIMIT 1').values.tolist() == [[1704067200000, 1704067200000, 0.0]]
    empty = engine.sql_reader("SELECT ts_ms, value FROM sensor WHERE ts < 0")
    assert empty.schema.names == ["ts_ms", "value"] and empty.read_all().num_rows == 0
    assert asyncio.run(engine.sql_async("SELECT count(*) AS n FROM sensor")).column("n").to_pylist() == [10]
    plan = engine.sql("SELECT value FROM sensor WHERE ts > 5")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts_ms,5)" in plan


def test_long_text(engine):
    engine.create_table_typed("t", [("s", "utf8")])
    engine.append_row("t", 1, ["x" * 70_000])
    engine.flush()
    assert len(engine.range_typed("t", 0, 9)[1][0][0]) == 70_000


def test_damaged_file_is_an_error(engine):
    engine.create_table("t", ["v"])
    engine.append_batch("t", [1, 2], [[1.0, 2.0]])
    engine.flush()
    (commit,) = engine.catalog.table("t").commits
    (name,) = engine.catalog.store.sizes(f"tables/t/{commit.name}", ".parquet")
    path = engine.catalog.store.at(f"tables/t/{commit.name}/{name}")
    with open(path, "r+b") as f:
        f.truncate(20)
    with pytest.raises(Exception, match=r"(?i)parquet|checksum|file"):
        engine.range("t", 0, 9).collect()


def test_catalog_only_shows_published_commits(engine, spark):
    engine.create_table("t", ["v"])
    table = engine.catalog.table("t")
    engine.catalog.write(table, spark.sql("SELECT 1L AS ts_ms, 1D AS v, 1L AS _seq"))
    assert Catalog(spark, engine.catalog.store.root).table("t").rows == 0 and engine.range("t", 0, 9).count() == 0
