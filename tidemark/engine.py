"""The engine: append-only time-series tables over Spark."""

from __future__ import annotations

import asyncio
import threading
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import functions, maintenance
from tidemark.operators import scan
from tidemark.plans import statements
from tidemark.sources.buffer import Log, Row, to_arrow
from tidemark.sources.catalog import Catalog, Table
from tidemark.types import ALIAS, SEQ, TS, Columns, SchemaError, check_row, check_ts, row_schema

_ARROW_KINDS = {"f64": pa.types.is_float64, "i64": pa.types.is_int64, "bool": pa.types.is_boolean, "utf8": lambda t: pa.types.is_string(t) or pa.types.is_large_string(t)}


#: Rows of a range, at most, that one task sorts: sampling and dealing them out would take longer.
FEW_ROWS = 200_000


@dataclass(frozen=True)
class Options:
    """retention_ms: age beyond which compact_retention_now() drops rows; kept with the engine's files once set.
    block_rows: buffered rows of a table that are flushed of themselves. maintenance: None turns maintain() off."""

    retention_ms: int | None = None
    block_rows: int = 1024
    maintenance: maintenance.Policy | None = maintenance.Policy()


class Engine:
    """Tables under root, a folder of any file system that Spark reads.

    Many may read and one may write at a time. Direct reads (range, columns, series) see unflushed rows; sql() flushes
    first; snapshot() sees what is flushed.
    """

    def __init__(self, spark: SparkSession, root: str, options: Options = Options()):  # noqa: B008
        self.spark, self.options = spark, options
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.set("spark.sql.ansi.enabled", "true")
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
        self.catalog = Catalog(spark, root)
        self._lock = threading.RLock()
        self._known: dict[str, Columns] = {}
        self._settings()
        scheme = self.catalog.store.fs.getScheme()
        self._log = Log(root.removeprefix("file://").removeprefix("file:").rstrip("/") + "/log.jsonl" if scheme == "file" else None)
        tables = {n: self.catalog.table(n) for n in self.catalog.names()}
        self._seq = max([0, *(c.max_seq for t in tables.values() for c in t.commits)])
        self._buffer: dict[str, list[Row]] = {}
        for name, rows in self._log.replay().items():
            done = max([0, *(c.max_seq for c in tables[name].commits)]) if name in tables else None
            if done is not None and (left := [r for r in rows if r[0] > done]):
                self._buffer[name] = left
                self._seq = max(self._seq, left[-1][0])
        self.counters = maintenance.Counters()

    def _settings(self) -> None:
        store = self.catalog.store
        kept = store.read("engine.json") if store.exists("engine.json") else {"retention_ms": None}
        if self.options.retention_ms is not None and kept["retention_ms"] != self.options.retention_ms:
            kept["retention_ms"] = self.options.retention_ms
            store.write("engine.json", kept)
        self._retention = kept["retention_ms"]

    # Tables

    def create_table(self, table: str, columns: Iterable[str]) -> None:
        """A table of doubles."""
        self.create_table_typed(table, [(c, "f64") for c in columns])

    def create_table_typed(self, table: str, columns: Iterable[tuple[str, str]]) -> None:
        with self._lock:
            self.catalog.create(table, list(columns))

    def list_tables(self) -> list[str]:
        return self.catalog.names()

    def table_schema(self, table: str) -> Columns:
        return self.catalog.table(table).columns

    @property
    def last_seq(self) -> int:
        return self._seq

    @property
    def retention_ms(self) -> int | None:
        return self._retention

    def with_read(self, do: Callable[[Engine], Any]) -> Any:
        return do(self)

    def with_write(self, do: Callable[[Engine], Any]) -> Any:
        with self._lock:
            return do(self)

    # Appending

    def append(self, series: str, ts_ms: int, value: float) -> int:
        """Appends a point; a new series is a table with the one column value."""
        with self._lock:
            if not self.catalog.exists(series):
                self.create_table(series, ["value"])
            return self.append_row(series, ts_ms, [value])

    def append_row(self, table: str, ts_ms: int, values: Sequence[Any]) -> int:
        """Appends a row of exactly the declared types; returns its sequence number."""
        with self._lock:
            row = check_row(self._columns(table), values)
            self._add(table, [(check_ts(ts_ms), row)])
            self.counters.rows += 1
            return self._seq

    append_row_typed = append_row

    def append_batch(self, table: str, ts_ms: Sequence[int], columns: Sequence[Sequence[Any]]) -> int:
        """Appends columns of values, all or none; returns the number of rows. A batch of block_rows is flushed at once."""
        with self._lock:
            declared = self._columns(table)
            if len(columns) != len(declared):
                raise SchemaError(f"{len(columns)} columns for {len(declared)}")
            if any(len(c) != len(ts_ms) for c in columns):
                raise SchemaError("columns of different lengths")
            rows = [(check_ts(t), check_row(declared, values)) for t, values in zip(ts_ms, zip(*columns, strict=True) if columns else (), strict=True)]
            if rows:
                self._add(table, rows)
            self.counters.batches += 1
            return len(rows)

    def append_rows(self, table: str, ts_ms: Sequence[int], matrix: Sequence[Sequence[float]]) -> int:
        """Appends a row-major matrix of doubles."""
        return self.append_batch(table, list(map(int, ts_ms)), [list(map(float, c)) for c in zip(*matrix, strict=True)] if len(matrix) else [[] for _ in self._columns(table)])

    def append_arrow(self, table: str, data: Any, strict: bool = False) -> int:
        """Appends Arrow data (a table, batch, reader or what exports the C interface), columns matched by name.

        The time is ts_ms or ts, 64-bit integers without nulls. Other columns than the table's are passed over; strict
        demands exactly the table's columns, none twice. Values go to Spark as Arrow, not through Python rows.
        """
        began = time.monotonic()
        if isinstance(data, pa.RecordBatch):
            data = pa.Table.from_batches([data])
        elif not isinstance(data, pa.Table):
            data = pa.RecordBatchReader.from_stream(data).read_all() if hasattr(data, "__arrow_c_stream__") else pa.Table.from_batches([pa.record_batch(data)])
        with self._lock:
            columns, names = self._columns(table), data.column_names
            times = [n for n in (TS, ALIAS) if n in names]
            if not times:
                raise SchemaError("no column ts_ms or ts")
            wanted = [times[0], *(n for n, _ in columns)]
            if any(names.count(n) > 1 for n in (names if strict else wanted)):
                raise SchemaError("a column occurs twice")
            if strict and (extra := set(names) - set(wanted)):
                raise SchemaError(f"column {sorted(extra)[0]!r} is not the table's")
            ts = data.column(times[0])
            if not pa.types.is_int64(ts.type) or ts.null_count:
                raise SchemaError(f"{times[0]} must be int64 without nulls")
            arrays = [ts]
            for name, kind in columns:
                if name not in names:
                    raise SchemaError(f"no column {name!r}")
                if not _ARROW_KINDS[kind](data.column(name).type):
                    raise SchemaError(f"column {name!r} is not {kind}")
                arrays.append(data.column(name))
            if data.num_rows:
                if data.num_rows < self.options.block_rows:
                    values = [a.to_pylist() for a in arrays]
                    self._add(table, [(v[0], v[1:]) for v in zip(*values, strict=True)])
                else:
                    self._flush(table)
                    seq = pa.array(range(self._seq + 1, self._seq + data.num_rows + 1), pa.int64())
                    whole = pa.table([*arrays, seq], names=[TS, *(n for n, _ in columns), SEQ])
                    self._commit(table, self.spark.createDataFrame(whole, schema=row_schema(columns, True)))
                    self._seq += data.num_rows
                    self.counters.wrote(data.num_rows)
            self.counters.arrow.append((time.monotonic() - began) * 1000)
            return data.num_rows

    def append_dataframe(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Appends a DataFrame of any size with the table's columns, where it is: nothing passes the driver.

        Sequence numbers rise with the order of partitions and rows, with gaps. batch is a stream's name and its batch's
        number: one that is committed already, or an earlier one, is not appended again.
        """
        with self._lock:
            columns = self._columns(table)
            if batch and self.catalog.table(table).streams.get(batch[0], -1) >= batch[1]:
                return 0
            self._flush(table)
            time_ = F.col(TS if TS in rows.columns else ALIAS).cast("long").alias(TS)
            same = {n: row_schema(columns)[n].dataType for n, _ in columns}
            for name, kind in same.items():
                if name not in rows.columns or rows.schema[name].dataType != kind:
                    raise SchemaError(f"column {name!r} is missing or not {kind.simpleString()}")
            numbered = rows.select(time_, *(F.col(f"`{n}`") for n in same), (F.monotonically_increasing_id() + self._seq + 1).alias(SEQ))
            made = self._commit(table, numbered, batch)
            if made is None:
                return 0
            self._seq = made.max_seq
            self.counters.wrote(made.rows)
            return made.rows

    def _columns(self, table: str) -> Columns:
        """A table's columns, which never change once it is there."""
        if table not in self._known:
            self._known[table] = self.catalog.table(table).columns
        return self._known[table]

    def _add(self, table: str, rows: list[tuple[int, tuple]]) -> None:
        numbered = [(self._seq + 1 + i, t, v) for i, (t, v) in enumerate(rows)]
        self._log.add(table, numbered)
        self._seq += len(rows)
        self._buffer.setdefault(table, []).extend(numbered)
        self.counters.wrote(len(rows))
        if len(self._buffer[table]) >= self.options.block_rows:
            self._flush(table)

    def _commit(self, table: str, rows: DataFrame, batch: tuple[str, int] | None = None):
        found = self.catalog.table(table)
        made = self.catalog.write(found, rows)
        self.catalog.publish(found, [made], batch=batch)
        return made

    def _flush(self, table: str) -> None:
        if rows := self._buffer.get(table):
            columns = self._columns(table)
            self._commit(table, self.spark.createDataFrame(to_arrow(columns, rows), schema=row_schema(columns, True)).coalesce(1).sortWithinPartitions(TS, SEQ))
            del self._buffer[table]
            self._log.clear(self._buffer)

    def flush(self) -> None:
        """Commits all buffered rows, a table's in one step."""
        with self._lock:
            for table in list(self._buffer):
                self._flush(table)

    # Reading

    def _rows(self, table: Table, low: int | None = None, high: int | None = None) -> DataFrame:
        rows = self.catalog.frame(table, low, high)
        if buffered := self._buffer.get(table.name):
            rows = rows.union(self.spark.createDataFrame(to_arrow(table.columns, buffered), schema=row_schema(table.columns, True)))
        return rows

    def range(self, table: str, start_ms: int, end_ms: int, predicates: Iterable[scan.Predicate] = ()) -> DataFrame:
        """Rows with start_ms <= ts_ms <= end_ms by time, ties as appended; predicates (column, op, literal) must all hold."""
        found = self.catalog.table(table)
        rows = scan.filtered(self._rows(found, start_ms, end_ms), found.columns, start_ms, end_ms, predicates)
        most = sum(c.rows for c in found.commits if c.max_ts >= start_ms and c.min_ts <= end_ms) + len(self._buffer.get(table, ()))
        return scan.in_order(rows.coalesce(1) if most <= FEW_ROWS else rows)

    def range_arrow(self, table: str, start_ms: int, end_ms: int, predicates: Iterable[scan.Predicate] = ()) -> pa.Table:
        return self.range(table, start_ms, end_ms, predicates).toArrow()

    def range_typed(self, table: str, start_ms: int, end_ms: int) -> tuple[list[int], list[list[Any]]]:
        """Times and columns as lists."""
        times, *columns = (c.to_pylist() for c in self.range_arrow(table, start_ms, end_ms).columns)
        return times, columns

    def columns(self, table: str, start_ms: int, end_ms: int) -> tuple[list[int], list[list[float]]]:
        """range_typed() of a table of doubles; an error if a column isn't one or a value is null."""
        if other := [n for n, k in self._columns(table) if k != "f64"]:
            raise SchemaError(f"column {other[0]!r} is not f64")
        found = self.range_arrow(table, start_ms, end_ms)
        if any(c.null_count for c in found.columns):
            raise SchemaError("a value is null")
        times, *columns = (c.to_pylist() for c in found.columns)
        return times, columns

    def columns_arrow(self, table: str, start_ms: int, end_ms: int) -> pa.Table:
        """range_arrow() with the checks of columns()."""
        if other := [n for n, k in self._columns(table) if k != "f64"]:
            raise SchemaError(f"column {other[0]!r} is not f64")
        found = self.range_arrow(table, start_ms, end_ms)
        if any(c.null_count for c in found.columns):
            raise SchemaError("a value is null")
        return found

    def series(self, series: str, start_ms: int, end_ms: int) -> list[tuple[int, float]]:
        """Points of a table whose one column is value, a double."""
        if self._columns(series) != [("value", "f64")]:
            raise SchemaError(f"{series!r} is not a series")
        found = self.range_arrow(series, start_ms, end_ms)
        return list(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))

    def snapshot(self, table: str) -> DataFrame:
        """The rows flushed by now, in no order; later writes don't change it. Its files are its parallelism."""
        return self.catalog.frame(self.catalog.table(table)).drop(SEQ)

    # SQL

    def execute(self, sql: str) -> int:
        """CREATE TABLE or INSERT; returns the rows inserted. An INSERT stores all its rows or none."""
        with self._lock:
            statement = statements.parse(sql)
            if isinstance(statement, statements.Create):
                self.create_table_typed(statement.table, statement.columns)
            elif isinstance(statement, statements.Insert):
                rows = statements.insert_rows(statement, self._columns(statement.table))
                self._add(statement.table, rows)
                return len(rows)
            return 0

    def sql(self, query: str) -> DataFrame:
        """A Spark SQL query over all tables, each with the columns ts and ts_ms (the same), then its own; flushes first."""
        with self._lock:
            self.flush()
            functions.register(self.spark)
            for name in self.list_tables():
                found = self.catalog.table(name)
                rows = self.catalog.frame(found)
                rows.select(F.col(TS).alias(ALIAS), TS, *(F.col(f"`{n}`") for n, _ in found.columns)).createOrReplaceTempView('`' + name.replace("`", "``") + "`" if not name.replace("_", "").isalnum() else name)
            return self.spark.sql(query)

    def sql_arrow(self, query: str) -> pa.Table:
        return self.sql(query).toArrow()

    def sql_reader(self, query: str) -> pa.RecordBatchReader:
        """A stream with the result's schema, even if it has no rows; it exports the Arrow C stream interface."""
        return self.sql_arrow(query).to_reader()

    def sql_pandas(self, query: str):
        return self.sql(query).toPandas()

    def sql_polars(self, query: str):
        import polars

        return polars.from_arrow(self.sql_arrow(query))

    async def sql_async(self, query: str) -> pa.Table:
        return await asyncio.to_thread(self.sql_arrow, query)

    async def sql_pandas_async(self, query: str):
        return await asyncio.to_thread(self.sql_pandas, query)

    # Maintenance

    def pack_table(self, table: str, target_rows: int) -> None:
        """Rewrites a table into files of target_rows, clustered by time; its rows stay the same."""
        with self._lock:
            self._flush(table)
            maintenance.pack(self.catalog, table, target_rows)

    def pack_table_tiered(self, table: str, target_rows: int, most_files: int = 64) -> None:
        """Merges only commits whose files are smaller than target_rows, into most_files files at most."""
        with self._lock:
            self._flush(table)
            maintenance.pack_tiered(self.catalog, table, target_rows, most_files)

    def compact_retention(self, cutoff_ms: int) -> None:
        """Drops rows with ts_ms < cutoff_ms from all tables."""
        with self._lock:
            self.flush()
            for name in self.list_tables():
                maintenance.retain(self.catalog, name, cutoff_ms)

    def compact_retention_now(self, now_ms: int | None = None) -> None:
        if self._retention is not None:
            self.compact_retention((int(time.time() * 1000) if now_ms is None else now_ms) - self._retention)

    def maintain(self) -> list[str]:
        """What is due by the policy: retention, then packing; returns what was done. A failure is counted, not raised."""
        policy, done = self.options.maintenance, []
        if policy is None:
            return done
        with self._lock:
            if self._retention is not None and self.counters.retention_due(policy):
                if self.counters.attempt("retention", self.compact_retention_now):
                    done.append("retention")
            for name in self.list_tables():
                if maintenance.should_pack(self.catalog.table(name), policy, self.counters):
                    if self.counters.attempt("pack", lambda name=name: self.pack_table_tiered(name, policy.target_rows, policy.most_files)):
                        done.append(f"pack {name}")
        return done

    def start_maintenance(self) -> Callable[[], None]:
        """Runs maintain() at the policy's interval in a thread of its own; returns what stops it."""
        stop = threading.Event()

        def loop() -> None:
            while not stop.wait(self.options.maintenance.interval_s if self.options.maintenance else 5):
                self.maintain()

        thread = threading.Thread(target=loop, daemon=True)
        thread.start()

        def end() -> None:
            stop.set()
            thread.join()

        return end

    def vacuum(self, table: str) -> int:
        with self._lock:
            return self.catalog.vacuum(table)

    # Statistics

    def table_time_range(self, table: str) -> tuple[int, int] | None:
        """Smallest and largest time of the flushed rows, from the manifest alone."""
        commits = self.catalog.table(table).commits
        return (min(c.min_ts for c in commits), max(c.max_ts for c in commits)) if commits else None

    def stats(self, table: str) -> dict[str, Any]:
        return maintenance.stats(self.catalog, table)

    def column_stats(self, table: str) -> list[dict[str, Any]]:
        return maintenance.column_stats(self.catalog, table)

    def diagnose(self) -> dict[str, Any]:
        stored = sum(c.stored_bytes for n in self.list_tables() for c in self.catalog.table(n).commits)
        log = self._log.bytes
        return {
            "wal_bytes": log, "total_table_segment_bytes": stored, "wal_ratio": log / stored if stored else None,
            "pending_rows": sum(map(len, self._buffer.values())), "pending_tables": sum(map(bool, self._buffer.values())),
            **self.counters.report(),
        }

    def diagnostics(self) -> dict[str, Any]:
        """diagnose() with each table's and column's ratios and how maintenance went."""
        return {**self.diagnose(), "tables": [maintenance.diagnostics(self.catalog, n) for n in self.list_tables()], "maintenance": self.counters.maintenance()}
