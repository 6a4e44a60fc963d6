"""Packing, retention, and statistics of tables."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import functions as F

from tidemark.sources.catalog import Catalog, Commit, Table
from tidemark.types import SEQ, TS

#: Bytes of a value before compression; text counts only where it is stored.
RAW = {"f64": 8, "i64": 8, "bool": 1, "utf8": 0}
#: About as many rows, or stored bytes, a task of pack() sorts and writes, one file after another.
TASK_ROWS, TASK_BYTES = 250_000, 64 << 20


@dataclass(frozen=True)
class Policy:
    """When maintain() packs and retains. A table with over small_files small files and over small_ratio of all its files
    small is packed, unless rows come faster than most_writes_per_s or came within idle_s."""

    interval_s: float = 5
    retention_interval_s: float = 60
    small_files: int = 32
    small_ratio: float = 0.5
    target_rows: int = 8192
    most_writes_per_s: int = 100_000
    idle_s: float = 1
    most_files: int = 64


@dataclass
class Counters:
    rows: int = 0
    batches: int = 0
    arrow: deque = field(default_factory=lambda: deque(maxlen=1000))
    done: dict[str, int] = field(default_factory=lambda: {"pack_success": 0, "pack_fail": 0, "retention_success": 0, "retention_fail": 0})
    errors: dict[str, str | None] = field(default_factory=lambda: {"last_pack_error": None, "last_retention_error": None})
    _window: float = field(default_factory=time.monotonic)
    _writes: int = 0
    _last_write: float = field(default_factory=time.monotonic)
    _last_retention: float = float("-inf")

    def wrote(self, rows: int) -> None:
        now = time.monotonic()
        if now - self._window >= 5:
            self._window, self._writes = now, 0
        self._writes += rows
        self._last_write = now

    def writes_per_s(self) -> int:
        return int(self._writes / max(1e-3, time.monotonic() - self._window))

    def idle_s(self) -> float:
        return time.monotonic() - self._last_write

    def retention_due(self, policy: Policy) -> bool:
        if time.monotonic() - self._last_retention < policy.retention_interval_s:
            return False
        self._last_retention = time.monotonic()
        return True

    def attempt(self, what: str, do: Callable[[], None]) -> bool:
        try:
            do()
        except Exception as e:  # noqa: BLE001  counted for diagnostics; the next round tries again
            self.done[f"{what}_fail"] += 1
            self.errors[f"last_{what}_error"] = str(e)
            return False
        self.done[f"{what}_success"] += 1
        return True

    def report(self) -> dict[str, Any]:
        return {
            "row_append_count": self.rows, "batch_append_count": self.batches, "arrow_batch_avg_latency_ms": sum(self.arrow) / len(self.arrow) if self.arrow else None,
            "writes_per_sec": self.writes_per_s(), "last_write_age_ms": int(self.idle_s() * 1000),
        }

    def maintenance(self) -> dict[str, Any]:
        return {**self.done, **self.errors}


def _small(commit: Commit, target_rows: int) -> bool:
    return commit.rows < target_rows * commit.files


def should_pack(table: Table, policy: Policy, counters: Counters) -> bool:
    small = [c for c in table.commits if _small(c, policy.target_rows)]
    files = sum(c.files for c in table.commits)
    busy = counters.writes_per_s() >= policy.most_writes_per_s > 0
    return not busy and counters.idle_s() >= policy.idle_s and sum(c.files for c in small) > max(policy.small_files, policy.small_ratio * files)


def _rewrite(catalog: Catalog, table: Table, commits: list[Commit], target_rows: int, most_files: int | None = None) -> None:
    """Into files of target_rows by ranges of time, so that a file's statistics tell what times it has.

    A task writes as many files as its range fills, since starting a task takes longer than sorting a small file's rows.
    """
    if target_rows <= 0:
        raise ValueError("files must have rows")
    rows = sum(c.rows for c in commits)
    files = max(1, -(-rows // target_rows))
    tasks = max(catalog.spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS), -(-sum(c.stored_bytes for c in commits) // TASK_BYTES)) if most_files is None else most_files
    part = catalog.frame(Table(table.name, table.columns, commits)).repartitionByRange(min(files, tasks), TS, SEQ).sortWithinPartitions(TS, SEQ)
    made = catalog.write(table, part, most_rows_a_file=target_rows if most_files is None else 0)
    catalog.publish(table, [made], commits)


def pack(catalog: Catalog, table: str, target_rows: int) -> None:
    found = catalog.table(table)
    if found.commits:
        _rewrite(catalog, found, found.commits, target_rows)


def pack_tiered(catalog: Catalog, table: str, target_rows: int, most_files: int = 64) -> None:
    """Merges the oldest small commits, as many as fill most_files files; the rest stays as it is."""
    found = catalog.table(table)
    small, rows = [], 0
    for c in (c for c in found.commits if _small(c, target_rows)):
        if small and rows + c.rows > target_rows * most_files:
            break
        small.append(c)
        rows += c.rows
    if len(small) > 1 or sum(c.files for c in small) > 1:
        _rewrite(catalog, found, small, target_rows, most_files)


def retain(catalog: Catalog, table: str, cutoff_ms: int) -> None:
    """Commits wholly before the cutoff leave the manifest unread; only those that straddle it are rewritten."""
    found = catalog.table(table)
    gone = [c for c in found.commits if c.max_ts < cutoff_ms]
    cut = [c for c in found.commits if c.min_ts < cutoff_ms <= c.max_ts]
    if not gone and not cut:
        return
    made = catalog.write(found, catalog.frame(Table(table, found.columns, cut)).where(F.col(TS) >= cutoff_ms)) if cut else None
    catalog.publish(found, [made], [*gone, *cut])


def stats(catalog: Catalog, table: str) -> dict[str, Any]:
    """Raw and stored sizes of the flushed rows, from the manifest alone unless an earlier version wrote it."""
    found = catalog.table(table)
    stored = catalog.stored(found)
    rows, files = found.rows, sum(c.files for c in found.commits)
    on_disk = sum(c.stored_bytes for c in found.commits)
    raw_ts, raw_values = 8 * rows, rows * sum(RAW[k] for _, k in found.columns)
    values = sum(stored.get(n, 0) for n, _ in found.columns)
    out = {
        "rows": rows, "segments": files, "columns": len(found.columns), "raw_ts_bytes": raw_ts, "raw_value_bytes": raw_values, "raw_total_bytes": raw_ts + raw_values,
        "stored_ts_bytes": stored.get(TS, 0), "stored_value_bytes": values, "stored_total_bytes": stored.get(TS, 0) + values, "header_bytes": on_disk - sum(stored.values()), "on_disk_bytes": on_disk,
        "schema_file_bytes": catalog.store.size(f"{catalog._at(table)}/table.json"),
    }
    for name, raw, size in (("total", raw_ts + raw_values, on_disk), ("ts_blob", raw_ts, out["stored_ts_bytes"]), ("value_blob", raw_values, values)):
        if size > 0:
            out[f"compression_ratio_{name}_x"] = raw / size
    return out


def column_stats(catalog: Catalog, table: str) -> list[dict[str, Any]]:
    """Of each column: logical bytes of its values that aren't null, stored bytes, nulls."""
    found = catalog.table(table)
    sizes = [F.sum(F.octet_length(f"`{n}`")) if k == "utf8" else F.count(f"`{n}`") * RAW[k] for n, k in found.columns]
    row = catalog.frame(found).agg(*(F.coalesce(s, F.lit(0)).alias(f"s{i}") for i, s in enumerate(sizes)), *(F.count(f"`{n}`").alias(f"n{i}") for i, (n, _) in enumerate(found.columns))).first()
    stored = catalog.stored(found)
    return [
        {"column": n, "type": k, "logical_bytes": row[f"s{i}"], "stored_bytes": stored.get(n, 0), "compression_ratio": row[f"s{i}"] / stored[n] if stored.get(n) else None, "rows": found.rows, "nulls": found.rows - row[f"n{i}"]}
        for i, (n, k) in enumerate(found.columns)
    ]


def diagnostics(catalog: Catalog, table: str) -> dict[str, Any]:
    s = stats(catalog, table)
    ratio = lambda raw, size: raw / size if size else None
    return {
        "table": table, "rows": s["rows"], "segments": s["segments"], "columns": column_stats(catalog, table), "ts_compression_ratio": ratio(s["raw_ts_bytes"], s["stored_ts_bytes"]),
        "value_compression_ratio": ratio(s["raw_value_bytes"], s["stored_value_bytes"]), "total_compression_ratio": ratio(s["raw_total_bytes"], s["on_disk_bytes"]),
    }
