"""Tables: a declared schema, immutable commits of Parquet files, and a manifest of the live ones."""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import asdict, dataclass, field
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import footers
from tidemark.sources.files import Store
from tidemark.types import SEQ, TS, Columns, SchemaError, columns_of, row_schema


@dataclass(frozen=True)
class Commit:
    """Files written together. What the manifest holds of them is enough to skip them by time."""

    name: str
    rows: int
    files: int
    stored_bytes: int
    min_ts: int
    max_ts: int
    min_seq: int
    max_seq: int
    #: Compressed bytes of each column; manifests of earlier versions don't have them.
    stored: dict[str, int] | None = None


@dataclass(frozen=True)
class Table:
    name: str
    columns: Columns
    commits: list[Commit] = field(default_factory=list)
    #: The last batch that each stream has appended.
    streams: dict[str, int] = field(default_factory=dict)

    @property
    def rows(self) -> int:
        return sum(c.rows for c in self.commits)


class Catalog:
    """All tables under a root. A reader of a Table sees the commits of its manifest, whatever is written later."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.store.make("tables")

    def _at(self, table: str) -> str:
        return f"tables/{quote(table, safe='')}"

    def names(self) -> list[str]:
        found = [unquote(x) for x in self.store.list("tables")]
        return sorted(x for x in found if self.store.exists(f"{self._at(x)}/table.json"))

    def exists(self, table: str) -> bool:
        return self.store.exists(f"{self._at(table)}/table.json")

    def table(self, table: str) -> Table:
        if not self.exists(table):
            raise KeyError(f"no table {table!r}")
        read = self.store.read(f"{self._at(table)}/table.json")
        return Table(table, [tuple(c) for c in read["columns"]], [Commit(**c) for c in read["commits"]], read.get("streams", {}))

    def create(self, table: str, declared: list[tuple[str, str]]) -> Table:
        """Does nothing if the table is there with the same columns."""
        columns = columns_of(declared)
        if not table:
            raise SchemaError("a table needs a name")
        if self.exists(table):
            if (found := self.table(table)).columns != columns:
                raise SchemaError(f"table {table!r} exists with other columns")
            return found
        self.store.make(self._at(table))
        made = Table(table, columns)
        self._publish(made)
        return made

    def _publish(self, table: Table) -> None:
        self.store.write(f"{self._at(table.name)}/table.json", {"columns": table.columns, "commits": [asdict(c) for c in table.commits], "streams": table.streams})

    def write(self, table: Table, rows: DataFrame, most_rows_a_file: int = 0) -> Commit | None:
        """Writes rows (with SEQ) into a folder that no reader looks at yet; None if there are none."""
        name = f"c-{uuid.uuid4().hex}"
        path = f"{self._at(table.name)}/{name}"
        writer = rows.select(TS, *(n for n, _ in table.columns), SEQ).write.option("compression", "zstd").option("parquet.writer.version", "v2")
        (writer.option("maxRecordsPerFile", most_rows_a_file) if most_rows_a_file else writer).parquet(self.store.at(path))
        files = self.store.files(path, ".parquet")
        told = footers.summary(self.spark, files, (TS, SEQ))
        if not told.rows:
            self.store.drop(path)
            return None
        if not {TS, SEQ} <= told.least.keys():  # a session may turn Parquet's statistics off
            bounds = self.spark.read.schema(row_schema(table.columns, True)).parquet(self.store.at(path)).agg(F.min(TS), F.max(TS), F.min(SEQ), F.max(SEQ)).first()
        else:
            bounds = (told.least[TS], told.most[TS], told.least[SEQ], told.most[SEQ])
        return Commit(name, told.rows, told.files, self.store.bytes(path), *bounds, dict(told.stored))

    def stored(self, table: Table) -> dict[str, int]:
        """Compressed bytes of each column, from the manifest, or from footers where that doesn't tell."""
        out: Counter[str] = Counter()
        for c in table.commits:
            out.update(c.stored if c.stored is not None else footers.summary(self.spark, self.store.files(f"{self._at(table.name)}/{c.name}", ".parquet")).stored)
        return dict(out)

    def publish(self, table: str, added: list[Commit | None], dropped: list[Commit] = (), batch: tuple[str, int] | None = None) -> Table:
        """Swaps the manifest: added commits come in, dropped ones out, a stream's batch is noted, in one step."""
        now = self.table(table.name)
        gone = {c.name for c in dropped}
        after = Table(table.name, now.columns, sorted([c for c in now.commits if c.name not in gone] + [c for c in added if c], key=lambda c: c.min_seq), now.streams | dict([batch] if batch else []))
        self._publish(after)
        return after

    def vacuum(self, table: str) -> int:
        """Deletes folders of commits that are out of the manifest, once no reader needs them; returns how many."""
        live = {c.name for c in self.table(table).commits}
        gone = [x for x in self.store.list(self._at(table)) if x.startswith("c-") and x not in live]
        for x in gone:
            self.store.drop(f"{self._at(table)}/{x}")
        return len(gone)

    def frame(self, table: Table, low: int | None = None, high: int | None = None) -> DataFrame:
        """The committed rows with SEQ; commits wholly outside low ... high are not even listed."""
        live = [c for c in table.commits if (low is None or c.max_ts >= low) and (high is None or c.min_ts <= high)]
        schema = row_schema(table.columns, True)
        if not live:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").parquet(*(self.store.at(f"{self._at(table.name)}/{c.name}") for c in live))
