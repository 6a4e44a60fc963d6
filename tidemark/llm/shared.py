"""What several operators of this subpackage use: reading, storing, byte-level text work, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words by contract: runs of bytes that are none of space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the byte-level operators hold as numpy arrays at a time.
CHUNK_BYTES = 2 << 20
#: Bytes that Spark puts in one Arrow batch at most.
BATCH_BYTES = 8 << 20

_fallback_roots: dict[str, str] = {}
#: Where each stored table is.
_paths: dict[int, tuple] = {}
_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset: on one machine a temporary folder, as
    in tests; on a cluster one in the warehouse, which its machines share."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_intermediate"
    app = spark.sparkContext.applicationId
    return _fallback_roots.setdefault(app, tempfile.mkdtemp(prefix="tidemark-"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def spent(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more, and lets Spark drop the shuffle files of what made them.

    Only call it when whatever was made of them is stored, too: a lost executor then needs none of them again.
    """
    for table in tables:
        owner, path = _paths.pop(id(table), (lambda: None, None))
        if owner() is table:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    gc.collect()
    if tables:  # Spark drops shuffle files once the driver's JVM has collected what refers to them
        tables[0].sparkSession._jvm.System.gc()


def fresh(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with, for columns that are added for a while."""
    return next(n for n in (f"own{i}_" for i in range(len(docs.columns) + 1)) if not any(c.lower().startswith(n) for c in docs.columns))


#: Rows of a few numbers that are sent to all tasks at most.
MOST_SENT = 1_000_000


def sent(small: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A stored table for the small side of a join: it travels to all tasks up to so many rows, and is shuffled beyond."""
    return F.broadcast(small) if small.count() <= most else small.hint("merge")


def ship(spark: SparkSession) -> None:
    """Sends this package's code to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        top = Path(__file__).parents[1]
        to = Path(tempfile.mkdtemp(prefix="tidemark-")) / f"{top.name}.zip"
        with zipfile.ZipFile(to, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, path.relative_to(top.parent))
        context.addPyFile(str(to))


def ready(spark: SparkSession) -> None:
    """Readies a session for this package's Python functions: their code, and a bound on each Arrow batch."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes; a longer text has a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the links u-v: (node, smallest node of its component), without the centres."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    leaf = root != np.arange(len(nodes))
    return nodes[leaf], nodes[root[leaf]]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(u) > 1 << 20:
            u, v = forest(u, v)
    u, v = forest(u, v)
    yield pa.record_batch({"u": u, "v": v})


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the links (u, v): root is the smallest node that links reach.

    Alternates large-star and small-star steps; each is an aggregation, which Spark combines where it reads, and a join with
    its stored result, whose large keys Spark can split, so no group is gathered. Rounds grow with the logarithm of the
    longest path. Centres and isolated nodes have no row.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").mapInArrow(_contract, "u long, v long"), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")
        wide = stored(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        small = stored(wide.groupBy("u").agg(F.min("v").alias("m")), "least")
        near = wide.join(small, "u").where("v <> m").select("v", "m")
        last, edges = edges, stored(small.union(near).distinct().toDF("u", "v"), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        spent(last, least, wide, small)
        if now == before:
            return edges.toDF("node", "root")
        before = now
