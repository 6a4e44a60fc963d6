"""What the footers of a folder's Parquet files tell, however many the files are."""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import pyarrow.parquet as pq
from pyspark.sql import SparkSession

#: Files whose footers come to Python as one, and threads that fetch them.
FOOTERS, READERS = 100, 8


@dataclass
class Summary:
    """Rows, compressed bytes of each column, and the least and largest values; a column is left out of them where a file has none."""

    files: int
    rows: int = 0
    stored: Counter[str] = field(default_factory=Counter)
    least: dict[str, int] = field(default_factory=dict)
    most: dict[str, int] = field(default_factory=dict)


def summary(spark: SparkSession, files: Any, bounded: Iterable[str] = ()) -> Summary:
    """Of files, an array of Hadoop's, all of one schema and writer; bounded: columns of integers whose bounds are wanted.

    The JVM merges the footers of many files, so that a file takes no calls from Python of its own.
    """
    sc = spark.sparkContext
    jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
    parquet, paths = jvm.org.apache.parquet, jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(files)
    n = len(files)

    def fetched(at: int) -> pq.FileMetaData:
        some = sc._gateway.new_array(jvm.java.lang.Object, min(FOOTERS, n - at))
        jvm.java.lang.System.arraycopy(paths, at, some, 0, len(some))
        merged = parquet.hadoop.ParquetFileWriter.mergeMetadataFiles(jvm.java.util.Arrays.asList(some), conf)
        out = jvm.java.io.ByteArrayOutputStream()
        parquet.format.Util.writeFileMetaData(parquet.format.converter.ParquetMetadataConverter().toParquetMetadata(1, merged), out)
        footer = bytes(out.toByteArray())
        return pq.read_metadata(io.BytesIO(b"PAR1" + footer + len(footer).to_bytes(4, "little") + b"PAR1"))

    found, bounds, unknown = Summary(n), {b: [] for b in bounded}, set()
    with ThreadPoolExecutor(READERS) as pool:
        for part in pool.map(fetched, range(0, n, FOOTERS)):
            for group in map(part.row_group, range(part.num_row_groups)):
                found.rows += group.num_rows
                for column in map(group.column, range(group.num_columns)):
                    name = column.path_in_schema
                    found.stored[name] += column.total_compressed_size
                    if name in bounds:
                        s = column.statistics
                        if s is not None and s.has_min_max:
                            bounds[name] += [s.min, s.max]
                        else:
                            unknown.add(name)
    known = {b: v for b, v in bounds.items() if v and b not in unknown}
    found.least, found.most = {b: min(v) for b, v in known.items()}, {b: max(v) for b, v in known.items()}
    return found
