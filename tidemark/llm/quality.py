"""Quality filter by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import ready, chunks, read, stored, utf8
from tidemark.llm.tokens import LOWER, mixed, prefix, runs, span_hashes

#: Buckets of the n-gram models.
BUCKETS = 1 << 14
#: Labelled documents, by order of a hash of their id, that the target model and the size of the selection are fitted on.
MOST_LABELS = 20_000

#: Bytes that make words (letters, digits, all above ASCII) and those that make marks; the rest separates.
KIND = np.full(256, 2, np.uint8)
KIND[:33] = 0
KIND[127] = 0
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    KIND[_lo : _hi + 1] = 1


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word or mark and each pair of neighbours of the lower-cased text."""
    low = LOWER[raw]
    starts, ends = runs(KIND[low], offsets)
    h = span_hashes(prefix(low), starts, ends)
    row = np.searchsorted(offsets, starts, "right") - 1
    pair = np.flatnonzero(row[1:] == row[:-1])
    two = mixed(h[pair] * np.uint64(3) + h[pair + 1])
    return np.concatenate([row, row[pair]]), (np.concatenate([h, two]) % np.uint64(BUCKETS)).astype(np.int64)


def count(target: frozenset[int]):
    """For mapInArrow over (doc_id, text): n-gram counts by bucket of all documents and of those in target."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            mine = np.array([x in target for x in batch.column(0).to_pylist()], bool)
            for a, b in chunks(offsets):
                row, bucket = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[mine[a:b][row]], minlength=BUCKETS)
        yield pa.record_batch({"bucket": pa.array(range(BUCKETS), pa.int32()), "raw": total[0], "target": total[1]})

    return of


def weigh(text: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and log importance, the sum of their log ratios, of each text."""
    raw, offsets = utf8(text)
    n, weight = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1)
    for a, b in chunks(offsets):
        row, bucket = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        n[a:b] = np.bincount(row, minlength=b - a)
        weight[a:b] = np.bincount(row, ratio[bucket], minlength=b - a)
    return n, weight


def gumbel(ids: pa.Array) -> np.ndarray:
    """Standard Gumbel noise fixed by the id; null counts as -1."""
    h = mixed(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(0x5EED))
    return -np.log(-np.log((h >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54))


def score(ratio: np.ndarray):
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = weigh(batch.column(1), ratio)
            yield pa.record_batch({"doc_id": batch.column(0), "n_grams": n, "log_importance": weight, "key": weight + gumbel(batch.column(0))})

    return of


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest of a double column, exactly: each count by slot leaves one slot to look in."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        step = (high - low) / 4096
        if not low + step > low:
            return high if rows.where(F.col(column) >= high).count() >= k else low
        slot = F.least(F.floor((F.col(column) - low) / step), F.lit(4095)).cast("int")
        inside = rows.where(F.col(column).between(low, high))
        above = rows.where(F.col(column) > high).count()
        for r in inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("slot")).collect():
            if above + r.n >= k:
                break
            above += r.n
        if r.lo == r.hi:
            return r.lo
        low, high = r.lo, r.hi


class Fitted:
    """ratio: log of target over raw probability of each bucket; bar: the least key of the selection."""

    def __init__(self, docs: DataFrame, labels: DataFrame):
        spark = docs.sparkSession
        ready(spark)
        few = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS)
        good = {r.doc_id: r.quality == 1 for r in few.collect()}
        texts = docs.select(F.col("doc_id").cast("long"), "text")
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for r in texts.mapInArrow(count(frozenset(k for k, v in good.items() if v)), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
            raw[r.bucket], target[r.bucket] = r.raw, r.target
        self.ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS)) if target.any() else np.zeros(BUCKETS)
        self.scored = stored(texts.mapInArrow(score(self.ratio), "doc_id long, n_grams long, log_importance double, key double"), "importance")
        known = self.scored.where(F.col("doc_id").isNotNull()).join(F.broadcast(spark.createDataFrame(pa.table({"doc_id": pa.array(good, pa.int64()), "good": pa.array(good.values(), pa.bool_())}))), "doc_id")
        marks = [(r.log_importance, r.good) for r in known.select("log_importance", "good").collect()]
        self.level = level(np.array([m for m, _ in marks]), np.array([g for _, g in marks], bool))
        self.k = self.scored.where(F.col("log_importance") > self.level).count()
        self.bar = kth_largest(self.scored, "key", self.k) if self.k else float("inf")


def level(weight: np.ndarray, good: np.ndarray) -> float:
    """The log importance above which labelled documents are best taken for good ones: most right, both kinds counting alike."""
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    right = np.cumsum(~g) / (~g).sum() + 1 - np.cumsum(g) / g.sum()
    right[:-1][w[1:] == w[:-1]] = -1
    best = int(right.argmax())
    return float((w[best] + w[min(best + 1, len(w) - 1)]) / 2)


def select(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_grams, log_importance, key, selected) for each row of docs.

    log_importance is the log ratio of two bag-of-n-grams models at the whole text: one of the documents that labels
    calls good, one of all documents. A document's key adds Gumbel noise fixed by its id, so the k largest keys are a
    sample without replacement by importance. k is the number of documents above the importance that tells labelled good
    from bad documents best. All documents are counted and scored; MOST_LABELS labelled ones fit target and k.

    A null or blank text has importance 0. Repeated rows have the same key, are selected alike, and may exceed k. Ties at
    the k-th key are selected. Without labels of both kinds all documents are selected. An empty table gives no rows.
    """
    found = Fitted(docs, labels)
    return found.scored.withColumn("selected", F.col("key") >= found.bar)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that select() selects, with all their columns."""
    found = Fitted(docs, labels)
    ratio, bar = found.ratio, found.bar
    ids, texts = docs.columns.index("doc_id"), docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, weight = weigh(batch.column(texts), ratio)
            yield batch.filter(pa.array(weight + gumbel(batch.column(ids).cast(pa.int64())) >= bar))

    return docs.mapInArrow(keep, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
