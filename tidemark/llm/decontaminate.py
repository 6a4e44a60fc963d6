"""Benchmark decontamination with a distributed positional inverted index."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import ready, chunks, read, stored, utf8
from tidemark.llm.tokens import LOWER, mixed, prefix, runs, span_hashes

#: Bytes of text that one index segment covers (a row counts as ROW_BYTES more), and of benchmark items that one search takes along.
SEGMENT_BYTES, ROW_BYTES, BLOCK_BYTES = 8 << 20, 64, 8 << 20
#: Windows, and places of their rarest terms, that a search holds at a time.
WINDOWS, PAIRS = 1 << 16, 1 << 19

#: Letters and digits of ASCII and all bytes above it make words.
KIND = np.zeros(256, np.uint8)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    KIND[_lo : _hi + 1] = 1

SEGMENT = "segment string, doc_id array<long>, text_hash array<long>, n_words array<int>, terms array<int>, counts array<int>, gaps array<int>"
FOUND = "segment string, place int, doc_id long, text_hash long, n_words long, spans array<int>, items array<string>"


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and for each row the places of its first and last + 1 word."""
    low = LOWER[raw]
    starts, ends = runs(KIND[low], offsets)
    return span_hashes(prefix(low), starts, ends), np.searchsorted(starts, offsets[:-1]), np.searchsorted(starts, offsets[1:])


def item_words(items: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the items' texts, one item after the other, and where each item begins and ends."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for batch in items.select(["text"]).to_batches():
        raw, offsets = utf8(batch.column(0))
        for a, b in chunks(offsets):
            h, lo, hi = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            hashes.append(h)
            counts.append(hi - lo)
    return np.concatenate(hashes), np.cumsum(np.concatenate(counts))


class Phrases:
    """Test windows as term numbers: of window consecutive item words, or of the whole item if it has fewer.

    Windows are places in the sequence of all items' words, equal ones are held once. owners: for each window, from bounds[i]
    to bounds[i + 1], the numbers of the items' names.
    """

    def __init__(self, items: pa.Table, window: int, terms: np.ndarray | None = None):
        hashes, ends = item_words(items)
        self.window, self.terms = window, np.unique(hashes) if terms is None else terms
        self.words = np.searchsorted(self.terms, hashes).astype(np.int32)
        self.names, name = np.unique(np.array(items["item"].to_pylist(), object), return_inverse=True)
        count = np.diff(ends)
        each = np.where(count > 0, np.maximum(count - window, 0) + 1, 0)
        of = np.repeat(np.arange(len(count)), each)
        start = ends[of] + np.arange(len(of)) - (np.cumsum(each) - each)[of]
        size = np.minimum(count, window)[of]
        # Equal windows have equal hashes; one whose words differ from those of the first with its hash stays on its own.
        _, first, same = np.unique(self._hashes(start, size), return_index=True, return_inverse=True)
        first = first[same]
        apart = size != size[first]
        for j in range(window):
            there = ~apart & (j < size)
            apart[there] |= self.words[start[there] + j] != self.words[start[first[there]] + j]
        first = np.where(apart, np.arange(len(start)), first)
        held, number = np.unique(first, return_inverse=True)
        self.start, self.size = start[held], size[held].astype(np.int32)
        pair = np.unique(number.astype(np.int64) * max(len(self.names), 1) + name[of])
        self.owners = (pair % max(len(self.names), 1)).astype(np.int32)
        self.bounds = np.searchsorted(pair // max(len(self.names), 1), np.arange(len(held) + 1))

    def _hashes(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        h = size.astype(np.uint64)
        for j in range(self.window):
            there = j < size
            h[there] = mixed(h[there]) + self.words[start[there] + j].astype(np.uint64)
        return h

    def matrix(self, a: int, b: int) -> np.ndarray:
        """Terms of the windows from number a to b; len(self.terms) stands behind the end of shorter ones."""
        offset = np.arange(self.window)
        there = offset < self.size[a:b, None]
        return np.where(there, self.words[np.where(there, self.start[a:b, None] + offset, 0)], len(self.terms))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers, -1 for words that no item has."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int32)
        at = np.searchsorted(self.terms, hashes).clip(max=len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1).astype(np.int32)


def index(phrases: Phrases):
    """For mapInArrow over (doc_id, text, text_hash): segments of postings of the test terms.

    Word places count on through a segment, with a gap of a window between documents, so no match crosses them.
    """

    def segment(parts: list) -> pa.RecordBatch:
        ids, marks = (pa.concat_arrays([p[i] for p in parts]) for i in (0, 1))
        n_words = np.concatenate([p[2] for p in parts])
        base = np.concatenate([[0], np.cumsum(n_words + phrases.window)])
        first = np.cumsum([0, *(len(p[2]) for p in parts)])
        term, place = [], []
        for f, (_, _, n, at, numbers) in zip(first, parts, strict=False):
            doc = np.searchsorted(np.cumsum(n), at, "right")
            term.append(numbers)
            place.append(base[f + doc] - (np.cumsum(n) - n)[doc] + at)
        term, place = np.concatenate(term), np.concatenate(place)
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        terms, starts, counts = np.unique(term, return_index=True, return_counts=True)
        gaps = np.diff(place, prepend=0)
        gaps[starts] = place[starts]
        one = lambda x, kind: pa.ListArray.from_arrays([0, len(x)], pa.array(x, kind))
        row = {"segment": pa.array([uuid.uuid4().hex]), "doc_id": one(ids, pa.int64()), "text_hash": one(marks, pa.int64())}
        return pa.record_batch(row | {k: one(v, pa.int32()) for k, v in (("n_words", n_words), ("terms", terms), ("counts", counts), ("gaps", gaps))})

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets):
                hashes, lo, hi = words(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                numbers = phrases.numbers(hashes)
                at = np.flatnonzero(numbers >= 0)
                parts.append((batch.column(0)[a:b], batch.column(2)[a:b], hi - lo, at.astype(np.int32), numbers[at]))
                size += int(offsets[b] - offsets[a]) + ROW_BYTES * (b - a)
                if size >= SEGMENT_BYTES:
                    yield segment(parts)
                    parts, size = [], 0
        if parts:
            yield segment(parts)

    return of


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for batch in batches:
        total, at = np.unique(np.concatenate([total, batch.column(0).flatten().to_numpy()]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, batch.column(1).flatten().to_numpy()]), len(total)).astype(np.int64)
    yield pa.record_batch({"term": pa.array(total, pa.int32()), "n": pa.array(n, pa.int64())})


def _near(lists: list[np.ndarray], slop: int) -> list[tuple[int, int]]:
    """Every minimal span that holds every list's term, as often as lists repeat, within len(lists) + slop places; the first is the rarest."""
    need = len(lists) + slop
    terms = {x.tobytes(): x for x in lists}
    often = [(x, sum(y.tobytes() == name for y in lists)) for name, x in terms.items()]
    fits = lambda lo, hi: all(np.searchsorted(x, hi) - np.searchsorted(x, lo) >= k for x, k in often)
    found = set()
    for p in lists[0].tolist():
        near = sorted({int(q) for x in terms.values() for q in x[np.searchsorted(x, p - need + 1) : np.searchsorted(x, p + need)]})
        for lo in (q for q in near if q <= p):
            hi = next((q + 1 for q in near if p <= q < lo + need and fits(lo, q + 1)), None)
            if hi is not None and not fits(lo + 1, hi) and not fits(lo, hi - 1):
                found.add((lo, hi))
    return sorted(found)


class Postings:
    """The postings of a segment: places of all terms in one array, by term and place."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, gaps: np.ndarray, size: int):
        run = np.cumsum(gaps, dtype=np.int64)
        ends = np.cumsum(counts, dtype=np.int64)
        starts = ends - counts
        self.places = run - np.repeat(run[starts] - gaps[starts], counts)
        self.first, self.count = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        self.first[terms], self.count[terms] = starts, counts
        self.keys = np.repeat(terms.astype(np.int64) << 32, counts) | self.places

    def of(self, term: int) -> np.ndarray:
        return self.places[self.first[term] : self.first[term] + self.count[term]]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = term.astype(np.int64) << 32 | place
        return self.keys[np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)] == key

    def phrases(self, windows: np.ndarray, order: np.ndarray, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows (by row) and first places of their exact occurrences: places of each window's rarest term, shifted by its offset,
        are kept if they are among those of the next one, and so on. end stands behind the end of shorter windows."""
        rare = windows[np.arange(len(windows)), order[:, 0]]
        many = np.cumsum(self.count[rare])
        a = 0
        while a < len(windows):
            b = max(a + 1, int(np.searchsorted(many, (many[a - 1] if a else 0) + PAIRS, "right")))
            n = self.count[rare[a:b]]
            row = np.repeat(np.arange(a, b), n)
            at = self.places[np.repeat(self.first[rare[a:b]] - (np.cumsum(n) - n), n) + np.arange(len(row))] - order[row, 0]
            row, at = row[at >= 0], at[at >= 0]
            for j in range(1, windows.shape[1]):
                offset = order[row, j]
                term = windows[row, offset]
                fits = (term == end) | self.has(term, at + offset)
                row, at = row[fits], at[fits]
            yield row, at
            a = b


def search(phrases: Phrases, count: np.ndarray, slop: int | None = None):
    """For mapInArrow over segments: FOUND rows, one for each document.

    A window's posting lists are shifted by the term's offset and intersected, from the rarest term of the corpus on. With
    slop, matches are spans that hold the window's words in any order within so many more places.
    """
    end = len(phrases.terms)
    often = np.append(count[:end], np.iinfo(np.int64).max)

    def found(postings: Postings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of windows, and the first place and the last + 1 of each match."""
        present = postings.count > 0
        present[end] = True
        for a in range(0, len(phrases.start), WINDOWS):
            windows = phrases.matrix(a, min(a + WINDOWS, len(phrases.start)))
            here = np.flatnonzero(present[windows].all(axis=1))
            if not len(here):
                continue
            windows = windows[here]
            order = np.argsort(often[windows], axis=1, kind="stable")
            if slop is None:
                for row, at in postings.phrases(windows, order, end):
                    yield a + here[row], at, at + phrases.size[a + here[row]]
            else:
                for w, terms, first in zip((a + here).tolist(), windows, order, strict=True):
                    spans = np.array(_near([postings.of(t) for t in terms[first][: phrases.size[w]]], slop), np.int64).reshape(-1, 2)
                    yield np.full(len(spans), w), spans[:, 0], spans[:, 1]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, ids, marks, n_words, terms, counts, gaps = (batch.column(i)[row] for i in range(7))
                n_words, terms, counts, gaps = (x.values.to_numpy() for x in (n_words, terms, counts, gaps))
                docs = len(n_words)
                base = np.cumsum(n_words.astype(np.int64) + phrases.window) - n_words - phrases.window
                spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
                items: dict[int, set[int]] = defaultdict(set)
                if len(terms):
                    for window, lo, hi in found(Postings(terms, counts, gaps, end)):
                        doc = np.searchsorted(base, lo, "right") - 1
                        for d, a, b in zip(doc.tolist(), (lo - base[doc]).tolist(), (hi - base[doc]).tolist(), strict=True):
                            spans[d].append((a, b))
                        for d, w in np.unique(np.stack([doc, window]), axis=1).T.tolist():
                            items[d].update(phrases.owners[phrases.bounds[w] : phrases.bounds[w + 1]].tolist())
                yield pa.record_batch(
                    {
                        "segment": pa.array([name.as_py()] * docs, pa.string()),
                        "place": pa.array(range(docs), pa.int32()),
                        "doc_id": ids.values,
                        "text_hash": marks.values,
                        "n_words": pa.array(n_words, pa.int64()),
                        "spans": pa.array([_merged(spans.get(i, ())) for i in range(docs)], pa.list_(pa.int32())),
                        "items": pa.array([sorted(phrases.names[list(items.get(i, ()))].tolist()) for i in range(docs)], pa.list_(pa.string())),
                    }
                )

    return of


def _merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Starts and ends in turn of the spans' union."""
    out: list[int] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1]:
            out[-1] = max(out[-1], hi)
        else:
            out += [lo, hi]
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, slop: int | None = None) -> DataFrame:
    """FOUND rows, one for each row of docs: n_words, the merged word spans that occurrences cover, the items they are of.

    Builds a positional inverted index of the terms that benchmark has over the whole texts of docs, stored in segments of
    documents, then intersects offset-adjusted posting lists in each segment. Only counts by test term reach the driver.
    The benchmark travels to the tasks in blocks of BLOCK_BYTES; beyond one block, the index is searched for each, and what
    is found of a document is merged. The driver holds one block and the distinct terms of all.

    A null or wordless text has no words and no match; a null or wordless item occurs nowhere; items are joined by their
    id as text, null as empty. Repeated rows are matched each; an empty table of either kind gives no matches.
    """
    spark = docs.sparkSession
    ready(spark)
    sized = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    blocks = max(1, -(-(sized.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // BLOCK_BYTES))
    block = lambda k: sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).toArrow()
    terms = np.zeros(0, np.uint64)
    for k in range(blocks):
        terms = np.union1d(terms, item_words(block(k))[0])
    phrases = Phrases(sized.limit(0).toArrow(), window, terms)
    built = stored(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(index(phrases), SEGMENT), "index")
    count = np.zeros(len(terms) + 1, np.int64)
    sums = built.select("terms", "counts").mapInArrow(_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    count[sums["term"].to_numpy()] = sums["n"].to_numpy()
    found = [built.mapInArrow(search(Phrases(block(k), window, terms), count, slop), FOUND) for k in range(blocks)]
    if blocks == 1:
        return found[0]
    every = found[0]
    for more in found[1:]:
        every = every.union(more.where(F.size("items") > 0))
    pairs = F.transform(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2)), lambda i: F.struct(F.get("spans", i).alias("lo"), F.get("spans", i + 1).alias("hi")))
    every = every.withColumn("pairs", F.when(F.size("spans") > 0, pairs).otherwise(F.array().cast("array<struct<lo:int,hi:int>>")))
    both = every.groupBy("segment", "place").agg(*(F.any_value(c).alias(c) for c in ("doc_id", "text_hash", "n_words")), F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    last = lambda out: F.element_at(out, -1)
    union = F.aggregate(
        "pairs",
        F.array().cast("array<int>"),
        lambda out, x: F.when(F.size(out) == 0, F.array(x["lo"], x["hi"])).when(x["lo"] <= last(out), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.greatest(last(out), x["hi"])))).otherwise(F.concat(out, F.array(x["lo"], x["hi"]))),
    )
    return both.select("segment", "place", "doc_id", "text_hash", "n_words", union.alias("spans"), "items")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs in which no window of benchmark occurs."""
    leaked = matches(docs, benchmark, window).where(F.size("items") > 0).select(F.col("doc_id").alias("leaked_id"), F.col("text_hash").alias("leaked_hash")).distinct()
    leaked = stored(leaked, "leaked")
    return docs.join(leaked, F.col("doc_id").eqNullSafe(F.col("leaked_id")) & (F.xxhash64("text") == F.col("leaked_hash")), "left_anti")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    spans = F.coalesce(F.aggregate(F.col("spans"), F.lit(0).cast("long"), lambda total, x: -total + x), F.lit(0))
    return found.select(
        "doc_id",
        "n_words",
        spans.cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, array_to_string(list_slice(w, i, i + 9), ' ') AS win, len(list_slice(w, i, i + 9)) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
spans AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT s.doc_id, s.i, s.n, x.item FROM spans s JOIN windows x ON s.win = x.win AND s.n = x.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
