"""Suffix-array deduplication of repeated byte strings."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.lm import _unz, _z
from tidemark.llm.shared import chunks, read, ready, stored, utf8
from tidemark.llm.tokens import mixed, powers, prefix

#: Bytes of a string that counts as repeated, and of the leading token that a suffix is sampled by.
LENGTH, LEAD = 50, 20
#: Places in a string where its leading token can start.
PLACES = LENGTH - LEAD + 1
#: Leading bytes that suffixes are range-partitioned by; samples of them that a segment gives, and segments asked.
KEY, SAMPLES, SAMPLED = 16, 64, 20_000
NO_ID = 2**63 - 1
SEGMENT = "segment string, doc_id array<long>, size array<int>, text binary, sample array<binary>"


class Suffixes:
    """The suffixes that stand for the strings of LENGTH bytes of some texts.

    A string is represented by the one of its tokens of LEAD bytes with the smallest hash (the leftmost of equals), which
    depends on the string alone: equal strings start equally far before equal suffixes. Neighbouring strings share their
    token, so one suffix in about 16 is left: at lead, for the strings that start at lo ... hi.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        parts = []
        for a, b in chunks(offsets):
            begin, end = int(offsets[a]), int(offsets[b])
            if end - begin < LENGTH:
                continue
            sums = prefix(raw[begin:end])
            n = end - begin - LEAD + 1
            h = mixed((sums[LEAD:] - sums[:-LEAD]) * powers(len(sums))[1][:n])
            best, reach = np.arange(n), 1
            for step in (1, 2, 4, 8, PLACES - 16):
                left, right = best[: n - reach - step + 1], best[step : n - reach + 1]
                best, reach = np.where(h[right] < h[left], right, left), reach + step
            at = offsets[a : b + 1] - begin
            row = np.repeat(np.arange(b - a), np.maximum(np.diff(at) - LENGTH + 1, 0))
            first = np.cumsum(np.maximum(np.diff(at) - LENGTH + 1, 0))
            start = np.arange(len(row)) + (at[:-1] - np.concatenate([[0], first[:-1]]))[row]
            if not len(start):
                continue
            lead = best[start]
            new = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (row[1:] != row[:-1])]))
            lo, hi = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
            whole = mixed((sums[hi + LENGTH] - sums[lo]) * powers(len(sums))[1][lo] + ((lead[new] - lo) * 64 + hi - lo).astype(np.uint64))
            parts.append((lead[new] + begin, lo + begin, hi + begin, row[new] + a, h[lead[new]], whole))
        self.lead, self.lo, self.hi, self.row, self.hash, self.whole = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2


def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to segments."""
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        some = Suffixes(raw[: offsets[np.searchsorted(offsets, 1 << 19)]] if offsets[-1] > 1 << 19 else raw, offsets[: np.searchsorted(offsets, 1 << 19) + 1] if offsets[-1] > 1 << 19 else offsets)
        lead = some.lead[np.linspace(0, len(some.lead) - 1, SAMPLES).astype(np.int64)] if len(some.lead) else np.zeros(0, np.int64)
        row = [[uuid.uuid4().hex], [batch.column(0)], [np.diff(offsets).astype(np.int32)], [zstandard.compress(raw.tobytes(), 3)], [[raw[a : a + KEY].tobytes() for a in lead.tolist()]]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary())]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["segment", "doc_id", "size", "text", "sample"])


class Segment:
    """A segment read again, and those of its suffixes whose leading tokens occur in another document too."""

    def __init__(self, batch: pa.RecordBatch, i: int, parts: int):
        get = lambda name: batch.column(name)[i]
        self.name, self.ids = get("segment").as_py(), get("doc_id").values
        self.raw = np.frombuffer(zstandard.decompress(get("text").as_py()), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(get("size").values.to_numpy(), dtype=np.int64)])
        self.doc = self.ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.found = Suffixes(self.raw, self.offsets)
        self.keys, self.of = np.unique(self.found.hash, return_inverse=True)
        self.part = (self.keys % np.uint64(parts)).astype(np.int64)

    def repeated(self, answers: list) -> None:
        """Leaves those suffixes whose token another segment has (by the answers) or another document of this one."""
        known = np.zeros(len(self.keys), bool)
        order = np.argsort(self.part, kind="stable")
        bounds = np.searchsorted(self.part[order], np.arange(int(self.part.max(initial=0)) + 2))
        for r in answers:
            if r["level"] == 1:
                known[order[bounds[r["part"]] : bounds[r["part"] + 1]]] = np.frombuffer(zstandard.decompress(r["answer"][0]), bool)
        doc = self.doc[self.found.row]
        low, high = np.full(len(self.keys), NO_ID), np.full(len(self.keys), -NO_ID)
        np.minimum.at(low, self.of, doc)
        np.maximum.at(high, self.of, doc)
        self.at = np.flatnonzero((known | (low < high))[self.of])
        _, self.first, self.kind = np.unique(self.found.whole[self.at], return_index=True, return_inverse=True)
        self.least = np.full(len(self.first), NO_ID)
        np.minimum.at(self.least, self.kind, doc[self.at])

    def records(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct suffix with its strings: LENGTH bytes from its lead and the bytes before it backwards (zeros
        fill up), and how many there are of both."""
        f, at = self.found, self.at[self.first]
        lead, left, right = f.lead[at], f.lead[at] - f.lo[at], f.hi[at] + LENGTH - f.lead[at]
        out = np.zeros((len(at), LENGTH + PLACES - 1), np.uint8)
        for k in range(LENGTH):
            go = k < right
            out[go, k] = self.raw[lead[go] + k]
        for k in range(PLACES - 1):
            go = k < left
            out[go, LENGTH + k] = self.raw[lead[go] - 1 - k]
        return out, left, right


def ask_tokens(parts: int):
    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Segment(batch, i, parts)
                order = np.argsort(s.part, kind="stable")
                names, first = np.unique(s.part[order], return_index=True)
                short = s.keys >> np.uint64(8) & np.uint64((1 << 40) - 1)  # a shorter hash only lets in suffixes that are compared in vain
                rows = [[_z(short[order[a:b]])] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True)]
                yield pa.record_batch({"part": pa.array(names, pa.int32()), "segment": pa.array([s.name] * len(names), pa.string()), "asked": pa.array(rows, pa.list_(pa.binary()))})

    return of


def answer_tokens(part: pd.DataFrame) -> pd.DataFrame:
    """Of each token asked for, whether more than one segment asks."""
    asked = [_unz(x[0], np.uint64) for x in part["asked"]]
    _, at, count = np.unique(np.concatenate(asked), return_inverse=True, return_counts=True)
    bounds = np.cumsum([0, *map(len, asked)])
    rows = [[zstandard.compress((count[at[a:b]] > 1).tobytes())] for a, b in zip(bounds, bounds[1:], strict=False)]
    return pd.DataFrame({"part": part["part"], "segment": part["segment"], "level": 1, "answer": rows})


def _words(records: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 64-bit words, which order like the bytes."""
    return np.ascontiguousarray(records).view(">u8").astype(np.uint64)


def _range(s: Segment, splitters: np.ndarray) -> tuple[np.ndarray, tuple]:
    bytes_, left, right = s.records()
    lead = np.ascontiguousarray(bytes_[:, :KEY]).view(f"S{KEY}").ravel()
    return np.searchsorted(splitters, lead, "right"), (bytes_, left, right)


def ask_strings(parts: int, splitters: np.ndarray):
    """For mapInArrow over segments with answers: each distinct suffix goes to the range of its leading bytes."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Segment(batch, i, parts)
                s.repeated(batch.column("answers")[i].as_py() or [])
                if len(s.first):
                    part, (bytes_, left, right) = _range(s, splitters)
                    order = np.argsort(part, kind="stable")
                    names, first = np.unique(part[order], return_index=True)
                    rows = [[zstandard.compress(bytes_[x].tobytes(), 3), _z(left[x].astype(np.uint8)), _z(right[x].astype(np.uint8)), _z(s.least[x])] for x in (order[a:b] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True))]
                    yield pa.record_batch({"part": pa.array(names, pa.int32()), "segment": pa.array([s.name] * len(names), pa.string()), "asked": pa.array(rows, pa.list_(pa.binary()))})

    return of


def multikey_order(words: np.ndarray) -> np.ndarray:
    """The order of rows by their words: multikey quicksort, which looks at a word only where all before it are equal."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.cumsum(np.concatenate([[0], words[order][1:, 0] != words[order][:-1, 0]]))
    for depth in range(1, words.shape[1]):
        many = np.bincount(group)[group] > 1
        at = np.flatnonzero(many)
        if not len(at):
            break
        word = words[order[at], depth]
        inner = np.lexsort((word, group[at]))
        order[at] = order[at[inner]]
        g, w = group[at], word[inner]
        new = np.zeros(len(order), bool)
        new[at[1:]] = (g[1:] == g[:-1]) & (w[1:] != w[:-1])
        group = group + np.cumsum(new)
    return order


def answer_strings(part: pd.DataFrame) -> pd.DataFrame:
    """Sorts a range's suffixes and finds for each of their strings the smallest document that has it."""
    asked = [(np.frombuffer(zstandard.decompress(x[0]), np.uint8).reshape(-1, LENGTH + PLACES - 1), *(_unz(y, k) for y, k in zip(x[1:], (np.uint8, np.uint8, np.int64), strict=True))) for x in part["asked"]]
    bytes_, left, right, doc = (np.concatenate([a[i] for a in asked]) for i in range(4))
    left, right = left.astype(np.int64), right.astype(np.int64)
    words = np.concatenate([_words(bytes_), (left * 64 + right)[:, None].astype(np.uint64)], axis=1)
    order = multikey_order(words)
    w = words[order]
    same_all = np.concatenate([[False], (w[1:] == w[:-1]).all(axis=1)])
    tail = LEAD - 16  # bytes of the third word that are still of the leading token
    token = np.concatenate([w[:, :2], (w[:, 2] >> np.uint64(64 - 8 * tail))[:, None]], axis=1)
    same_token = np.concatenate([[False], (token[1:] == token[:-1]).all(axis=1)])
    kind, group = np.cumsum(~same_all) - 1, np.cumsum(~same_token) - 1
    begin = np.flatnonzero(~same_all)
    least = np.minimum.reduceat(doc[order], begin)
    first, of = order[begin], group[begin]
    best = np.repeat(least[:, None], PLACES, axis=1)
    several = np.flatnonzero(np.bincount(of)[of] > 1)
    for lo in range(0, len(several), 1 << 16):
        # whole groups at a time
        a = int(np.searchsorted(of[several], of[several[lo]], "left")) if lo else 0
        b = int(np.searchsorted(of[several], of[several[min(lo + (1 << 16), len(several)) - 1]], "right")) if lo + (1 << 16) < len(several) else len(several)
        _compare(several[a:b], bytes_[first], left[first], right[first], least, best)
    kinds = np.empty(len(order), np.int64)
    kinds[order] = kind
    rows, at = [], 0
    for a in asked:
        rows.append(_runs(best[kinds[at : at + len(a[1])]], a[1].astype(np.int64), a[2].astype(np.int64)))
        at += len(a[1])
    return pd.DataFrame({"part": part["part"], "segment": part["segment"], "level": 2, "answer": rows})


def _common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with the one before it; -1 for the first."""
    out = np.full(len(rows), -1)
    for lo in range(1, len(rows), 1 << 16):
        hi = min(len(rows), lo + (1 << 16))
        differ = rows[lo:hi] != rows[lo - 1 : hi - 1]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def _compare(at: np.ndarray, bytes_: np.ndarray, left: np.ndarray, right: np.ndarray, least: np.ndarray, best: np.ndarray) -> None:
    """For suffixes in order that share their leading tokens with others: equal strings get their smallest document.

    A string that starts x bytes before a lead has LENGTH - x bytes from there on. Neighbours in the order of suffixes that
    have so many bytes in common are alike after the lead; neighbours in the order of what stands before it, read
    backwards, that have x in common are alike before it. Strings that are both are equal, byte by byte.
    """
    after = _common(bytes_[at, :LENGTH])
    behind = np.zeros((len(at), -(-(PLACES - 1) // 8) * 8), np.uint8)
    behind[:, : PLACES - 1] = bytes_[at, LENGTH : LENGTH + PLACES - 1]
    order = multikey_order(_words(behind))
    before = _common(behind[order][:, : PLACES - 1])
    same_before = np.empty(len(at), np.int64)
    for x in range(PLACES):
        has = np.flatnonzero((left[at] >= x) & (right[at] >= LENGTH - x))
        if not len(has):
            continue
        same_after = np.cumsum(after < LENGTH - x)
        same_before[order] = np.cumsum(before < x)
        _, inverse = np.unique((same_after * (len(at) + 1) + same_before)[has], return_inverse=True)
        low = np.full(inverse.max() + 1, NO_ID)
        np.minimum.at(low, inverse, least[at[has]])
        best[at[has], x] = low[inverse]


def _runs(best: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[bytes]:
    """Smallest documents of each suffix's strings, first string first, as runs: (runs of each suffix, lengths, documents)."""
    x = left[:, None] - np.arange(PLACES)[None, :]
    has = (x >= 0) & (x >= (LENGTH - right)[:, None])
    value = np.take_along_axis(best, np.clip(x, 0, PLACES - 1), axis=1)
    row = np.nonzero(has)[0]
    flat = value[has]
    new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])]) if len(flat) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return [_z(np.bincount(row[starts], minlength=len(left)).astype(np.uint8)), _z(np.diff(np.append(starts, len(flat))).astype(np.uint8)), _z(flat[starts])]


def _removed(s: Segment, answers: list, splitters: np.ndarray) -> np.ndarray:
    """Of each byte of a segment whether a string that covers it is in a smaller document."""
    gone = np.zeros(len(s.raw) + 1, np.int32)
    if not len(s.first):
        return gone[:-1] > 0
    part, _ = _range(s, splitters)
    order = np.argsort(part, kind="stable")
    bounds = {r["part"]: slice(*np.searchsorted(part[order], (r["part"], r["part"] + 1))) for r in answers if r["level"] == 2}
    f = s.found
    members = np.argsort(s.kind, kind="stable")
    head = np.searchsorted(s.kind[members], np.arange(len(s.first) + 1))
    for r in answers:
        if r["level"] != 2:
            continue
        mine = order[bounds[r["part"]]]
        runs_, length, least = (_unz(x, k) for x, k in zip(r["answer"], (np.uint8, np.uint8, np.int64), strict=True))
        runs_, length = runs_.astype(np.int64), length.astype(np.int64)
        owner = np.repeat(np.arange(len(mine)), runs_)
        ends = np.cumsum(length)
        begin = ends - length
        begin = begin - begin[np.cumsum(runs_) - runs_][owner] if len(owner) else begin
        kind = mine[owner]
        many = head[kind + 1] - head[kind]
        run = np.repeat(np.arange(len(kind)), many)
        spot = s.at[members[np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(head[kind], many)]]
        later = s.doc[f.row[spot]] > least[run]
        start = f.lo[spot[later]] + begin[run[later]]
        np.add.at(gone, start, 1)
        np.add.at(gone, start + length[run[later]] - 1 + LENGTH, -1)
    return np.cumsum(gone)[:-1] > 0


def remove(parts: int, splitters: np.ndarray):
    """For mapInArrow over segments with all answers."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Segment(batch, i, parts)
                answers = batch.column("answers")[i].as_py() or []
                s.repeated(answers)
                gone = _removed(s, answers, splitters)
                removed, spans, sums, kept = [], [], [], []
                for a, b in zip(s.offsets.tolist(), s.offsets[1:].tolist(), strict=False):
                    mine = gone[a:b]
                    text = (s.raw[a:b][~mine] if mine.any() else s.raw[a:b]).tobytes()
                    removed.append(int(mine.sum()))
                    spans.append(int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()))
                    sums.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
                yield pa.record_batch({"doc_id": s.ids, "n_bytes": pa.array(np.diff(s.offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sums, pa.string()), "kept": pa.array(kept, pa.binary())})

    return of


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of docs.

    Removes each byte of a text that a string of LENGTH bytes covers which also starts in a document with a smaller
    doc_id; strings are those of the texts as given, and don't cross texts.

    Suffixes are sampled by content, so that each string is reached from one suffix (see Suffixes). A first exchange finds
    the leading tokens that more than one document has; only their suffixes go on. They are partitioned by range of their
    leading bytes, with splitters sampled from all segments, sorted locally by their bytes, a word of
    eight at a time where all before are equal (multikey_order), and neighbours are compared, in this order and in that of what
    stands before them. Hashes only choose what is compared, and stand for suffixes that are equal within a segment. Splitters are compared with the bytes that the token begins with, so equal tokens never
    stand on both sides of a boundary. A segment of documents sends each distinct suffix once, with its smallest document;
    a passage that many documents share has one row for each segment.

    Null is an empty text. Rows without doc_id count as the last document. Repeated rows are one document's and keep what
    it keeps. Texts under LENGTH bytes stay whole. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    base = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, SEGMENT), "segments")
    parts = max(12, base.count())
    keys = np.array(sorted(bytes(x) for r in base.where("size(sample) > 0").select("sample").limit(SAMPLED).collect() for x in r.sample), f"S{KEY}")
    splitters = np.unique(keys[np.linspace(0, len(keys) - 1, parts + 1).astype(np.int64)[1:-1]]) if len(keys) else keys
    answer = "part int, segment string, level int, answer array<binary>"
    ask = "part int, segment string, asked array<binary>"
    text = base.drop("sample")
    tokens = stored(text.mapInArrow(ask_tokens(parts), ask).groupBy("part").applyInPandas(answer_tokens, answer), "tokens")

    def answered(answers: DataFrame) -> DataFrame:
        return text.join(answers.groupBy("segment").agg(F.collect_list(F.struct("part", "level", "answer")).alias("answers")), "segment", "left")

    strings = stored(answered(tokens).mapInArrow(ask_strings(parts, splitters), ask).groupBy("part").applyInPandas(answer_strings, answer), "strings")
    return answered(tokens.union(strings)).mapInArrow(remove(parts, splitters), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents")).drop("kept")


OP3_SQL = """
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
first AS (SELECT s, min(doc_id) AS f FROM s GROUP BY s HAVING count(DISTINCT doc_id) > 1),
later AS (SELECT doc_id, i FROM s JOIN first USING (s) WHERE f < doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
bounds AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, len(h) // 2, NULL FROM d),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST), 0) AS start FROM bounds),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a, b NULLS LAST) AS kept, coalesce(sum(b - a), 0) AS n_removed, count(b) AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN kept USING (doc_id)
"""
