"""Substring deduplication by sliding spans of sentences."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import chunks, read, ready, spent, stored, utf8
from tidemark.llm.simhash import NOT_BLANK
from tidemark.llm.tokens import LOWER, mixed, powers, prefix, runs, span_hashes

#: Sentences of a span, the words it has at least (it takes in more sentences until then) and at most. A sentence of WINDOW
#: words or more is cut after the word with the least hash of each WINDOW of its words, wherever it stands.
SENTENCES, LEAST_WORDS, MOST_WORDS, WINDOW = 3, 12, 25, 16

#: Characters that end a sentence, if a word ends with them.
STOPS = ".!?。！？．｡؟۔।॥…։።"
#: Code points of scripts that put no spaces between words: each character is a word.
SPACELESS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in STOPS if ord(c) < 128]] = True


def _kinds(raw: np.ndarray) -> np.ndarray:
    """For runs(): 0 blank, 1 any other; neighbouring characters of SPACELESS scripts are of kinds 2 and 3 in turn."""
    kind = NOT_BLANK[raw]
    lead = np.flatnonzero(raw >= 0xE0)
    lead = lead[lead + np.where(raw[lead] >= 0xF0, 3, 2) < len(raw)]
    if len(lead):
        four = raw[lead] >= 0xF0
        bits = [raw[lead + k].astype(np.int64) & 0x3F for k in (1, 2)]
        point = np.where(four, raw[lead].astype(np.int64) - 0xF0, raw[lead].astype(np.int64) & 0x0F) << 12 | bits[0] << 6 | bits[1]
        point = np.where(four, point << 6, point)  # the last six bits of four bytes tell no script apart
        alone = np.zeros(len(lead), bool)
        for a, b in SPACELESS:
            alone |= (point >= a) & (point <= b)
        at, four = lead[alone], four[alone]
        mine = (2 + np.arange(len(at)) % 2).astype(kind.dtype)
        for k in range(4):
            go = four | (k < 3)
            kind[at[go] + k] = mine[go]
    return kind


def _stops(raw: np.ndarray) -> np.ndarray:
    """Whether a character of STOPS ends at each byte."""
    out = _STOP[raw]
    if len(raw) and raw.max() >= 0x80:
        for c in STOPS:
            b = c.encode()
            if len(b) > 1 and len(raw) >= len(b):
                end = raw[len(b) - 1 :] == b[-1]
                for k in range(len(b) - 1):
                    end &= raw[k : len(raw) - len(b) + 1 + k] == b[k]
                out[len(b) - 1 :] |= end
    return out


class Sentences:
    """Of the rows of some texts: each sentence's row, first byte and words; a sentence's last word ends with one of STOPS or a
    line, long ones are cut."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        low = LOWER[raw]
        starts, ends = runs(_kinds(low), offsets)
        self.hashes = span_hashes(prefix(low), starts, ends)
        row = np.searchsorted(offsets, starts, "right") - 1
        last = np.ones(len(starts), bool)
        if len(starts):
            lines = np.concatenate([[0], np.cumsum(raw == 0x0A)])
            last[:-1] = _stops(raw)[ends[:-1] - 1] | (row[1:] != row[:-1]) | (lines[starts[1:]] > lines[ends[:-1]])
        self.ends = np.flatnonzero(last) + 1
        last[self._least()] = True
        first = np.flatnonzero(np.concatenate([[True], last[:-1]])) if len(starts) else np.zeros(0, np.int64)
        self.word = np.concatenate([first, [len(starts)]])
        self.row, self.byte = row[first], starts[first]

    def _least(self) -> np.ndarray:
        """The first word of the least hash in each WINDOW words of a sentence."""
        least, at, reach = self.hashes, np.arange(len(self.hashes)), 1
        if len(at) < WINDOW:
            return at[:0]
        while reach < WINDOW:
            step = min(reach, WINDOW - reach)
            right = least[step:] < least[: len(least) - step]
            least, at, reach = np.where(right, least[step:], least[: len(least) - step]), np.where(right, at[step:], at[: len(at) - step]), reach + step
        before = np.searchsorted(self.ends, np.arange(len(at)), "right")
        return np.unique(at[self.ends[before] >= np.arange(len(at)) + WINDOW])

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First sentence, sentences and hash of each span: from each sentence on and up to each sentence.

        Where the fewest whole sentences that make a span have over MOST_WORDS words, it is just so many words instead, and
        the sentences are those wholly in it. So a span's words depend on nothing around them: of any MOST_WORDS + WINDOW
        words that two texts share, both have a span.
        """
        n = len(self.row)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start, stop = self.word[:-1], self.word[1:]
        low, high = (self.word[np.searchsorted(self.row, self.row, side)] for side in ("left", "right"))
        begins = np.concatenate([[0], self.ends[:-1]])
        to = np.maximum(np.searchsorted(self.ends, start, "right") + SENTENCES - 1, np.searchsorted(self.ends, start + LEAST_WORDS, "left"))
        to = np.minimum(np.concatenate([self.ends, [len(self.hashes) + MOST_WORDS]])[np.minimum(to, len(self.ends))], start + MOST_WORDS)
        at = np.minimum(np.searchsorted(begins, stop, "left") - SENTENCES, np.searchsorted(begins, stop - LEAST_WORDS, "right") - 1)
        at = np.maximum(np.where(at < 0, -MOST_WORDS, begins[np.maximum(at, 0)]), stop - MOST_WORDS)
        forth, back = to <= high, at >= low
        size = len(self.hashes) + 1
        both = np.unique(np.concatenate([start[forth] * size + to[forth], at[back] * size + stop[back]]))
        lo, hi = both // size, both % size
        sums = np.zeros(size, np.uint64)
        forward, inverse = powers(size)
        np.cumsum(self.hashes * forward[: len(self.hashes)], out=sums[1:])
        first = np.searchsorted(self.word, lo, "left")
        return first, np.searchsorted(self.word, hi, "right") - 1 - first, mixed((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64))


def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(none, doc_id, text_hash, text) to (span, none, doc_id, text_hash, at, n, again): again if the batch has the span before."""
    for batch in batches:
        raw, offsets = utf8(batch.column(3))
        none, ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        parts = []
        for a, b in chunks(offsets):
            found = Sentences(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            first, n, h = found.spans()
            row = found.row[first]
            start = np.searchsorted(found.row, np.arange(b - a))
            parts.append((h, none[a:b][row], ids[a:b][row], marks[a:b][row], first - start[row], n))
        h, none, doc, mark, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, mark, doc, none, h))
        h, none, doc, mark, at, n = (x[order] for x in (h, none, doc, mark, at, n))
        same = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
        copy = same & np.concatenate([[False], (doc[1:] == doc[:-1]) & (at[1:] == at[:-1]) & (mark[1:] == mark[:-1]) & (none[1:] == none[:-1])]) if len(h) else same
        h, none, doc, mark, at, n, same = (x[~copy] for x in (h, none, doc, mark, at, n, same))
        yield pa.record_batch({"span": h.view(np.int64), "none": none, "doc_id": doc, "text_hash": mark, "at": at.astype(np.int32), "n": n.astype(np.int32), "again": same})


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, at, n) to (doc_id, n_sentences, n_removed, text): without the sentences that at and n cover."""
    for batch in batches:
        raw, offsets = utf8(batch.column(1))
        ats, ns = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        total, removed, texts = [], [], []
        for i in range(batch.num_rows):
            mine = raw[offsets[i] : offsets[i + 1]]
            found = Sentences(mine, np.array([0, len(mine)]))
            gone = np.zeros(len(found.row) + 1, np.int64)
            for at, n in zip(ats[i] or (), ns[i] or (), strict=True):
                gone[at] += 1
                gone[at + n] -= 1
            gone = np.cumsum(gone)[:-1] > 0
            total.append(len(found.row))
            removed.append(int(gone.sum()))
            if removed[-1]:
                ends = np.concatenate([found.byte[1:], [len(mine)]])
                data = mine.tobytes()
                texts.append(data[: found.byte[0]] + b"".join(data[a:b] for a, b, g in zip(found.byte.tolist(), ends.tolist(), gone.tolist(), strict=True) if not g))
            else:
                texts.append(None if not batch.column(1)[i].is_valid else mine.tobytes())
        yield pa.record_batch({"doc_id": batch.column(0), "n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())})


def deduplicate(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text): each text without the sentences of any repeated span but its first.

    A span is a run of SENTENCES consecutive sentences, with more until it has LEAST_WORDS words, the shortest from each
    sentence on and up to each sentence, or MOST_WORDS words if that is less. Long sentences are cut by their words, so of
    any passage of MOST_WORDS + WINDOW words, texts that share it share a span, whatever surrounds it. Spans are alike if their words are, but for the case of A-Z. The first is the one in the document with the smallest doc_id, and there the
    earliest. A batch of documents sends each of its spans on once, so a span that many documents share has as many
    rows in the shuffle as there are batches.

    Sentences end with STOPS or a line; words are what blanks part, and each character of a script without spaces.

    Null texts stay null, blank ones as they are; a text of fewer sentences and words has no span. Texts of one doc_id are
    documents of their own, in the order of a hash; those without doc_id come after all others. Repeated rows are the same
    document and keep what it keeps. An empty table gives no rows.
    """
    ready(docs.sparkSession)
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    every = stored(keyed.mapInArrow(spans, "span long, none boolean, doc_id long, text_hash long, at int, n int, again boolean"), "spans")
    place = ("none", "doc_id", "text_hash", "at")
    first = F.min(F.struct(*place)).over(Window.partitionBy("span"))
    fresh = every.where("not again").withColumn("first", first)
    later = fresh.where(F.col("first") != F.struct(*place)).select(*place, "n")
    marks = every.where("again").select(*place, "n").union(later)
    document = ["none", "doc_id", "text_hash"]
    marks = stored(marks.groupBy(*document).agg(F.collect_list(F.struct("at", "n")).alias("marks")), "marks")
    spent(every)
    joined = keyed.join(marks, document, "left")
    own = F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")
    return joined.select(own, "text", F.col("marks.at").alias("at"), F.col("marks.n").alias("n")).mapInArrow(_cut, "doc_id long, n_sentences long, n_removed long, text string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"))
