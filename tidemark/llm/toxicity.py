"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import KIND
from tidemark.llm.shared import chunks, read, ready, utf8
from tidemark.llm.tokens import LOWER, mixed, prefix, runs, span_hashes

#: Bytes of the character n-grams, buckets of their vectors, entries of a vector, words of a passage.
SHORTEST, LONGEST, BUCKETS, ENTRIES, PASSAGE = 3, 6, 1 << 18, 8, 5
#: Labelled documents of each kind, by order of a hash of their id, that are learnt from, and bytes of their texts.
MOST_DOCUMENTS, MOST_BYTES = 4000, 5 << 20
#: Documents that an n-gram's words must be in for it to have a vector: rarer ones tell documents apart, not classes.
LEAST_DOCUMENTS = 8
ROUNDS, WARM_UP, RATE, DECAY = 90, 25, 0.1, 5e-4
#: Times that a clean document weighs a toxic one; log odds of an empty passage, fixed, so that few words never speak for toxicity.
CLEAN, PRIOR = 2, -2.5


def subwords(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of each lower-cased word between its marked ends, and each word's row.

    A space stands for all that separates words; n-grams hold one at their ends only.
    """
    rows = len(offsets) - 1
    stream = np.full(len(raw) + rows + LONGEST + 1, 0x20, np.uint8)
    shift = np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    low = LOWER[raw]
    stream[np.arange(len(raw)) + shift] = np.where(KIND[low] == 1, low, 0x20)
    inner = stream != 0x20
    first = inner[1:] & ~inner[:-1]
    number = np.cumsum(first) - 1  # of the word at place i + 1
    begins = np.flatnonzero(first) + 1
    row = np.searchsorted(offsets[1:] + np.arange(1, rows + 1), begins, "right") if rows else np.zeros(0, np.int64)
    word, bucket = [], []
    packed = stream.astype(np.uint64)
    n = len(stream)
    value, whole = packed[:-1] | packed[1:] << np.uint64(8), inner[1:].copy()
    for k in range(SHORTEST, LONGEST + 1):
        value = value[: n - k + 1] | packed[k - 1 :] << np.uint64(8 * k - 8)
        if k > SHORTEST:
            whole = whole[: n - k + 1] & inner[k - 2 : n - 1][: n - k + 1]
        at = np.flatnonzero(whole[: n - k + 1])
        word.append(number[at])
        bucket.append((mixed(value[at] + np.uint64(k << 56)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return np.concatenate(word), np.concatenate(bucket), row


def passages(row: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A word of each distinct form of each passage, that passage, and each passage's row: PASSAGE words of a row at a time."""
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    start = np.concatenate([[True], row[1:] != row[:-1]])
    place = np.arange(len(row)) - np.maximum.accumulate(np.where(start, np.arange(len(row)), 0))
    of = np.cumsum(place % PASSAGE == 0) - 1
    order = np.lexsort((form, of))
    new = np.concatenate([[True], (of[order][1:] != of[order][:-1]) | (form[order][1:] != form[order][:-1])])
    return order[new], of[order[new]], row[place % PASSAGE == 0]


class Model:
    """A vector for each bucket; a word is the mean of its n-grams' vectors, a passage the mean of its PASSAGE words' (zero
    vectors stand for repeated words and fill up a short one).

    The softmax over two classes is linear in the passage's vector, so once trained one number for each bucket, the
    difference of the two classes' products with its vector, gives a passage's log odds exactly.
    """

    def __init__(self, texts: list[str], toxic: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        vectors = rng.normal(0, 0.1, (BUCKETS, ENTRIES))
        head = rng.normal(0, 0.5, (ENTRIES, 2))
        self.odds, self.bias = np.zeros(BUCKETS, np.float32), PRIOR
        if not len(texts) or toxic.all() or not toxic.any():
            return
        raw, offsets = utf8(pa.array(texts, pa.string()))
        low = LOWER[raw]
        starts, ends = runs((KIND[low] == 1).astype(np.uint8), offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        hashes = np.zeros(len(starts), np.uint64)
        for a, b in chunks(offsets):
            here = slice(*np.searchsorted(row, (a, b)))
            hashes[here] = span_hashes(prefix(low[offsets[a] : offsets[b]]), starts[here] - offsets[a], ends[here] - offsets[a])
        _, first, token = np.unique(hashes, return_index=True, return_inverse=True)
        forms = [low[a:b].tobytes() for a, b in zip(starts[first], ends[first], strict=True)]
        del raw, low, starts, ends, hashes, first
        found = []
        for lo in range(0, len(forms), 20_000):
            some = forms[lo : lo + 20_000]
            of_form, grams, _ = subwords(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
            found.append(((of_form + lo).astype(np.int32), grams.astype(np.int32)))
        word, bucket = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        del found
        per_word = np.bincount(word, minlength=len(forms))
        in_docs = np.bincount(np.unique(token * np.int64(len(texts)) + row) // len(texts), minlength=len(forms))
        common = np.bincount(bucket, in_docs[word], minlength=BUCKETS) >= LEAST_DOCUMENTS
        word, bucket = word[common[bucket]], bucket[common[bucket]]
        own, passage, of = passages(row, token)
        token = token[own]
        docs = np.bincount(of, minlength=len(texts))
        used, slot = np.unique(bucket, return_inverse=True)
        share = (1 / per_word.clip(1))[word]
        vectors, y = vectors[used], toxic[of].astype(np.float64)
        state = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, head)]
        some = docs[of] > 0
        balance = np.where(toxic, 1 / toxic.sum(), CLEAN / (~toxic).sum()) / (1 + CLEAN)
        for t in range(1, ROUNDS + 1):
            by_class = vectors @ head
            odds = by_class[:, 1] - by_class[:, 0]
            words = np.bincount(word, odds[slot] * share, minlength=len(forms))
            z = np.bincount(passage, words[token], minlength=len(of)) / PASSAGE + PRIOR
            # At first a document's passages share its label; later only the likeliest passage of a toxic one has it.
            weight = balance[of] / docs[of] * some
            if t > WARM_UP:
                order = np.lexsort((z, of))
                last = order[np.concatenate([of[order][1:] != of[order][:-1], [True]])]
                top = np.zeros(len(of), bool)
                top[last] = True
                weight = np.where(y == 1, np.where(top, balance[of], 0), weight + np.where(top, balance[of], 0))
            g = weight * (1 / (1 + np.exp(-z)) - y)
            per_form = np.bincount(token, (g / PASSAGE)[passage], minlength=len(forms))
            each = np.bincount(slot, per_form[word] * share, minlength=len(used))
            difference = head[:, 1] - head[:, 0]
            pull = each @ vectors
            grads = (each[:, None] * difference, np.stack([-pull, pull], axis=1))
            for x, grad, (m, v) in zip((vectors, head), grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                x -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12)
            vectors *= 1 - DECAY
        by_class = vectors @ head
        self.odds[used] = by_class[:, 1] - by_class[:, 0]

    def scores(self, text: pa.Array) -> np.ndarray:
        """Of each text the largest probability that one of its passages has; a text without words has the empty bag's."""
        raw, offsets = utf8(text)
        out = np.full(len(offsets) - 1, self.bias)
        for a, b in chunks(offsets, 1 << 20):
            part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            word, bucket, row = subwords(part, at)
            if len(row):
                low = LOWER[part]
                starts, ends = runs((KIND[low] == 1).astype(np.uint8), at)
                own, passage, of = passages(row, span_hashes(prefix(low), starts, ends))
                words = np.bincount(word, self.odds[bucket], minlength=len(row)) / np.bincount(word, minlength=len(row)).clip(1)
                z = np.bincount(passage, words[own], minlength=len(of)) / PASSAGE + self.bias
                best = np.full(b - a, -np.inf)
                np.maximum.at(best, of, z)
                out[a:b] = np.where(np.isfinite(best), best, self.bias)
        return 1 / (1 + np.exp(-out))


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """Learns from at most MOST_DOCUMENTS labelled documents of each kind and MOST_BYTES of their texts, taken whole."""
    ready(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = {}
    for kind in (0, 1):
        for r in known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_DOCUMENTS).collect():
            ids[r.doc_id] = kind
    few = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64()), "toxic": pa.array(ids.values(), pa.int32())}))
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("size")).join(F.broadcast(few), "doc_id").where("size is not null")
    total, taken = {0: 0, 1: 0}, set()
    for r in sorted(rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", "size").collect()):
        if total[r.toxic] + r.size <= MOST_BYTES:
            total[r.toxic] += r.size
            taken.add(r.doc_id)
    chosen = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(taken, pa.int64())}))
    found = sorted((r.doc_id, r.text, r.toxic) for r in rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect())
    return Model([t for _, t, _ in found], np.array([x == 1 for _, _, x in found], bool))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs: the probability that the whole text is toxic.

    Null, empty and wordless texts have the probability of the empty bag. Repeated rows score alike; an empty table gives
    no rows; columns other than doc_id and text are not read. A model of one kind of label or none scores all alike, low.
    """
    ready(docs.sparkSession)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column(0), "score": model.scores(batch.column(1))})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(of, "doc_id long, score double")


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), remainder(4) != 2)
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
