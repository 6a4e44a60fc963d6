"""Language-model scoring with n-gram tries in Elias-Fano form."""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.eliasfano import EliasFano
from tidemark.llm.shared import chunks, read, ready, spent, stored, utf8
from tidemark.llm.simhash import NOT_BLANK
from tidemark.llm.tokens import LOWER, mixed, prefix, runs, span_hashes
from tidemark.llm.toxicity import remainder

#: Hash of the token that ends a text.
END = np.uint64(0xE2D0F7E8B5A1C94D)
#: Order of the model.
ORDER = 3
#: Taken from each count; steps of a factor of 2 in which probabilities are held, and their number.
DISCOUNT, STEP, STEPS = 0.75, 1024, 1 << 15
#: Bytes of text in a segment, but for one long text.
SEGMENT_BYTES = 12 << 20
#: Training tokens after a context beyond which its children are dealt out to several parts, and contexts so dealt at most.
HOT, MOST_HOT = 1 << 18, 500_000
SEGMENT = "segment string, doc_id array<long>, held_out array<boolean>, n array<int>, tokens binary, places binary, keys binary"


def _z(x: np.ndarray) -> bytes:
    """Compressed, the bytes of one weight together."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unz(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(kind)


def _steps(x: np.ndarray) -> bytes:
    """Sorted numbers, compressed by their differences."""
    return _z(np.diff(x, prepend=x.dtype.type(0)))


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(_unz(data, np.uint64), dtype=np.uint64)


def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) to segments: each token as its rank among the segment's distinct tokens, frequent ones first.

    keys: hashes of the distinct tokens in order, which only the first question needs. places: of each rank among the keys.
    """

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        tokens, sizes = [], []
        for batch in held:
            raw, offsets = utf8(batch.column(2))
            for lo, hi in chunks(offsets):
                at = offsets[lo : hi + 1] - offsets[lo]
                low = LOWER[raw[offsets[lo] : offsets[hi]]]
                starts, ends = runs(NOT_BLANK[low], at)
                h = span_hashes(prefix(low), starts, ends)
                n = np.bincount(np.searchsorted(at, starts, "right") - 1, minlength=hi - lo) + 1
                tokens.append(np.insert(h, np.cumsum(n - 1), END))
                sizes.append(n)
        keys, at, counts = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(keys), np.int32)
        rank[order] = np.arange(len(keys), dtype=np.int32)
        ids, out = ([x for b in held for x in b.column(k).to_pylist()] for k in (0, 1))
        row = [[uuid.uuid4().hex], [ids], [out], [np.concatenate(sizes).astype(np.int32)], [_z(rank[at])], [_z(order.astype(np.int32))], [_steps(keys)]]
        kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["segment", "doc_id", "held_out", "n", "tokens", "places", "keys"])

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and size + batch.nbytes > SEGMENT_BYTES:
            yield cut(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield cut(held)


def quantised(p: np.ndarray) -> np.ndarray:
    """Steps below 1, rounded up, so that probabilities are rounded down; STEPS stands for 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(-np.log2(np.clip(p, 0, 1)) * STEP), STEPS).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    return np.where(code >= STEPS, 0.0, 2.0 ** (-code.astype(np.float64) / STEP))


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the number of each key among them, and how often each occurs."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return ordered[first], number, np.diff(np.append(first, len(key)))


class Level:
    """The n-grams of one order in a segment whose contexts other segments have, too: what is asked of which part.

    at: places of last tokens. context, child: of each place, as numbers among the segment's own contexts and tokens. Contexts
    and tokens have ids that all segments share. A context with several slots has its children dealt out to as many units.
    """

    def __init__(self, at: np.ndarray, context: np.ndarray, child: np.ndarray, context_id: np.ndarray, slots: np.ndarray, token_id: np.ndarray, parts: int):
        self.at = at
        used, context, _ = _sorted(context)
        context_id, slots = context_id[used], slots[used].astype(np.int64)
        owner = np.repeat(np.arange(len(used)), slots)
        base = np.cumsum(slots) - slots
        slot = np.arange(len(owner)) - base[owner]
        split = slots[owner] > 1
        unit = np.where(split, mixed(mixed(context_id[owner]) + slot.astype(np.uint64)), context_id[owner])
        part = (mixed(unit) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((unit, part))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        mine = base[context]
        if split.any():
            mine = mine + (mixed(token_id[child]) % slots[context].astype(np.uint64)).astype(np.int64)
        by_id = np.argsort(token_id)
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        key, number, _ = _sorted(rank[mine] * len(token_id) + place[child])
        self.number = number.astype(np.int32)
        unit_of, child_of = key // len(token_id), key % len(token_id)
        #: Of each n-gram its unit's number, and each token's id; of each unit that is asked its id, part, context's id, and whether it is one of several.
        seen, self.unit, self.children = _sorted(unit_of)
        self.child = token_id[by_id[child_of]]
        seen = order[seen]
        self.ids, self.part, self.context, self.split = unit[seen], part[seen], context_id[owner[seen]], split[seen]

    def asked(self, segment: str, order: int, train: np.ndarray) -> pa.RecordBatch:
        """A row for each part: units, how many children each has, children, their training counts; and of split units which, and their contexts."""
        count = np.bincount(self.number[train[self.at]], minlength=len(self.child)).astype(np.uint32)
        names, first = np.unique(self.part, return_index=True)
        units = [*first.tolist(), len(self.part)]
        grams = np.concatenate([[0], np.cumsum(self.children)])[units]
        rows = []
        for k in range(len(names)):
            u, g = slice(units[k], units[k + 1]), slice(grams[k], grams[k + 1])
            split = np.flatnonzero(self.split[u])
            rows.append([_steps(self.ids[u]), _z(self.children[u].astype(np.uint32)), _z(self.child[g]), _z(count[g]), _z(split), _z(self.context[u][split])])
        return pa.record_batch({"part": pa.array(names, pa.int32()), "segment": pa.array([segment] * len(names), pa.string()), "level": pa.array([order] * len(names), pa.int32()), "asked": pa.array(rows, pa.list_(pa.binary()))})

    def answers(self, rows: list, hot: dict[str, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place the n-gram's own share and its context's rest, and of each n-gram what it is as a context."""
        rows = sorted(rows, key=lambda r: r["part"])
        share, rest, more = (np.concatenate([*(_unz(r["answer"][k], np.uint16) for r in rows), np.zeros(0, np.uint16)]) for k in range(3))
        share, rest = probability(share), probability(rest)
        if hot is not None and self.split.any():
            at = np.searchsorted(hot["unit"], self.ids).clip(max=max(len(hot["unit"]) - 1, 0))
            split = self.split & (hot["unit"][at] == self.ids)
            factor = np.where(split, hot["factor"][at], 1.0)
            rest = np.where(split, hot["rest"][at], rest)
            share = share * factor[self.unit]
        return share[self.number], rest[self.unit[self.number]], more


def alone(at: np.ndarray, context: np.ndarray, child: np.ndarray, train: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for contexts that no other segment has: shares and rests of places, numbers of their n-grams, and the counts of those."""
    key, number, _ = _sorted(context * tokens + child)
    of = key // tokens
    count = np.bincount(number[train[at]], minlength=len(key))
    _, unit, _ = _sorted(of)
    total = np.maximum(np.bincount(unit, count), 1)
    share = probability(quantised(np.where(count > 0, (count - DISCOUNT) / total[unit], 0.0)))
    rest = probability(quantised(DISCOUNT * np.bincount(unit, count > 0) / total))
    return share[number], rest[unit[number]], number, count


class Segment:
    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name: batch.column(name)[i]
        self.name, self.ids = get("segment").as_py(), get("doc_id").values
        self.held, self.n = get("held_out").values.to_numpy(zero_copy_only=False), get("n").values.to_numpy()
        self.tokens, self.order = (_unz(get(c).as_py(), np.int32) for c in ("tokens", "places"))
        self.keys = _unsteps(get("keys").as_py()) if "keys" in batch.schema.names else None
        self.train = ~np.repeat(self.held, self.n)
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat((np.cumsum(self.n) - self.n).astype(np.int32), self.n)

    def ask_words(self, parts: int) -> pa.RecordBatch:
        """A row for each part: tokens' hashes and training counts. Parts are ranges of hashes, so answers come in the order of the hashes."""
        part = ((self.keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        count = np.empty(len(self.keys), np.uint32)
        count[self.order] = np.bincount(self.tokens[self.train], minlength=len(self.keys))
        names, first = np.unique(part, return_index=True)
        rows = [[_steps(self.keys[a:b]), _z(count[a:b])] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(part)], strict=True)]
        return pa.record_batch({"part": pa.array(names, pa.int32()), "segment": pa.array([self.name] * len(names), pa.string()), "level": pa.array([1] * len(names), pa.int32()), "asked": pa.array(rows, pa.list_(pa.binary()))})

    def learn_words(self, rows: list) -> None:
        """Of each distinct token its training count, its id, and whether other segments have it."""
        rows = sorted((r for r in rows if r["level"] == 1), key=lambda r: r["part"])
        both = np.concatenate([_unz(r["answer"][0], np.uint64) for r in rows])[self.order]
        self.count = np.concatenate([_unz(r["answer"][1], np.int64) for r in rows])[self.order]
        self.id, self.shared = both >> np.uint64(1), (both & np.uint64(1)).astype(bool)

    def level_two(self, parts: int, hot: int) -> Level:
        self.first = np.flatnonzero(self.place >= 1)
        before = self.tokens[self.first - 1].astype(np.int64)
        known = self.count[before] > 0
        ask = known & self.shared[before]
        self.only = self.first[known & ~self.shared[before]]
        at = self.first[ask]
        return Level(at, before[ask], self.tokens[at].astype(np.int64), self.id, np.maximum(-(-self.count // hot), 1), self.id, parts)

    def level_three(self, two: Level, rows: list, parts: int, span: int, hot_two) -> tuple[tuple, tuple, Level]:
        """What level two answers of its places, what is alone there, and level three."""
        share, rest, more = two.answers([r for r in rows if r["level"] == 2], hot_two)
        words = len(self.order)
        mine, theirs, number, count = alone(self.only, self.tokens[self.only - 1].astype(np.int64), self.tokens[self.only].astype(np.int64), self.train, words)
        # Pairs as contexts: those asked, then those alone here; 0 slots where no training text has the pair.
        pair = np.full(len(self.tokens), -1, np.int32)
        pair[two.at], pair[self.only] = two.number, len(two.child) + number
        slots = np.concatenate([more >> np.uint16(1), (count > 0).astype(np.uint16)]).astype(np.int64)
        shared = np.concatenate([more & np.uint16(1), np.zeros(len(count), np.uint16)]) > 0
        ids = np.zeros(len(slots), np.uint64)
        for at in (two.at, self.only):
            ids[pair[at]] = self.id[self.tokens[at - 1]] * np.uint64(span) + self.id[self.tokens[at]]
        at = np.flatnonzero(self.place >= 2)
        context = pair[at - 1]
        at, context = at[context >= 0], context[context >= 0]
        known = slots[context] > 0
        at, context = at[known], context[known]
        ask = shared[context]
        three = Level(at[ask], context[ask], self.tokens[at[ask]].astype(np.int64), ids, np.maximum(slots, 1), self.id, parts)
        lone = at[~ask]
        return (share, rest), (self.only, mine, theirs), three, (lone, *alone(lone, context[~ask], self.tokens[lone].astype(np.int64), self.train, words)[:2])


def answer_words(part: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Of each token asked for its id (frequent tokens have small ones) and whether several segments ask, and its training count;
    of the part, in a row without segment, tokens, distinct tokens, and the largest id."""
    asked = [(_unsteps(x[0]), _unz(x[1], np.uint32)) for x in part["asked"]]
    keys, at, many = _sorted(np.concatenate([k for k, _ in asked]))
    total = np.bincount(at, np.concatenate([c for _, c in asked]), minlength=len(keys)).astype(np.int64)
    name = int(part["part"].iloc[0])
    rank = np.empty(len(keys), np.uint64)
    rank[np.argsort(-total, kind="stable")] = np.arange(len(keys), dtype=np.uint64)
    ids = rank * np.uint64(parts) + np.uint64(name)
    both = ids << np.uint64(1) | (many > 1).astype(np.uint64)
    bounds = np.cumsum([0, *(len(k) for k, _ in asked)])
    rows = [[_z(both[at[a:b]]), _z(total[at[a:b]])] for a, b in zip(bounds, bounds[1:], strict=False)]
    size = {"part": name, "segment": None, "level": 1, "answer": [], "tokens": int(total.sum()), "types": int((total > 0).sum()), "top": int(ids.max())}
    return pd.concat([pd.DataFrame({"part": part["part"], "segment": part["segment"], "level": 1, "answer": rows, "tokens": 0, "types": 0, "top": 0}), pd.DataFrame([size])], ignore_index=True)


def _mapped(x: np.ndarray, path: Path | None) -> np.ndarray:
    """The array in memory-mapped pages: of a file, or of none."""
    if path is not None:
        np.save(path, x)
        return np.load(path, mmap_mode="r")
    pages = np.frombuffer(mmap.mmap(-1, max(x.nbytes, 1)), np.uint8)[: x.nbytes].view(x.dtype)
    pages[:] = x
    return pages


class Trie:
    """A level of contexts and one of their children: sorted ids of contexts, monotone pointers to the first child of each,
    ids of children that start afresh with each context (made monotone by the context's number), quantised probabilities.

    Takes distinct (context, child) in order with training counts. With a folder its arrays are files that are mapped.
    """

    def __init__(self, context: np.ndarray, child: np.ndarray, count: np.ndarray, folder: Path | None = None):
        self.contexts, of, _ = _sorted(context)
        total, types = np.bincount(of, count, len(self.contexts)), np.bincount(of, count > 0, len(self.contexts))
        own = count > 0
        self.child_bits = max(1, int(child.max(initial=0)).bit_length())
        if self.child_bits + len(self.contexts).bit_length() > 64:
            raise ValueError("a part holds more contexts than its children's ids leave room for")
        share = (count[own] - DISCOUNT) / np.maximum(total, 1)[of[own]]
        pointers = np.searchsorted(of[own], np.arange(len(self.contexts) + 1)).astype(np.uint64)
        key = of[own].astype(np.uint64) << np.uint64(self.child_bits) | child[own]
        self.levels = {}
        for name, values, top in (("contexts", self.contexts, 64), ("pointers", pointers, max(1, int(own.sum()).bit_length())), ("children", key, self.child_bits + len(self.contexts).bit_length())):
            self.levels[name] = level = EliasFano(values, top)
            for array in ("low", "high", "zeros", "ones"):
                setattr(level, array, _mapped(getattr(level, array), folder and folder / f"{name}-{array}.npy"))
        self.share, self.rest = (_mapped(quantised(x), folder and folder / f"{name}.npy") for name, x in (("share", share), ("rest", np.where(total > 0, DISCOUNT * types / np.maximum(total, 1), 1.0))))

    def look_up(self, context: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each n-gram's own share and of its context's rest, for contexts that are there, by search from each context's pointer."""
        at = self.levels["contexts"].successor(context)
        lo, hi = (self.levels["pointers"].get(x).astype(np.int64) for x in (at, at + 1))
        key = at.astype(np.uint64) << np.uint64(self.child_bits) | child
        place = self.levels["children"].successor(key, lo, hi)
        there = place < hi
        there[there] = self.levels["children"].get(place[there]) == key[there]
        share = np.full(len(context), STEPS, np.uint16)
        share[there] = self.share[place[there]]
        return share, self.rest[at]

    def look_up_all(self, of: np.ndarray, child: np.ndarray) -> np.ndarray:
        """Codes of the shares of n-grams in the order of contexts (given by number) and children: one pass over the children,
        each of which is the successor within its context of all n-grams up to it."""
        key = of.astype(np.uint64) << np.uint64(self.child_bits) | child
        held = self.levels["children"].values()
        place = np.searchsorted(held, key)
        there = place < len(held)
        there[there] = held[place[there]] == key[there]
        share = np.full(len(key), STEPS, np.uint16)
        share[there] = self.share[place[there]]
        return share


def answer_ngrams(part: pd.DataFrame, hot: int) -> pd.DataFrame:
    """Builds the trie of a part's units from all segments' counts, and looks up each n-gram asked for.

    Answers have the codes of shares and rests and, of each n-gram, what it is as a context: its slots, doubled, and one more
    if several segments have it. Totals and kinds of children of split units are in rows without segment.
    """
    asked = [(_unsteps(x[0]), _unz(x[1], np.uint32).astype(np.int64), *(_unz(x[k], t) for k, t in ((2, np.uint64), (3, np.uint32), (4, np.int64), (5, np.uint64)))) for x in part["asked"]]
    units, unit, _ = _sorted(np.concatenate([a[0] for a in asked]))
    child = np.concatenate([a[2] for a in asked])
    bits = np.uint64(max(1, int(child.max(initial=0)).bit_length()))
    key = np.repeat(unit, np.concatenate([a[1] for a in asked])).astype(np.uint64) << bits | child
    keys, number, many = _sorted(key)
    count = np.bincount(number, np.concatenate([a[3] for a in asked]), len(keys)).astype(np.int64)
    of, child = (keys >> bits).astype(np.int64), keys & ((np.uint64(1) << bits) - np.uint64(1))
    trie = Trie(units[of], child, count)
    share, rest = trie.look_up_all(of, child), trie.rest
    more = (np.minimum(-(-count // hot), STEPS - 1) << 1 | (many > 1)).astype(np.uint16)
    grams, mine = (np.cumsum([0, *(len(a[k]) for a in asked)]) for k in (2, 0))
    last = int(part["level"].iloc[0]) == ORDER
    rows = []
    for k in range(len(asked)):
        n = number[grams[k] : grams[k + 1]]
        rows.append([_z(share[n]), _z(rest[unit[mine[k] : mine[k + 1]]]), _z(more[n[:0]] if last else more[n])])
    out = pd.DataFrame({"part": part["part"], "segment": part["segment"], "level": part["level"], "answer": rows})
    split = [np.stack([unit[mine[k] : mine[k + 1]][a[4]].astype(np.uint64), a[5]]) for k, a in enumerate(asked) if len(a[4])]
    if not split:
        return out
    at, context = np.unique(np.concatenate(split, axis=1), axis=1)
    at = at.astype(np.int64)
    total, types = (np.bincount(of, x, len(units)).astype(np.int64)[at] for x in (count, count > 0))
    row = {"part": part["part"].iloc[0], "segment": None, "level": part["level"].iloc[0], "answer": [_z(x) for x in (units[at], context, total, types)]}
    return pd.concat([out, pd.DataFrame([row])], ignore_index=True)


def _hot(answers: DataFrame) -> dict[str, np.ndarray] | None:
    """Of the units of split contexts: the factor of their shares, and their contexts' rests. There are 2 * MOST_HOT at most."""
    rows = answers.where("segment is null").select("answer").collect()
    if not rows:
        return None
    unit, context, total, types = (np.concatenate([_unz(bytes(r.answer[k]), t) for r in rows]) for k, t in enumerate((np.uint64, np.uint64, np.int64, np.int64)))
    _, of, _ = _sorted(context)
    whole, kinds = np.maximum(np.bincount(of, total), 1), np.bincount(of, types)
    order = np.argsort(unit)
    return {"unit": unit[order], "factor": (total / whole[of])[order], "rest": probability(quantised(DISCOUNT * kinds / whole))[of][order]}


def score_texts(docs: DataFrame, held_out: Column, hot: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs.

    The model learns from every n-gram of all rows that held_out does not mark: interpolated absolute discounting of order
    ORDER over an add-one unigram model. Documents become segments of token numbers. A segment sends its distinct tokens,
    then its distinct n-grams with their training counts, to the part of their context; there a trie of the part's
    contexts is built and asked. So no task holds the vocabulary or the model, and a frequent n-gram has one row for
    each segment. Tokens get ids that all segments share, and n-grams are told apart by them. What follows a context that one segment alone
    has is counted there and not sent: it is all there is. The children of a context that more than hot training tokens
    follow are dealt out to several parts.

    Tokens are the words of the whole text, A-Z lower-cased, and one end. Null and blank texts have the end alone.
    Repeated rows are learnt from and scored each. With no training rows, tokens are unknown and score log10(1). An empty
    table gives no rows; columns of docs other than doc_id, text and those of held_out are not read.
    """
    spark = docs.sparkSession
    ready(spark)
    cut = stored(docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text").mapInArrow(segments, SEGMENT), "segments")
    parts = max(12, cut.count())
    ask = "part int, segment string, level int, asked array<binary>"
    answer = "part int, segment string, level int, answer array<binary>"

    def over(of):
        """For mapInArrow: what of(segment, its answers) returns, for each segment."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield of(Segment(batch, i), batch.column("answers")[i].as_py() or [] if "answers" in batch.schema.names else [])

        return run

    def answered(answers: DataFrame) -> DataFrame:
        mine = answers.where("segment is not null").groupBy("segment").agg(F.collect_list(F.struct("part", "level", "answer")).alias("answers"))
        return cut.drop("keys").join(mine.hint("merge"), "segment")

    counts = stored(cut.mapInArrow(over(lambda s, _: s.ask_words(parts)), ask).groupBy("part").applyInPandas(lambda p: answer_words(p, parts), f"{answer}, tokens long, types long, top long"), "counts")
    total, types, top = (int(x or 0) for x in counts.agg(F.sum("tokens"), F.sum("types"), F.max("top")).first())
    hot, span = max(hot or HOT, total // MOST_HOT), top + 1
    one = counts.select("part", "segment", "level", "answer")

    def ask_two(s: Segment, rows: list) -> pa.RecordBatch:
        s.learn_words(rows)
        return s.level_two(parts, hot).asked(s.name, 2, s.train)

    two = stored(answered(one).mapInArrow(over(ask_two), ask).groupBy("part").applyInPandas(lambda p: answer_ngrams(p, hot), answer), "pairs")
    spent()
    hot_two = _hot(two)

    def ask_three(s: Segment, rows: list) -> pa.RecordBatch:
        s.learn_words(rows)
        return s.level_three(s.level_two(parts, hot), rows, parts, span, hot_two)[2].asked(s.name, 3, s.train)

    three = stored(answered(one.union(two)).mapInArrow(over(ask_three), ask).groupBy("part").applyInPandas(lambda p: answer_ngrams(p, hot), answer), "triples")
    spent()
    hot_three = _hot(three)

    def score(s: Segment, rows: list) -> pa.RecordBatch:
        s.learn_words(rows)
        two = s.level_two(parts, hot)
        found, lone, three, last = s.level_three(two, rows, parts, span, hot_two)
        base = (s.count[s.tokens] + 1) / (total + types + 1)
        p = base.copy()
        share, rest, _ = three.answers([r for r in rows if r["level"] == 3], hot_three)
        for at, own, left in ((two.at, *found), lone, (three.at, share, rest), last):
            p[at] = own + left * p[at]
        of_doc = np.repeat(np.arange(len(s.n)), s.n)
        sums = [np.bincount(of_doc, x, minlength=len(s.n)) for x in (s.count[s.tokens] > 0, np.log10(base), np.log10(p))]
        return pa.record_batch({"doc_id": s.ids, "held_out": pa.array(s.held, pa.bool_()), "n_tokens": pa.array(s.n, pa.int64()), "n_known": sums[0].astype(np.int64), "train_tokens": np.full(len(s.n), total, np.int64), "base_score": sums[1], "score": sums[2]})

    return answered(one.union(two).union(three)).mapInArrow(over(score), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read(spark, sf_dir, "documents"), remainder(7) == 2)
