"""SimHash near-duplicates, linked by anchor-point covering with the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import chunks, components, forest, fresh, read, ready, sent, spent, stored, utf8
from tidemark.llm.tokens import LOWER, mixed, prefix, runs, span_hashes

#: Bits of the three parts of a fingerprint; each part, padded with zero bits, is a word of the Golay code's space.
PARTS = ((0, 22), (22, 21), (43, 21))
#: Of the binary Golay code: length, generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1, covering radius.
LENGTH, GENERATOR, RADIUS = 23, 0b110001110101, 3
#: Homes of an anchor beyond which they are split over tasks.
HOT_HOMES = 20_000
#: All bytes but space and those from tab to carriage return.
NOT_BLANK = np.ones(256, np.uint8)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = 0
#: Pairs compared at a time.
PAIRS = 1 << 21


def fingerprints(words_per_shingle: int):
    """For mapInArrow over (doc_id, text)."""
    digest = xxhash.xxh64_intdigest

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(1))
            out = np.zeros(len(at) - 1, np.uint64)
            data = raw.tobytes()
            for i in range(len(out)):
                words = data[at[i] : at[i + 1]].lower().split()
                if words:
                    ends = np.cumsum([len(w) + 1 for w in words]) - 1
                    begins = [0, *(ends[:-1] + 1).tolist()]
                    text, k = b" ".join(words), min(words_per_shingle, len(words))
                    hashes = np.array([digest(text[a:b], 42) for a, b in zip(begins, ends[k - 1 :].tolist(), strict=False)], np.uint64)
                    ones = np.zeros(64, np.int64)
                    for lo in range(0, len(hashes), 4096):
                        ones += np.unpackbits(hashes[lo : lo + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                    out[i] = np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(out.view(np.int64))})

    return of


@cache
def covering() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: its first place in the list, places, and error patterns by weight up to RADIUS + 1.

    A word XOR a pattern of its syndrome is an anchor. The code is perfect: one pattern of each syndrome has weight
    RADIUS or less and leads to the word's own anchor; the others lead to the anchors at distance RADIUS + 1.
    """
    patterns = [sum(1 << b for b in bits) for w in range(RADIUS + 2) for bits in combinations(range(LENGTH), w)]
    found: list[list[int]] = [[] for _ in range(2048)]
    for p in patterns:
        found[int(_syndrome(np.array([p], np.uint32))[0])].append(p)
    counts = np.array([len(x) for x in found])
    return np.cumsum(counts) - counts, counts, np.array([p for x in found for p in x], np.uint32)


def _syndrome(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.uint32)
    for bit in range(LENGTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ np.uint32(GENERATOR << (bit - 11)), left)
    return left


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for each row's places starts ... starts + counts - 1."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, rep) to (anchor, home, fp, rep): each fingerprint at every anchor that covers it, for each pair of parts.

    Two fingerprints with 3 differing bits at most have two parts in which 1 bit at most differs. An anchor is a pair
    of codewords of two parts. The home of a fingerprint is the anchor within RADIUS in both parts; the other's home is
    within RADIUS + 1 of it in both, so it is replicated there.
    """
    first, many, patterns = covering()
    for batch in batches:
        fps, reps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for lo in range(0, len(fps), 20_000):
            fp, rep = fps[lo : lo + 20_000], reps[lo : lo + 20_000]
            parts = [(fp.view(np.uint64) >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.uint32) for s, n in PARTS]
            syndromes = [_syndrome(p) for p in parts]
            for pair, (i, j) in enumerate(combinations(range(3), 2)):
                row, a = _spread(first[syndromes[i]], many[syndromes[i]])
                inner, b = _spread(first[syndromes[j]][row], many[syndromes[j]][row])
                row, a = row[inner], a[inner]
                anchor = [(parts[x][row] ^ patterns[y]) >> np.uint32(11) for x, y in ((i, a), (j, b))]  # the code is systematic in its upper 12 bits
                key = (pair << 24 | anchor[0].astype(np.int64) << 12 | anchor[1]).astype(np.int64)
                home = (a == first[syndromes[i]][row]) & (b == first[syndromes[j]][row])
                yield pa.record_batch({"anchor": key, "home": home, "fp": fp[row], "rep": rep[row]})


def meetings(batches: Iterable[pa.RecordBatch], enough: int = 1 << 18) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Of rows (anchor, salt, home, ...) in the order of anchor, salt and home first: columns of some rows, and the pairs
    (row, home) of them that share anchor and salt, each pair of rows once. Only the homes of the last anchor are carried on."""
    kept: list[np.ndarray] | None = None

    def met(columns: list[np.ndarray], old: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        key = columns[0] + (columns[1].astype(np.int64) << 32)  # anchors of one anchor's rows are next to each other: no two meet by chance
        begin = np.flatnonzero(np.concatenate([[True], (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])) if len(key) else np.zeros(0, np.int64)
        group = np.cumsum(np.bincount(begin, minlength=len(key))) - 1
        homes = np.flatnonzero(columns[2])
        lo = np.searchsorted(group[homes], group, "left")
        n = np.minimum(np.searchsorted(group[homes], group, "right"), np.searchsorted(homes, np.arange(len(key)), "left")) - lo
        n = np.maximum(n, 0)
        n[:old] = 0
        ends = np.cumsum(n)
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            row, place = _spread(lo[at:to], n[at:to])
            if len(row):
                yield columns, row + at, homes[place]
            at = to

    waiting: list[list[np.ndarray]] = []

    def flush() -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        nonlocal kept, waiting
        old = len(kept[0]) if kept else 0
        columns = [np.concatenate(x) for x in zip(*([kept] if kept else []), *waiting, strict=True)]
        waiting = []
        yield from met(columns, old)
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & columns[2]
        kept = [c[last] for c in columns]

    for batch in batches:
        if batch.num_rows:
            waiting.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(x[0]) for x in waiting) >= enough:
                yield from flush()
    if waiting:
        yield from flush()


def compare(most_bits: int):
    """For mapInArrow over (anchor, salt, home, fp, rep) as meetings() takes them: stars of linked reps."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for (_, _, _, fp, rep), row, other in meetings(batches):
            near = np.bitwise_count((fp[row] ^ fp[other]).view(np.uint64)) <= most_bits  # of signed numbers it counts the absolute value's
            near &= rep[row] != rep[other]
            u, v = forest(np.concatenate([u, rep[row[near]]]), np.concatenate([v, rep[other[near]]]))
            if len(u) > 1 << 20:
                yield pa.record_batch({"u": u, "v": v})
                u, v = u[:0], v[:0]
        yield pa.record_batch({"u": u, "v": v})

    return of


def _together(spread: DataFrame) -> DataFrame:
    """Rows of an anchor and salt in one task, its homes first."""
    n = int(spread.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("home").desc())


def _split(spread: DataFrame, columns: list[str]) -> DataFrame:
    """spread with salt: an anchor with over HOT_HOMES homes is split, each of its rows meets each block of homes in a task
    of its own."""
    hot = stored(spread.where("home").groupBy("anchor").count().where(F.col("count") > HOT_HOMES), "hot-anchors")
    if not hot.take(1):
        return spread.select("anchor", F.lit(0).alias("salt"), "home", *columns)
    blocks = F.coalesce(F.ceil(F.col("count") / HOT_HOMES), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64(*columns), blocks).cast("int")
    every = spread.join(hot, "anchor", "left").select("anchor", "home", *columns, own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"))
    return every.select("anchor", "salt", (F.col("home") & (F.col("salt") == F.col("own"))).alias("home"), *columns)


def link(nodes: DataFrame, most_bits: int = 3) -> DataFrame:
    """Links (u, v) between the reps of nodes (fp, rep), distinct fingerprints: stars of each component of an anchor."""
    if not 0 <= most_bits <= 3:
        raise ValueError("the covering holds for 3 differing bits at most")
    spread = nodes.select("fp", "rep").mapInArrow(replicate, "anchor long, home boolean, fp long, rep long")
    return _together(_split(spread, ["fp", "rep"])).mapInArrow(compare(most_bits), "u long, v long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, most_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    fp has a bit set if it is set in over half the XXH64 values (seed 42) of the word shingles of the lower-cased whole
    text. Documents whose fingerprints differ in most_bits bits or fewer are linked; component_id is the smallest doc_id
    that links reach. Equal fingerprints are one node, so groups of copies cost no more than one document.

    Null, empty and blank texts have fingerprint 0 and link like any other; a text of fewer words is one shingle.
    Repeated rows stay. A row whose fingerprint only rows without doc_id share has component_id null. An empty table
    gives no rows; columns of docs other than doc_id and text are not read.
    """
    ready(docs.sparkSession)
    prints = stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(fingerprints(words_per_shingle), "doc_id long, fp long"), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "nodes")
    roots = components(link(nodes, most_bits))
    of = stored(nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "classes")
    return prints.join(of, "fp", "left").select("doc_id", "fp", "component_id")


#: Seeds of the two parts of a 128-bit fingerprint of shingles; size below which such fingerprints are not asked.
SEEDS, SMALL = (11, 12), 64
#: Keys of a set, and minima in each: two sets of similarity 0.8 share none once in (1 - 0.8**5)**32, that is 3 in a million.
KEYS, MINIMA = 32, 5
_ODD = mixed(np.arange(1, KEYS * MINIMA + 1, dtype=np.uint64)) | np.uint64(1)


def most_apart(similarity: float, bits: int) -> int:
    """Differing bits of SimHash fingerprints that sets of this Jaccard similarity have, and six standard deviations more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + 6 * (bits * share * (1 - share)) ** 0.5)


def _least(share: float, n):
    """The least whole number that is no less than this share of n."""
    return np.ceil(np.asarray(n) * share - 1e-9).astype(np.int64)


def _majority(hashes: np.ndarray, seeds: tuple[int, ...]) -> np.ndarray:
    """A 64-bit fingerprint of the hashes for each seed."""
    ones = np.zeros((len(seeds), 64), np.int64)
    for lo in range(0, len(hashes), 4096):
        for k, seed in enumerate(seeds):
            h = mixed(hashes[lo : lo + 4096] + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view(np.int64)[:, 0]


def _keys(hashes: np.ndarray) -> np.ndarray:
    """KEYS keys of a set of hashes: each of the least of MINIMA orders of it."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 256):
        np.minimum(least, (hashes[lo : lo + 256, None] * _ODD).min(axis=0), out=least)
    groups = mixed(least + np.arange(len(least), dtype=np.uint64)).reshape(KEYS, MINIMA)
    return mixed((groups * _ODD[:MINIMA]).sum(axis=1, dtype=np.uint64))


def sets(words_per_shingle: int):
    """For mapInArrow over (doc_id, text_hash, text): of each set of distinct shingles a hash, the size, a fingerprint of 128
    bits, its keys and 32 bits of all hashes."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = utf8(batch.column(2))
            out, n = np.zeros((len(at) - 1, 3), np.int64), np.zeros(len(at) - 1, np.int64)
            keys, members = [b""] * len(n), [b""] * len(n)
            for lo, hi in chunks(at):
                low = LOWER[raw[at[lo] : at[hi]]]
                starts, ends = runs(NOT_BLANK[low], at[lo : hi + 1] - at[lo])
                hashes = span_hashes(prefix(low), starts, ends)
                bounds = np.searchsorted(starts, at[lo : hi + 1] - at[lo])
                for i in range(lo, hi):
                    words = hashes[bounds[i - lo] : bounds[i - lo + 1]]
                    if len(words):
                        k = min(words_per_shingle, len(words))
                        shingles = words[: len(words) - k + 1].copy()
                        for m in range(1, k):
                            shingles = mixed(shingles * np.uint64(31) + words[m : len(words) - k + 1 + m])
                        shingles = np.unique(shingles)
                        n[i] = len(shingles)
                        whole = mixed(np.array([mixed(shingles).sum(dtype=np.uint64)], np.uint64) + np.uint64(n[i]))
                        out[i] = np.concatenate([whole.view(np.int64), _majority(shingles, SEEDS)])
                        keys[i] = _keys(shingles).tobytes()
                        members[i] = (shingles >> np.uint64(32)).astype(np.uint32).tobytes()
            yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(out[:, k]) for k in range(3)), pa.array(n), pa.array(keys, pa.binary()), pa.array(members, pa.binary())], names=["doc_id", "text_hash", "node", "f0", "f1", "n", "keys", "members"])

    return of


def replicate_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, rep, root, n, f0, f1, keys) to (anchor, home, node, rep, root, n, f0, f1): each set at each of its keys."""
    for batch in batches:
        found = [np.frombuffer(x, np.int64) for x in batch.column(6).to_pylist()]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        anchor = np.concatenate([*found, np.zeros(0, np.int64)])
        columns = [batch.column(k).to_numpy(zero_copy_only=False)[row] for k in range(6)]
        yield pa.record_batch([pa.array(x) for x in (anchor, np.ones(len(anchor), bool), *columns)], names=["anchor", "home", "node", "rep", "root", "n", "f0", "f1"])


def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (anchor, node) in the order of anchor: pairs of nodes next to each other, or next but one."""
    anchor, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        anchor, node = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in ((0, anchor), (1, node)))
        pairs = [np.stack([node[:-lag], node[lag:]])[:, anchor[:-lag] == anchor[lag:]] for lag in (1, 2) if len(node) > lag]
        if pairs:
            pairs = np.unique(np.sort(np.concatenate(pairs, axis=1), axis=0), axis=1)
            yield pa.record_batch({"a": pairs[0], "b": pairs[1]})
        anchor, node = anchor[-2:], node[-2:]


def _shared(members: np.ndarray, row: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many hashes the sets of each pair have in common."""
    out = np.zeros(len(row), np.int64)
    sizes = np.array([len(x) // 4 for x in members], np.int64)
    many = np.cumsum(sizes[row])
    at = 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(many, (many[at - 1] if at else 0) + PAIRS, "right")))
        homes, home = np.unique(other[at:to], return_inverse=True)
        held = np.concatenate([np.frombuffer(members[h], np.uint32) for h in homes]).astype(np.uint64) | np.repeat(np.arange(len(homes), dtype=np.uint64), sizes[homes]) << np.uint64(32)
        pair = np.repeat(np.arange(to - at), sizes[row[at:to]])
        asked = np.concatenate([np.frombuffer(members[r], np.uint32) for r in row[at:to]]).astype(np.uint64) | home.astype(np.uint64)[pair] << np.uint64(32)
        place = np.searchsorted(held, asked).clip(max=len(held) - 1)
        out[at:to] = np.bincount(pair[held[place] == asked], minlength=to - at)
        at = to
    return out


def compare_sets(similarity: float):
    """For mapInArrow over (anchor, salt, home, rep, root, n, f0, f1, members) as meetings() takes them: stars of the nodes that
    are as similar, of those with different roots. Sizes and fingerprints spare most counts."""
    most = most_apart(similarity, 128)

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, _, rep, root, n, f0, f1, members), row, other in meetings(batches, 1 << 13):
            near = (root[row] != root[other]) & (np.minimum(n[row], n[other]) >= _least(similarity, np.maximum(n[row], n[other])))
            row, other = row[near], other[near]
            near = np.bitwise_count((f0[row] ^ f0[other]).view(np.uint64)).astype(np.int64) + np.bitwise_count((f1[row] ^ f1[other]).view(np.uint64)) <= most
            near |= np.minimum(n[row], n[other]) < SMALL  # ties make the bits of small sets differ more
            row, other = row[near], other[near]
            if len(row):
                near = _shared(members, row, other) >= _least(similarity / (1 + similarity), n[row] + n[other])
                u, v = forest(rep[row[near]], rep[other[near]])
                yield pa.record_batch({"u": u, "v": v})

    return of


def verify_sets(similarity: float):
    """For mapInArrow over (u, v, members of both): the links (u, v) that are as similar."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint32) for k in (2, 3))
                both = np.sort(np.concatenate([x, y]))
                good[i] = np.count_nonzero(both[1:] == both[:-1]) >= _least(similarity / (1 + similarity), len(both))
            yield batch.select([0, 1]).filter(pa.array(good))

    return of


def similar(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component_id) for each row of docs: near copies by the similarity of their sets of word shingles.

    Two texts are linked if the Jaccard similarity of their distinct shingles is as high; component_id is the smallest doc_id
    that links reach. Each link is counted, with 32 bits of each shingle's hash. Candidates are those that the anchors of
    link() bring together by their SimHash, which reaches up to 3 of 64 bits; sets this similar differ in about 10, so
    sets also meet at KEYS keys, each of MINIMA least hashes: at 0.8 all but 3 pairs in a million share one, and
    more alike ones sooner, whatever the edit. Sets that hold a common passage among other text share a key
    only if all its minima fall in the passage. At first a set is compared with the two before it at each key, in the order of
    sizes and fingerprints; what that links is not compared again. All others at a key are compared where they meet, so
    a group's pairs are never rows. Sizes and a 128-bit SimHash, which tells six standard deviations apart, spare counts.

    Null and blank texts are alike; rows whose set only rows without doc_id share have component_id null.
    """
    spark = docs.sparkSession
    ready(spark)
    found = stored(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(sets(words_per_shingle), "doc_id long, text_hash long, node long, f0 long, f1 long, n long, keys binary, members binary"), "sets")
    least = F.min(F.struct("doc_id", "f0", "f1", "n", "keys")).alias("x")
    nodes = stored(found.where("doc_id is not null").groupBy("node").agg(least).select("node", F.col("x.doc_id").alias("rep"), "x.f0", "x.f1", "x.n", "x.keys"), "nodes")
    spread = "anchor long, home boolean, node long, rep long, root long, n long, f0 long, f1 long"
    reps = nodes.select("node", "rep")

    def members(asked: DataFrame) -> DataFrame:
        some = sent(stored(asked.distinct(), "asked"))
        return found.where("doc_id is not null").select("node", "members").join(some, "node", "left_semi").dropDuplicates(["node"])

    prints = stored(nodes.groupBy("f0").agg(F.min("node").alias("rep")), "fingerprints")
    same = nodes.select("f0", "node").join(prints, "f0").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = link(prints.select(F.col("f0").alias("fp"), "rep")).toDF("a", "b")
    every = nodes.select("node", "rep", F.col("rep").alias("root"), "n", "f0", "f1", "keys").mapInArrow(replicate_sets, spread)
    order = ("anchor", "n", "f0", "node")
    lined = every.select(*order).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    beside = lined.select("anchor", "node").mapInArrow(neighbours, "a long, b long")
    pairs = stored(same.union(near).union(beside).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    mine = stored(members(pairs.select(F.explode(F.array("a", "b")).alias("node"))).join(reps, "node"), "members")
    u, v = (mine.select(F.col("node").alias(x), F.col("rep").alias(y), F.col("members").alias(z)) for x, y, z in (("a", "u", "x"), ("b", "v", "y")))
    some = stored(pairs.join(u, "a").join(v, "b").select("u", "v", "x", "y").mapInArrow(verify_sets(similarity), "u long, v long"), "links")
    spent(prints, pairs, mine)
    roots = sent(components(some).toDF("of", "root"))
    rooted = stored(nodes.join(roots, F.col("rep") == F.col("of"), "left").select("node", "rep", F.coalesce("root", "rep").alias("root"), "n", "f0", "f1", "keys"), "rooted")
    rest = rooted.mapInArrow(replicate_sets, spread)
    open_ = stored(rest.groupBy("anchor").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("anchor"), "open-keys")
    opened = stored(rest.join(sent(open_), "anchor", "left_semi"), "open-sets")
    held = opened.join(members(opened.select("node")).hint("merge"), "node")
    met = _together(_split(held, ["rep", "root", "n", "f0", "f1", "members"]))
    more = stored(met.mapInArrow(compare_sets(similarity), "u long, v long"), "links")
    roots = components(some.union(more)).toDF("of", "root")
    of = stored(reps.join(roots, F.col("rep") == F.col("of"), "left").select("node", F.coalesce("root", "rep").alias("component_id")), "classes")
    out = stored(found.select("doc_id", "text_hash", "node").join(of, "node", "left").select("doc_id", "text_hash", "component_id"), "near-duplicates")
    spent(found, nodes, some, rooted, open_, opened, more, of)
    return out


def one_of_each(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without the near duplicates: of linked documents the one with the smallest doc_id stays, once.

    Rows without doc_id go if they are linked to one that has it; a group of such rows alone stays, each text once.
    """
    found = similar(docs, words_per_shingle, similarity)
    here = F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))
    own = fresh(docs)
    gone = stored(found.where(~here).select(F.struct("doc_id", "text_hash").alias(f"{own}gone")).distinct(), "gone")
    keyed = docs.withColumn(f"{own}key", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")))
    left = keyed.join(sent(gone), F.expr(f"{own}key <=> {own}gone"), "left_anti")
    twice = stored(found.where(here).groupBy("doc_id", "text_hash").count().where("count > 1").select(F.struct("doc_id", "text_hash").alias(f"{own}twice")), "repeated-rows")
    if not twice.take(1):
        return left.drop(f"{own}key")
    # Of rows that are repeated one stays; all others need not move.
    left = left.join(sent(twice), F.expr(f"{own}key <=> {own}twice"), "left")
    one = left.where(f"{own}twice is not null").dropDuplicates([f"{own}key"])
    return left.where(f"{own}twice is null").union(one).drop(f"{own}key", f"{own}twice")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"), words_per_shingle=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
