"""Embedding near-duplicates with a robust-pruned flat graph, built on overlapping shards and searched by range."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import components, forest, read, ready, stored

#: Vectors, by order of a hash, that the centres of the shards are fitted on; vectors of a shard meant and at most.
MOST_SAMPLED, MEANT, MOST_MEMBERS, MOST_QUERIES = 20_000, 800, 4096, 4096
#: Neighbours a vector keeps in a shard's graph, those it chooses from, and how much nearer a kept one must be to prune another.
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
#: Entries of the search's beam, medoids it starts from, and how far below the bound it still expands.
BEAM, MEDOIDS, SLACK = 24, 16, 0.15
#: Queries of the recall audit, and the recall below which shards are made to overlap more.
AUDITED, LEAST_RECALL = 256, 0.98
OVERLAP = 0.08


def normalised(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) to (vec_id, key, vec, width): unit vectors as bytes of doubles; null key if one links with nothing."""
    for batch in batches:
        keys, vecs, widths = [], [], []
        for x in batch.column(1):
            v = None
            if x.is_valid and len(x) and not x.values.null_count:
                raw = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)
                if np.isfinite(raw).all() and raw.any():
                    v = raw / np.abs(raw).max()  # else squares overflow or vanish
                    v = v / np.linalg.norm(v)
            keys.append(None if v is None else hashlib.sha256(raw.tobytes()).digest()[:16])
            vecs.append(None if v is None else v.tobytes())
            widths.append(0 if v is None else len(v))
        yield pa.record_batch({"vec_id": batch.column(0), "key": pa.array(keys, pa.binary()), "vec": pa.array(vecs, pa.binary()), "width": pa.array(widths, pa.int32())})


def centres(sample: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k unit centres by spherical k-means."""
    rng = np.random.default_rng(11)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        of = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return c


def assign(c: np.ndarray, width: int, overlap: float):
    """For mapInArrow over (rep, n, vec, width): a row for each shard whose centre is within overlap of the nearest one's
    similarity; home marks the nearest. Vectors of another width have a shard of that width's own."""

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(3).to_numpy(zero_copy_only=False)
            row, shard, home = [], [], []
            same = np.flatnonzero(widths == width)
            for lo in range(0, len(same), 2048):
                at = same[lo : lo + 2048]
                x = np.frombuffer(b"".join(batch.column(2).take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), width)
                near = x @ c.T
                best = near.max(1, keepdims=True)
                i, j = np.nonzero(near >= best - overlap)
                row.append(at[i])
                shard.append(j)
                home.append(j == near.argmax(1)[i])
            other = np.flatnonzero(widths != width)
            row, shard, home = np.concatenate([*row, other]), np.concatenate([*shard, -widths[other]]), np.concatenate([*home, np.ones(len(other), bool)])
            rest = batch.take(pa.array(row.astype(np.int64)))
            yield pa.record_batch({"shard": pa.array(shard.astype(np.int32)), "home": pa.array(home.astype(bool)), "rep": rest.column(0), "n": rest.column(1), "vec": rest.column(2)})

    return of


def _matrix(vec: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vec), np.float64).reshape(len(vec), -1)


def pruned(x: np.ndarray) -> np.ndarray:
    """For each vector up to DEGREE neighbours (-1 fills up): the nearest one left, which prunes those much nearer to it."""
    n = len(x)
    out = np.full((n, DEGREE), -1, np.int64)
    x = x.astype(np.float32)
    for lo in range(0, n if n > 1 else 0, 512):
        near = x[lo : lo + 512] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -2
        k = min(CANDIDATES, n - 1)
        cand = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(near, cand, 1)
        order = np.argsort(-sim, axis=1)
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        vecs = x[cand]
        left = np.ones(cand.shape, bool)
        rows = np.arange(len(cand))
        for slot in range(DEGREE):
            some = left.any(1)
            if not some.any():
                break
            pick = left.argmax(1)
            out[lo + rows[some], slot] = cand[rows[some], pick[some]]
            between = np.einsum("bd,bcd->bc", vecs[rows, pick], vecs)
            left &= ~(ALPHA**2 * (1 - between) <= 1 - sim)  # squared distances of unit vectors
            left[rows, pick] = False
    return out


def build(part: pd.DataFrame) -> pd.DataFrame:
    reps = part["rep"].to_numpy()
    near = pruned(_matrix(part["vec"]))
    return pd.DataFrame({"rep": reps, "near": [reps[r[r >= 0]] for r in near]})


def medoids(x: np.ndarray) -> np.ndarray:
    """The member nearest to the mean of each of MEDOIDS groups."""
    rng = np.random.default_rng(5)
    c = centres(x[rng.choice(len(x), min(len(x), 1024), replace=False)], MEDOIDS, 3)
    return np.unique((x @ c.T).argmax(0))


def search(bound: float):
    """For applyInPandas over the members and queries of a shard: (rep, links, root) of each query.

    Greedy search from the medoids brings a query's beam to its nearest vectors; from there the range expands: whatever
    is similar enough has its neighbours looked at, until nothing new is. Similarities found are verified in doubles.
    """

    def of(part: pd.DataFrame) -> pd.DataFrame:
        members = part[part["member"]].sort_values("rep", ignore_index=True)
        queries = part[part["query"]]
        if not len(members) or not len(queries):
            return pd.DataFrame({"rep": queries["rep"], "links": 0, "root": queries["rep"]})
        ids, x, count = members["rep"].to_numpy(), _matrix(members["vec"]), members["n"].to_numpy()
        y, names = _matrix(queries["vec"]), queries["rep"].to_numpy()
        small = x.astype(np.float32)
        lists = [np.asarray(a if a is not None else (), np.int64) for a in members["near"]]
        flat = np.concatenate([*lists, np.zeros(0, np.int64)])
        place = np.searchsorted(ids, flat).clip(max=len(ids) - 1)
        inside = ids[place] == flat
        owner = np.repeat(np.arange(len(ids)), [len(a) for a in lists])[inside]
        graph = np.concatenate([np.stack([owner, place[inside]]), np.stack([place[inside], owner])], axis=1)  # either way
        graph = np.unique(graph, axis=1)
        start = np.searchsorted(graph[0], np.arange(len(ids) + 1))
        entry = medoids(x)
        links, u, v = np.zeros(len(y), np.int64), [], []
        for lo in range(0, len(y), 256):
            q = y[lo : lo + 256].astype(np.float32)
            seen = np.zeros((len(q), len(ids)), bool)
            sim = np.full((len(q), len(ids)), -2, np.float32)
            seen[:, entry] = True
            sim[:, entry] = q @ small[entry].T
            done = np.zeros_like(seen)
            rows = np.arange(len(q))

            def visit(row: np.ndarray, node: np.ndarray) -> None:
                many = start[node + 1] - start[node]  # noqa: B023
                r = np.repeat(row, many)
                to = graph[1][np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[node], many)]  # noqa: B023
                new = ~seen[r, to]  # noqa: B023
                r, to = r[new], to[new]
                seen[r, to] = True  # noqa: B023
                for at in range(0, len(r), 1 << 17):
                    a, b = r[at : at + (1 << 17)], to[at : at + (1 << 17)]
                    sim[a, b] = np.einsum("ij,ij->i", q[a], small[b])  # noqa: B023

            k = min(BEAM, len(ids))
            for _ in range(2 * BEAM):
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                value = np.where(done[rows[:, None], top], -3, np.take_along_axis(sim, top, 1))
                best = value.argmax(1)
                go = value[rows, best] > -2
                if not go.any():
                    break
                row, node = rows[go], top[rows, best][go]
                done[row, node] = True
                visit(row, node)
            while True:
                row, node = np.nonzero((sim >= bound - SLACK) & ~done)
                if not len(row):
                    break
                done[row, node] = True
                visit(row, node)
            row, node = np.nonzero(sim >= bound - 1e-3)
            near = np.concatenate([np.einsum("ij,ij->i", y[lo + row[a : a + 65536]], x[node[a : a + 65536]]) >= bound for a in range(0, len(row), 65536)] or [np.zeros(0, bool)])
            near &= ids[node] != names[lo + row]
            row, node = row[near] + lo, node[near]
            links += np.bincount(row, count[node], minlength=len(y)).astype(np.int64)
            a, b = forest(names[row], ids[node])
            u.append(a)
            v.append(b)
        a, b = forest(np.concatenate([*u, names]), np.concatenate([*v, names]))
        root = dict(zip(a.tolist(), b.tolist(), strict=True))
        found = pd.DataFrame({"rep": names, "links": links, "root": [root.get(i, i) for i in names.tolist()]})
        rest = sorted(set(root) - set(names.tolist()))
        return pd.concat([found, pd.DataFrame({"rep": rest, "links": 0, "root": [root[i] for i in rest]})], ignore_index=True)

    return of


class Graph:
    """reps: (rep, n, vec, width), distinct vectors; links: (rep, links); edges: (u, v); recall as audited."""

    def __init__(self, reps: DataFrame, bound: float):
        self.reps, self.bound = reps, bound
        total = reps.count()
        sample = reps.orderBy(F.xxhash64("rep"), "rep").select("rep", "vec", "width").limit(min(total, MOST_SAMPLED)).collect()
        width = max((w := [r.width for r in sample]), key=w.count)
        x = np.frombuffer(b"".join(bytes(r.vec) for r in sample if r.width == width), np.float64).reshape(-1, width)
        c = centres(x, max(1, min(len(x) // 4, total // MEANT)))
        # Other vectors than the centres are fitted on are audited, where there are others.
        asked = reps.where(F.col("width") == width).orderBy(F.xxhash64("rep").desc(), "rep").select("rep", "vec", "width").limit(AUDITED).collect()
        truth, overlap = {k: n for k, n in self._truth(asked, width).items() if n}, OVERLAP
        while True:
            self._run(c, width, overlap)
            got = {r.rep: r.links for r in self.links.where(F.col("rep").isin(list(truth))).collect()} if truth else {}
            # Of all links together, and the mean over vectors, which links of one large group don't outweigh.
            each = [min(got.get(k, 0), n) / n for k, n in truth.items()]
            pooled = sum(min(got.get(k, 0), n) for k, n in truth.items()) / max(sum(truth.values()), 1)
            self.recall = min(pooled, sum(each) / len(each)) if truth else 1.0
            if self.recall >= LEAST_RECALL:
                break
            if overlap > 2:  # every shard holds every vector
                raise RuntimeError(f"the graph's recall is {self.recall:.3f} even where all shards overlap; {LEAST_RECALL} is wanted")
            overlap *= 2

    def _truth(self, queries: list, width: int) -> dict[int, int]:
        """Links of a few queries by brute force over all vectors, for the audit."""
        y, names, bound = np.frombuffer(b"".join(bytes(r.vec) for r in queries), np.float64).reshape(-1, width), np.array([r.rep for r in queries]), self.bound

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(names), np.int64)
            for batch in batches:
                same = np.flatnonzero(batch.column(3).to_numpy(zero_copy_only=False) == width)
                x = np.frombuffer(b"".join(batch.column(2).take(pa.array(same)).to_pylist()), np.float64).reshape(-1, width)
                rep, n = (batch.column(i).to_numpy(zero_copy_only=False)[same] for i in (0, 1))
                total += (((y @ x.T) >= bound) & (names[:, None] != rep)) @ n
            yield pa.record_batch({"rep": names, "links": total})

        return {r.rep: r.links for r in self.reps.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links")).collect()}

    def _run(self, c: np.ndarray, width: int, overlap: float) -> None:
        shards = stored(self.reps.mapInArrow(assign(c, width, overlap), "shard int, home boolean, rep long, n long, vec binary"), "shards")
        sizes = stored(shards.groupBy("shard").agg(F.count("*").alias("members"), F.count_if("home").alias("queries")), "shard-sizes")
        parts, asks = F.ceil(F.col("members") / MOST_MEMBERS).cast("int"), F.greatest(F.lit(1), F.ceil(F.col("queries") / MOST_QUERIES)).cast("int")
        sized = shards.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        near = sized.select("shard", "part", "rep", "vec").groupBy("shard", "part").applyInPandas(build, "rep long, near array<long>")
        union = stored(near.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
        hold = sized.join(union, "rep").select("shard", "part", F.explode(F.sequence(F.lit(0), asks - 1)).alias("ask"), "rep", "n", "vec", "near", F.lit(True).alias("member"), F.lit(False).alias("query"))
        ask = sized.where("home").select("shard", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.pmod(F.xxhash64("rep", F.lit(1)), asks).cast("int").alias("ask"), "rep", "n", "vec", F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("member"), F.lit(True).alias("query"))
        found = stored(hold.union(ask).groupBy("shard", "part", "ask").applyInPandas(search(self.bound), "rep long, links long, root long"), "found")
        self.links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        self.edges = found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v"))


def near_duplicates(vectors: DataFrame, bound: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors: links at a cosine of bound or more.

    Equal vectors are one node of the graph and count as often as they occur. Centres fitted on MOST_SAMPLED vectors make
    shards; a vector is in each shard whose centre is nearly as near as its own. Each shard's graph is robustly pruned; a
    vector's neighbours in all its shards are united; each vector is searched for in its own shard. The recall of AUDITED
    queries is measured against brute force over all vectors (of all links, and as a mean over vectors), and shards overlap
    more until it is LEAST_RECALL; if that can't be reached it raises. Every link
    that counts is verified in double precision. A shard of over MOST_MEMBERS is split at random, each part searched.

    Null, zero, empty and non-finite vectors have no links and are components of their own. Vectors of different lengths
    don't link. Repeated rows are one vector, each with its row. Rows without vec_id link with nothing, component null.
    """
    ready(vectors.sparkSession)
    rows = stored(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(normalised, "vec_id long, key binary, vec binary, width int"), "unit-vectors")
    sound = rows.where("key is not null and vec_id is not null")
    reps = stored(sound.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("n"), F.first("vec").alias("vec"), F.first("width").alias("width")), "distinct-vectors")
    if not reps.take(1):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    graph = Graph(reps.select("rep", "n", "vec", "width"), bound)
    roots = components(graph.edges)
    of = reps.select("key", "rep", "n").join(graph.links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    of = stored(of.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "classes")
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key")).join(of, "key", "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))


def op1_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP1_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN roots USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
