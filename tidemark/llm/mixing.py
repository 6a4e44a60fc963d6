"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import WORD, fresh, read, ready, spent, stored

#: One row for each source is held by the driver: the weights are settings, not data.
MOST_SOURCES = 1_000_000
#: Documents of one source and size whose copies are dealt out in one window.
LEAST_GROUP, MOST_GROUPS = 256, 20_000
#: Rows of a plan that are sent to all tasks at most.
MOST_SENT = 500_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], cap: float) -> list[float]:
    """Shares of the whole size by weight, each at most cap times its source's size, the excess reshared by weight."""
    left, open_ = float(sum(s for _, s in sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while open_:
        total = sum(weights[i % len(weights)] for i in open_)
        full = {i for i in open_ if left * weights[i % len(weights)] / total > cap * sizes[i][1]}
        if not full:
            for i in open_:
                out[i] = left * weights[i % len(weights)] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i][1])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def solve(spark: SparkSession, bins: DataFrame, goal: dict[str, float], cap: float, rounds: int = 60) -> dict[str, float]:
    """Multipliers of the convex dual sum(n * capped exp(x * size)) - x * goal, one for each source.

    A Newton step for every source at once: gradient and curvature are one distributed aggregation over the counts of
    (source, size), which hold all that the dual needs. A step outside the bracket found so far is halved. Sums are decimal,
    so that they don't depend on the order in which rows come. Says so if sources are still off after all rounds.
    """
    x = dict.fromkeys(goal, 0.0)
    low, high = dict.fromkeys(goal, -math.inf), dict.fromkeys(goal, math.log(cap))
    top = math.log(cap)
    moved = bool(x)
    for _ in range(rounds):
        now = spark.createDataFrame(pa.table({"skey": list(x), "x": pa.array(x.values(), pa.float64())}))
        lift = F.col("x") * F.col("size")
        rate = F.exp(F.least(lift, F.lit(top)))
        exact = lambda c: F.sum(c.cast("decimal(32,8)")).cast("double")
        sums = bins.where("size > 0").join(now, "skey").groupBy("skey", "x").agg(exact(F.col("n") * F.col("size") * rate).alias("f"), exact(F.when(lift < top, F.col("n") * F.col("size") * F.col("size") * rate).otherwise(0.0)).alias("d"))
        moved = False
        for k, at, f, d in ((r.skey, r.x, r.f, r.d) for r in sums.collect()):
            if abs(f - goal[k]) <= 1e-7 * goal[k]:
                continue
            (low if f < goal[k] else high)[k] = at
            step = at - (f - goal[k]) / d if d > 0 else math.inf
            if not low[k] < step < high[k]:
                step = (low[k] + high[k]) / 2 if low[k] > -math.inf else 2 * min(at, -1e-6)
            moved |= step != at
            x[k] = step
        if not moved:
            break
    if moved:
        warnings.warn(f"the mix has not converged after {rounds} Newton rounds", stacklevel=2)
    return x


def round_copies(size: np.ndarray, n: np.ndarray, rate: np.ndarray, goal: float, cap: int) -> np.ndarray:
    """Whole copies for each bin, ordered by size: running sums are rounded, so what one bin gains its neighbour of nearly
    the same size gives back; then single copies are moved until no document is small enough to bring the sum nearer."""
    total = np.round(np.cumsum(n * rate))
    copies = np.diff(total, prepend=0.0).clip(0, n * cap).astype(np.int64)
    for _ in range(64):
        gap = goal - float((copies * size).sum())
        fits = (size > 0) & (size < 2 * abs(gap)) & ((copies < n * cap) if gap > 0 else (copies > 0))
        if not fits.any():
            break
        best = np.flatnonzero(fits)[np.abs(size[fits] - abs(gap)).argmin()]
        copies[best] += 1 if gap > 0 else -1
    return copies


def _source(source: Column) -> Column:
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class Plan:
    """How many copies of each document a mix takes: for each source, size and salt the copies that all its documents have
    (least), and the mark up to which documents have one more (upto)."""

    def __init__(self, docs: DataFrame, weights: tuple[float, ...], cap: int):
        spark = docs.sparkSession
        ready(spark)
        self.sizes = few = stored(docs.select("doc_id", _source(F.col("source")).alias("skey"), _size(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark")), "sizes")
        bins = stored(few.groupBy("skey", "size").agg(F.count("*").alias("n")), "bins")
        rows = bins.groupBy("skey").agg(F.sum(F.col("n") * F.col("size")).alias("s"), F.sum("n").alias("n")).take(MOST_SOURCES + 1)
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        order = sorted(rows, key=lambda r: (r.skey == "n", r.skey.encode()))
        goal = dict(zip([r.skey for r in order], targets([(r.skey, r.s) for r in order], weights, cap), strict=True))
        words = {r.skey: r.s for r in order}
        x = solve(spark, bins, {k: v for k, v in goal.items() if v > 0}, cap)
        #: Documents of a source and size beyond which they are dealt out by salts.
        self.group = max(LEAST_GROUP, -(-sum(r.n for r in order) // MOST_GROUPS))
        split = bins.select("skey", "size", F.col("n").alias("of"))
        dealt = stored(few.join(split, ["skey", "size"]).select("skey", "size", "of", "mark", self.salt(F.col("mark"), F.col("of")).alias("salt")), "dealt")
        counts = stored(dealt.groupBy("skey", "size", "of", "salt").agg(F.count("*").alias("n")), "counts")

        def plan(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values(["size", "salt"], ignore_index=True)
            key = part["skey"].iloc[0]
            size, n = part["size"].to_numpy(), part["n"].to_numpy()
            rate = np.exp(np.minimum(x.get(key, 0.0) * size, math.log(cap))) * (size > 0)
            return part.assign(copies=round_copies(size, n, rate, goal[key], cap), source_size=words[key], target=goal[key])

        plans = stored(counts.groupBy("skey").applyInPandas(plan, "skey string, size long, of long, salt long, n long, copies long, source_size long, target double"), "plans")
        place = F.row_number().over(Window.partitionBy("skey", "size", "salt").orderBy("mark"))
        last = dealt.drop("of").withColumn("place", place).join(plans.select("skey", "size", "salt", (F.col("copies") % F.col("n")).alias("place")), ["skey", "size", "salt", "place"])
        last = last.select("skey", "size", "salt", F.col("mark").alias("upto"))
        full = plans.join(last, ["skey", "size", "salt"], "left").select("skey", "size", "salt", "of", F.floor(F.col("copies") / F.col("n")).alias("least"), "upto", "source_size", "target")
        self.rows = stored(full, "plan")
        spent(bins, dealt, counts, plans)

    def salt(self, mark: Column, of: Column) -> Column:
        return F.pmod(mark, F.ceil(of / self.group)).cast("long")

    def put(self, docs: DataFrame, source: Column, size: Column, mark: Column) -> DataFrame:
        """docs, whose sources, sizes and marks are given, with a column that its own columns don't have, a struct (mark, size, source_size, target, copies); its name is fresh(docs).

        The plan has a row for each source, size and salt. Up to MOST_SENT of them travel to all tasks and the documents stay
        where they are; more are joined by a shuffle.
        """
        name = fresh(docs)
        one = self.rows.groupBy("skey", "size").agg(F.any_value("source_size").alias("source_size"), F.any_value("target").alias("target"), F.any_value("of").alias("of"), F.map_from_entries(F.collect_list(F.struct("salt", F.struct("least", "upto")))).alias("salts"))
        one = stored(one.select(F.struct("skey", "size").alias(f"{name}key"), F.struct("source_size", "target", "of", "salts").alias(f"{name}value")), "plan-by-size")
        small = self.rows.count() <= MOST_SENT
        keyed = docs.withColumn(name, F.struct(mark.alias("mark"), F.struct(source.alias("skey"), size.alias("size")).alias("mine")))
        joined = keyed.join(F.broadcast(one) if small else one.hint("merge"), F.col(f"{name}.mine") == F.col(f"{name}key"))
        value, mark = F.col(f"{name}value"), F.col(f"{name}.mark")
        deal = value["salts"][self.salt(mark, value["of"])]
        copies = deal["least"] + F.when(mark <= deal["upto"], 1).otherwise(0)
        put = F.struct(mark.alias("mark"), F.col(f"{name}.mine.size").alias("size"), value["source_size"].alias("source_size"), value["target"].alias("target"), copies.cast("long").alias("copies"))
        return joined.withColumn(name, put).drop(f"{name}key", f"{name}value")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, mark, size, source_size, target, copies) for each row of docs; mark is the XXH64 of doc_id and text.

    Rates are those nearest to one copy of each document (in relative entropy) that take each source's target of words:
    min(cap, exp(x * size)) with one multiplier for each source; at a fixed target a source below its size therefore
    gives up long documents first. Rates are rounded to copies by the counts of (source, size), then dealt to the
    documents of a bin in the order of a hash. All documents of a source and size have the same rate, and a source's
    words differ from its target by less than its shortest movable document, where one copy can still be moved.

    A null source is one of its own, ordered last; weights repeat over the sources in code point order. A null or blank
    text has size 0 and no copies. Repeated rows are taken alike, which may take a copy of each more. An empty
    table gives no rows. Columns of docs other than doc_id, text and source are not read.
    """
    plan = Plan(docs, weights, cap)
    found = plan.put(plan.sizes, F.col("skey"), F.col("size"), F.col("mark"))
    return found.select("doc_id", *(f"{fresh(plan.sizes)}.{c}" for c in ("mark", "size", "source_size", "target", "copies")))


def taken(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows of docs of which mix() takes copies, with size, source_size, target, copies and taken, the words in all copies.

    Columns of docs by these names are replaced; all else of mix() holds.
    """
    plan, name, added = Plan(docs, weights, cap), fresh(docs), ["size", "source_size", "target", "copies"]
    found = plan.put(docs, _source(F.col("source")), _size(F.col("text")), F.xxhash64("doc_id", "text"))
    found = found.where(F.col(f"{name}.copies") > 0)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*added, "taken")]
    return found.select(*kept, *(f"{name}.{c}" for c in added), (F.col(f"{name}.copies") * F.col(f"{name}.size")).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
