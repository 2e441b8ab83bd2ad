"""Mixing sources to target weights: subset-sum budget fitting.

Documents are counted by (source, exact length).  A source's target first takes
whole passes; what is left is filled from the histogram: the same share of
every length in bulk, then a bounded-knapsack dynamic program over the lengths
still available closes the gap to the word, where a subset allows it.  Which
documents of a length are taken is decided by a seeded hash.

Defined cases: null texts have no words; empty documents stand once where their
source takes a whole pass, else not at all, and count as taken 0; null sources form one source, last in order; rows that
share an id are told apart by nothing but are interchangeable, so as many of
them are taken as the plan says; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.llm import kit

BUCKETS = 1024  # of hashed documents per length, so that no length is ranked in one task


def subset(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length sum to the reachable value nearest to the goal (the lower of two).

    Bounded knapsack: counts are split in powers of two, reachable sums are the
    bits of an integer, and each sum keeps the stage that reached it first, by
    which the choice is traced back: the memory is that of one array of sums.
    All is divided by the lengths' common divisor first.
    """
    take = np.zeros(len(lengths), np.int64)
    some = np.flatnonzero((lengths > 0) & (counts > 0))
    if not len(some) or goal <= 0:
        return take
    unit = int(np.gcd.reduce(lengths[some]))
    size_of, whole = lengths[some] // unit, goal / unit
    goal, over = goal // unit, int(size_of.max())
    best = goal if whole - goal <= 0.5 else goal + 1
    room = goal + over + 1
    reach, limit, stages, first = 1, (1 << room) - 1, [], np.full(room, -1, np.int32)
    for i in np.argsort(-size_of, kind="stable"):
        size, left, k = int(size_of[i]), int(min(counts[some[i]], room // size_of[i])), 1
        while left > 0:
            m = min(k, left)
            new = reach << (m * size) & limit & ~reach
            if not new:
                break  # what this length adds is there already
            bits = np.unpackbits(np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8), count=room, bitorder="little")
            first[bits.astype(bool)] = len(stages)
            stages.append((int(some[i]), m, m * size))
            reach |= new
            left, k = left - m, 2 * k
        if reach >> best & 1:
            break
    at = np.append(0, np.flatnonzero(first >= 0))
    low = int(at[np.argmin(np.abs(at - whole))])  # the lower of two that are as near
    while low:
        i, m, size = stages[first[low]]
        take[i] += m
        low -= size
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, longest: int = 4) -> np.ndarray:
    """How many documents of each length to take so that their words come to the budget, or as near as can be.

    Bulk: the same share of each length, rounded down, leaving a rest of the
    order of the longest lengths; the dynamic program decides on the rest, so
    that its cost depends on the lengths, not on the corpus.
    """
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0:
        return np.zeros_like(counts)
    # Integer arithmetic in Python's own integers: products pass 64 bits at scale.
    spare = min(budget, longest * int(lengths.max()))
    bulk = np.array([int(c) * (budget - spare) // total for c in counts], np.int64)
    rest = budget - int((lengths * bulk).sum())
    return bulk + subset(lengths, counts - bulk, rest)


def targets(sizes: list[tuple[str | None, int]], weights: tuple, share: float, at_most: float) -> dict:
    """Target of each source: share of all words by weight, at most at_most times its own, the excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, out = dict(order), {}
    left, open_ = share * sum(size.values()), [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > at_most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(at_most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def plan(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, at_most: int = 2, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """For each row: its columns' key and source, size, source_size, target, times (how often the mix takes it) and taken."""
    rows = docs.select(docs[f"`{key}`"].alias("doc_id"), docs[f"`{source}`"].cast("string").alias("source"), F.coalesce(F.regexp_count(docs[f"`{text}`"].cast("string"), F.lit(kit.WORD)), F.lit(0)).cast("long").alias("size"))
    return _plan(rows, weights, share, at_most, seed)


def _plan(rows: DataFrame, weights: tuple, share: float, at_most: int, seed: int) -> DataFrame:
    spark = rows.sparkSession
    # Text is read once; later steps need only these few numbers.
    rows = kit.stored(rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")))
    # A row per source: as many as the weights are meant for, not a number that grows with documents.
    sizes = [(r.source, int(r.n)) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    goal = targets(sizes, weights, share, at_most)
    per_source = spark.createDataFrame([(s, n, float(goal[s])) for s, n in sizes], "__source string, source_size long, target double")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size").reset_index(drop=True)
        lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        words, target = int((lengths * counts).sum()), round(float(pdf["target"].iloc[0]))
        passes = min(target // words, at_most) if words else 0
        more = fit(lengths, counts, target - passes * words) if passes < at_most and words else np.zeros_like(counts)
        return pdf[["source", "size"]].assign(passes=passes, more=more)

    # Rows here are lengths, not documents.
    histogram = rows.groupBy("source", "size").agg(F.count("*").alias("n")).join(per_source, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    chosen = kit.stored(histogram.groupBy("source").applyInPandas(choose, "source string, size long, passes long, more long"))
    # Documents of a length are ordered by bucket, then hash; only within the bucket at the border must they be ranked.
    by_bucket = rows.groupBy("source", "size", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = by_bucket.select("source", "size", "bucket", "n", before.alias("before")).alias("b").join(chosen.alias("c"), F.col("b.source").eqNullSafe(F.col("c.source")) & (F.col("b.size") == F.col("c.size")))
    quota = quota.select("b.source", "b.size", "b.bucket", "passes", F.greatest(F.lit(0), F.least(F.col("more") - F.col("before"), F.col("n"))).alias("quota"), "n")
    r = rows.alias("r").join(quota.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.size") == F.col("q.size")) & (F.col("r.bucket") == F.col("q.bucket"))).select("r.*", "passes", "quota", "n")
    border = r.where((F.col("quota") > 0) & (F.col("quota") < F.col("n")))
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id"))
    clear = r.where(~((F.col("quota") > 0) & (F.col("quota") < F.col("n")))).withColumn("extra", (F.col("quota") > 0).cast("long"))
    done = clear.unionByName(border.withColumn("extra", (rank <= F.col("quota")).cast("long")))
    done = done.withColumn("times", F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(F.least(F.col("passes"), F.lit(1))))
    out = done.join(per_source, F.col("source").eqNullSafe(F.col("__source")))
    return out.select("doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of the mix with their own columns; a row taken twice stands twice.

    Rows are joined with their decisions by the hash of all that is decided on;
    rows that share key, source and size get their decisions in any order, but each as many as planned.
    """
    opts = {"weights": (3, 1, 2), "share": 1.5, "at_most": 2, "seed": 0} | options
    size = F.coalesce(F.regexp_count(docs[f"`{text}`"].cast("string"), F.lit(kit.WORD)), F.lit(0)).cast("long")
    decided = plan(docs, text=text, source=source, key=key, **opts)
    # As many decisions per (key, source, size) as there are rows; the count is 1 where ids are unique.
    group = ["doc_id", "source", "size"]
    decided = decided.groupBy(*group).agg(F.sum("times").alias("times"), F.count("*").alias("n"))
    whole = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row"), docs[f"`{key}`"].alias("__k"), docs[f"`{source}`"].cast("string").alias("__s"), size.alias("__z"))
    both = whole.join(decided, F.col("__k").eqNullSafe(F.col("doc_id")) & F.col("__s").eqNullSafe(F.col("source")) & (F.col("__z") == F.col("size")))
    unique = both.where("n = 1").select("__row", "times")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.xxhash64(F.to_json("__row"))))
    shared = both.where("n > 1").withColumn("__i", rank - 1).withColumn("each", F.floor(F.col("times") / F.col("n")))
    shared = shared.select("__row", (F.col("each") + F.when(F.col("__i") < F.col("times") - F.col("each") * F.col("n"), 1).otherwise(0)).alias("times"))
    return unique.unionByName(shared).where("times > 0").withColumn("__t", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("__row.*")
