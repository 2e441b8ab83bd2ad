"""Clusters of an author's telling tokens: weighted k-means that any engine can repeat.

Tokens have whole-number vectors and TF-IDF weights; centres begin at the
tokens with the smallest hashes and move to the weighted means of their tokens,
rounded down. All sums are of whole numbers, so neither partitions nor the
order of rows can change the result. Steps are native aggregates: a round adds
up a row for each cluster and brings those k rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators import signals
from cloakframe.sources import shared

DIMS, UNIT, MICRO = 32, 1000, 1_000_000


def letters(token: Column, dims: int = DIMS) -> Column:
    """A vector of a token's shape: counts of its runs of three letters (with its ends marked), by hash, scaled to length UNIT."""
    ends = F.concat(F.lit("<"), token, F.lit(">"))
    grams = F.transform(F.sequence(F.lit(1), F.char_length(ends) - 2), lambda i: F.pmod(F.conv(F.substr(F.md5(F.substr(ends, i, F.lit(3))), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.size(F.filter(grams, lambda g: g == d)))
    norm = F.sqrt(F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c * c))
    return F.transform(counts, lambda c: F.floor(c * UNIT / norm).cast("long"))


def _distance(vector: Column, centre: list[int]) -> Column:
    there = F.array(*(F.lit(v).cast("long") for v in centre))
    return F.aggregate(F.zip_with(vector, there, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, d: s + d)


def weighted_kmeans(rows: DataFrame, key: str, vector: str, weight: str, dims: int, k: int = 8, rounds: int = 5, seed: int = 0) -> tuple[DataFrame, list[list[int]]]:
    """(rows with cluster and distance, centres). vector: array<long> of `dims`; weight: a whole number above zero; the nearest centre wins, of equal ones the first.

    Fewer rows than k make fewer clusters; a centre without rows stays where it is.
    """
    rows = shared.stored(rows)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    centres = [list(r[0]) for r in rows.select(vector, hashed.alias("__h")).orderBy("__h", vector).limit(k).select(vector).collect()]

    def assigned() -> DataFrame:
        options = F.array(*(F.struct(_distance(F.col(vector), c).alias("distance"), F.lit(i).alias("cluster")) for i, c in enumerate(centres)))
        return rows.withColumn("__best", F.array_min(options)).select("*", "__best.cluster", "__best.distance").drop("__best")

    if not centres:
        return rows.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centres
    for _ in range(rounds):
        w = F.col(weight).cast("decimal(20,0)")
        sums = [F.sum(w * F.col(vector)[i].cast("decimal(18,0)")).alias(f"s{i}") for i in range(dims)]
        for r in assigned().groupBy("cluster").agg(F.sum(w).alias("w"), *sums).collect():
            centres[r["cluster"]] = [int(r[f"s{i}"]) // int(r["w"]) for i in range(dims)]
    return assigned(), centres


def author_clusters(docs: DataFrame, author: str, text: str, k: int = 8, rounds: int = 5, top: int = 25, terms: int = 5, seed: int = 0) -> DataFrame:
    """author, cluster, mass, concentration, rank and terms: how much of an author's TF-IDF weight falls in each cluster of tokens.

    mass: the author's weight in the cluster; concentration: its share of the cluster's weight over all authors; rank: the
    cluster's place among those of the author, by mass; terms: the author's heaviest tokens in it. Tokens are those
    among the `top` of some author.
    """
    weights = signals.author_tfidf(docs, author, text, top).select("author", "token", F.round(F.col("weight") * MICRO).cast("long").alias("w"))
    weights = shared.stored(weights)
    tokens = weights.groupBy("token").agg(F.sum("w").alias("w")).select("token", "w", F.inline(F.array(F.struct(letters(F.col("token")).alias("v")))))
    found, _ = weighted_kmeans(tokens.where("w > 0"), "token", "v", "w", DIMS, k, rounds, seed)
    rows = weights.join(found.select("token", "cluster"), "token")
    heaviest = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("w"), "token"))), 1, terms)  # of `top` tokens at most
    per = rows.groupBy("author", "cluster").agg(F.sum("w").alias("w"), F.transform(heaviest, lambda t: t["token"]).alias("terms"))
    total = F.sum("w").over(Window.partitionBy("cluster"))
    rank = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("w"), "cluster"))
    return per.select("author", "cluster", F.round(F.col("w") / MICRO, 6).alias("mass"), F.round(F.col("w") / total, 6).alias("concentration"), rank.alias("rank"), F.array_join("terms", " ").alias("terms"))
