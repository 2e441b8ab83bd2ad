"""Masks for tokens that mark an author but do not matter to the classifier."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe import resources as R
from cloakframe.functions import text as T
from cloakframe.resources import patterns
from cloakframe.operators import signals

NEVER = tuple(sorted({w for terms in (*R.TARGETS.values(), *R.CUES.values()) for t in terms for w in t.split()}))


def choose(docs: DataFrame, key: str, author: str, text: str, per_row: int = 2, length: int = 7, count: int = 2, share: float = 0.75, impact: float = 0.003) -> DataFrame:
    """key, token, concentration: up to per_row tokens of each row that are long, repeated by one author mostly, and without effect on the score."""
    marks = signals.concentration(docs, author, text, count).where((F.length("token") >= length) & (F.col("concentration") >= share) & ~F.col("token").isin(*NEVER))
    # What matters to the score is left out in the row, before anything is exploded.
    rows = signals.with_effects(docs.select(F.col(key).alias("key"), F.col(author).alias("who"), F.col(text).alias("__x")), "__x")
    matters = F.transform(F.filter("effects", lambda x: F.abs(x["delta"]) > impact), lambda x: x["token"])
    own = F.filter(F.array_except("__t", matters), lambda x: F.length(x) >= length)
    rows = rows.select("key", "who", F.explode(own).alias("token"))
    free = rows.join(marks.select("token", "author", "concentration"), "token").where(F.col("author") == F.col("who"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("concentration"), "token"))
    return free.withColumn("rank", rank).where(F.col("rank") <= per_row).select("key", "token", "concentration", "rank")


MARKER = r"(?i)^(?:" + "|".join(R.MARKERS) + ")$"


def _by_look(token: Column, normal: Column, length: int) -> list[tuple[Column, Column]]:
    """What the token's look says: placeholders never, style markers and drawn-out letters always, short ones not."""
    none = F.lit(None).cast("string")
    drawn = F.lower(token).rlike("|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz"))
    return [(token.rlike(f"^{patterns.PLACEHOLDER}$"), none), (token.rlike(MARKER), F.lit("style_marker")), (drawn, F.lit("repeated_letters")), (F.length(normal) < length, none)]


def _first(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(*cases[0])
    for c, v in cases[1:]:
        out = out.when(c, v)
    return out


def token_reason(token: Column, normal: Column, author_count: Column, share: Column, documents: Column, length: int = 7, count: int = 2, least: float = 0.75, rare: int = 1) -> Column:
    """Why a token may be masked, by how it is spread over authors; null where it may not."""
    look = _by_look(token, normal, length)
    title = (token.rlike(r"^\p{Lu}"), F.lit(None).cast("string"))
    return _first([*look[:3], title, look[3], ((author_count >= count) & (share >= least), F.lit("author_concentrated")), ((documents <= rare) & (F.length(normal) >= length + 2), F.lit("rare_long_token"))])


def tfidf_reason(token: Column, normal: Column, author_count: Column, weight: Column, rank: Column, length: int = 7, count: int = 2, least: float = 0.06, top: int = 25) -> Column:
    """author_tfidf where the token marks its author by weight and rank."""
    return _first([*_by_look(token, normal, length), ((author_count >= count) & (weight >= least) & (rank <= top), F.lit("author_tfidf"))])


def cluster_reason(token: Column, normal: Column, author_count: Column, weight: Column, rank: Column, mass: Column, share: Column, cluster_rank: Column, length: int = 7, count: int = 2, least: float = 0.06, top: int = 25, mass_from: float = 0.0, share_from: float = 0.75, cluster_top: int = 3) -> Column:
    """semantic_cluster where the token marks its author, and its cluster does too."""
    marks = (author_count >= count) & (weight >= least) & (rank <= top) & (mass >= mass_from) & (share >= share_from) & (cluster_rank <= cluster_top)
    return _first([*_by_look(token, normal, length), (marks, F.lit("semantic_cluster"))])


def masked(docs: DataFrame, key: str, author: str, text: str, threshold: float = 0.5, drift: float = 0.1, **options) -> DataFrame:
    """key, text, n_masked, reverted: tokens masked as [TERM]; a row whose label would flip or whose score drifts keeps its text."""
    tokens = choose(docs, key, author, text, **options).groupBy("key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))

    @F.udf("string", useArrow=True)
    def mask(t, tokens):
        for w in tokens or ():
            t = re.sub(rf"(?<![a-z']){re.escape(w)}(?![a-z'])", "[TERM]", t or "", count=1, flags=re.I)
        return t

    j = docs.join(tokens, F.col(key) == F.col("key"), "left").select(F.col(key).alias("k"), F.col(text).alias("old"), mask(F.col(text), F.col("tokens")).alias("new"), F.coalesce(F.size("tokens"), F.lit(0)).alias("n"))
    a, b = T.keyword_score(F.col("old")), T.keyword_score(F.col("new"))
    bad = ((a >= threshold) != (b >= threshold)) | (F.abs(a - b) > drift)
    j = j.withColumn("reverted", F.coalesce(bad, F.lit(False)))
    return j.select(F.col("k").alias(key), F.when(F.col("reverted"), F.col("old")).otherwise(F.col("new")).alias("text"), F.when(F.col("reverted"), 0).otherwise(F.col("n")).alias("n_masked"), "reverted")


def clusters(vectors: DataFrame, key: str, vector: str, author: str, k: int = 8, seed: int = 0) -> DataFrame:
    """author, cluster, mass, concentration, rank: k-means clusters of vectors and how much each author has of each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(key, author, array_to_vector(F.col(vector)).alias("features"))
    found = KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows).transform(rows)
    mass = found.groupBy(F.col(author).alias("author"), "cluster").agg(F.count("*").alias("mass"))
    total = F.sum("mass").over(Window.partitionBy("cluster"))
    return mass.withColumn("concentration", F.round(F.col("mass") / total, 6)).withColumn("rank", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("mass"), "cluster")))
