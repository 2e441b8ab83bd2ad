"""Weighted clusters of tokens against a plain version, in one partition and in many."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from cloakframe.operators import clusters


def plain_vector(token):
    ends, counts = f"<{token}>", [0] * clusters.DIMS
    for i in range(len(ends) - 2):
        counts[int(hashlib.md5(ends[i : i + 3].encode()).hexdigest()[:4], 16) % clusters.DIMS] += 1
    norm = math.sqrt(sum(c * c for c in counts))
    return [math.floor(c * clusters.UNIT / norm) for c in counts]


def plain_kmeans(rows, k, rounds, seed=0):
    order = sorted(rows, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centres = [v for _, v, _ in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v, w in rows:
            groups.setdefault(near(v)[1], []).append((v, w))
        for i, xs in groups.items():
            total = sum(w for _, w in xs)
            centres[i] = [sum(w * v[d] for v, w in xs) // total for d in range(len(centres[i]))]
    return {t: near(v)[::-1] for t, v, _ in rows}, centres


def test_clusters_equal_plain_ones_in_any_partitions(spark):
    rng = random.Random(1)
    tokens = {"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(120)}
    rows = [(t, plain_vector(t), rng.randint(1, 10**6)) for t in sorted(tokens)]
    want, centres = plain_kmeans(rows, 6, 4)
    df = spark.createDataFrame([(t, w) for t, _, w in rows], "token string, w long").withColumn("v", clusters.letters(F.col("token")))
    assert {r.token: r.v for r in df.collect()} == {t: v for t, v, _ in rows}
    for parts in (1, 16):
        found, got = clusters.weighted_kmeans(df.repartition(parts), "token", "v", "w", clusters.DIMS, k=6, rounds=4)
        assert got == centres and {r.token: (r.cluster, r.distance) for r in found.collect()} == want


def test_authors_and_their_clusters(spark):
    docs = spark.createDataFrame([("u", "kayak paddle river kayak"), ("u", "kayaks and rivers"), ("v", "violin sonata and violins"), ("w", None)], "who string, t string")
    got = clusters.author_clusters(docs, "who", "t", k=3).collect()
    assert {r.author for r in got} == {"u", "v"}
    for a in ("u", "v"):
        mine = sorted((r for r in got if r.author == a), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(mine) + 1)) and all(x.mass >= y.mass for x, y in zip(mine, mine[1:]))
    for c in {r.cluster for r in got}:
        assert abs(sum(r.concentration for r in got if r.cluster == c) - 1) < 1e-5
    assert clusters.author_clusters(docs.limit(0), "who", "t").count() == 0
