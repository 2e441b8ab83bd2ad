"""Scores out of fold, and grids of metrics."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cloakframe.operators import evaluate, oof

WORDS = "good fine nice calm bad vile rude cruel dog cat tree lake".split()


def rows(n=120, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = rng.random() < 0.4
        words = rng.choices(WORDS[:4] if not y else WORDS[4:8], k=3) + rng.choices(WORDS, k=4)
        out.append((i, " ".join(words), int(y)))
    return out


def plain(train, held, weight):
    """The same model by Newton steps on exact counts: mean weighted loss + reg / 2 |w|**2."""
    count = lambda t: np.array([t.split().count(w) for w in WORDS], float)
    x = np.array([count(t) for _, t, _ in train])
    idf = np.log((len(x) + 1) / ((x > 0).sum(0) + 1))
    x, y = np.c_[x * idf, np.ones(len(x))], np.array([y for *_, y in train], float)
    c = np.array([weight[v] for v in y])
    w, penalty = np.zeros(x.shape[1]), np.diag([0.01] * len(WORDS) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (c * (p - y)) / c.sum() + penalty @ w
        w -= np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x / c.sum() + penalty, g)
    return {i: 1 / (1 + math.exp(-(count(t) * idf @ w[:-1] + w[-1]))) for i, t, _ in held}


def test_scores_equal_plain_models(spark):
    data = rows()
    got = {r.key: r for r in oof.scores(spark.createDataFrame(data, "id long, t string, y int"), "id", "t", F.col("y"), folds=3, max_iter=200).collect()}
    assert sorted(got) == list(range(len(data)))
    share = sum(y for *_, y in data) / len(data)
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    for k in range(3):
        train, held = [r for r in data if got[r[0]].fold != k], [r for r in data if got[r[0]].fold == k]
        for i, p in plain(train, held, weight).items():
            assert abs(got[i].score - p) < 2e-3
    hit = {i: r.score >= 0.5 for i, r in got.items()}
    tp = sum(hit[i] and y for i, _, y in data)
    f1 = 2 * tp / (sum(hit.values()) + sum(y for *_, y in data))
    assert f1 > 0.8
    swept = {r.threshold: r.f1 for r in evaluate.threshold_sweep(spark.createDataFrame(list(got.values())), F.col("label") == 1, "score").collect()}
    assert abs(max(v for t, v in swept.items() if t >= 0.5) - f1) < 0.2 and max(swept.values()) >= f1 - 1e-6


def test_no_model_sees_the_fold_it_scores(spark, monkeypatch):
    seen = []

    def fit(train, *options):
        seen.append({r.key for r in train.select("key").collect()})
        return len(seen) - 1

    def scored(model, held):
        assert not seen[model] & {r.key for r in held.select("key").collect()}
        return held.select("key", "fold", F.col("label").cast("int").alias("label"), F.lit(0.5).alias("score"))

    monkeypatch.setattr(oof, "fit", fit)
    monkeypatch.setattr(oof, "scored", scored)
    data = [*rows(50), (100, None, 1), (101, "", 0), (102, "no label", None), (None, "x", 1)]
    got = oof.scores(spark.createDataFrame(data, "id long, t string, y int"), "id", "t", F.col("y"), folds=4)
    assert got.count() == len(data) and len(seen) == 4 and all(102 not in s for s in seen)


def test_one_label_or_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, t string, y int")
    assert {r.score for r in oof.scores(df, "id", "t", F.col("y"), folds=2).collect()} == {1.0}
    assert oof.scores(df.limit(0), "id", "t", F.col("y"), folds=2).count() == 0


def test_grid_has_subtotals(spark):
    df = spark.createDataFrame([("m", "a", True, True), ("m", "a", False, True), ("m", None, True, False), ("n", None, True, True)], "model string, data string, g boolean, p boolean")
    got = {(r.model, r["data"], r.level): (r.tp, r.fp, r.fn, r.tn) for r in evaluate.grid(df, F.col("g"), F.col("p"), [["model", "data"], ["model"], []]).collect()}
    assert got == {("m", "a", 0): (1, 1, 0, 0), ("m", None, 0): (0, 0, 1, 0), ("n", None, 0): (1, 0, 0, 0), ("m", None, 1): (1, 1, 1, 0), ("n", None, 1): (1, 0, 0, 0), (None, None, 3): (2, 1, 1, 0)}
