"""Nearest rows against all pairs, over several blocks of rows and of queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.operators import knn


@pytest.mark.parametrize("rows, asked", [(4096, 1024), (40, 7)])
def test_nearest_equal_all_pairs(spark, monkeypatch, rows, asked):
    monkeypatch.setattr(knn, "ROWS", rows)
    monkeypatch.setattr(knn, "QUERIES", asked)
    rng = np.random.default_rng(1)
    data = [(i, np.round(rng.normal(0, 1, 8), 2).tolist()) for i in range(300)]
    data += [(300, data[0][1]), (301, data[0][1]), (302, [0.0] * 8), (303, None), (304, [1.0]), (305, [None] + [1.0] * 7)]
    df = spark.createDataFrame(data, "vec_id long, e array<double>").repartition(3)
    got = {}
    for r in knn.cosine_topk(df, df.where("vec_id % 10 = 0"), "vec_id", "e", 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, r.cosine)
    unit = {i: np.array(v) / max(np.linalg.norm(v), 1e-300) for i, v in data if v is not None and len(v) == 8 and None not in v}
    assert set(got) == {i for i in unit if i % 10 == 0}
    for q, found in got.items():
        want = sorted((-round(float(unit[q] @ x), 6), i) for i, x in unit.items() if i != q)[:4]
        assert [found[k][0] for k in (1, 2, 3, 4)] == [i for _, i in want] and all(abs(found[k + 1][1] + c) < 1e-6 for k, (c, _) in enumerate(want))


def test_plan_does_not_grow_with_queries(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 5)
    df = spark.range(200).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("e"))
    plans = [knn.cosine_topk(df, df.where(f"vec_id < {n}"), "vec_id", "e")._jdf.queryExecution().executedPlan().toString() for n in (5, 100)]
    assert plans[0].count("\n") == plans[1].count("\n")
    assert knn.cosine_topk(df, df.limit(0), "vec_id", "e").count() == 0
