"""What has gone wrong once: fan-out of predictions, swallowed errors, stale stages, a detector that runs twice."""

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import privatize
from cloakframe.plans import bundle
from cloakframe.sources import services


def test_repeated_predictions_do_not_multiply_rows(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3), (None, 4)], "k string, i long")
    found = spark.createDataFrame([("x", 9, 0.1), ("x", 10, 0.3), (None, 2, 0.2), (None, 2, 0.4), (None, None, 0.9)], "k string, i long, p double")
    got = services.with_predictions(rows, found, "k", "i", ["p"]).collect()
    assert sorted((r.i, r.p) for r in got) == [(1, 0.3), (2, 0.4), (3, None), (4, None)]


def test_programming_errors_end_the_query(spark):
    df = spark.createDataFrame([("a",)], "t string")

    def wrong():
        return lambda texts: texts.no_such_thing

    with pytest.raises(Exception, match="no_such_thing"):
        services.apply_service(df, "t", wrong, "u", retries=0).collect()

    def away():
        def call(texts):
            raise ConnectionError("away")

        return call

    assert [(r.u, r.status) for r in services.apply_service(df, "t", away, "u", retries=0).collect()] == [(None, "failed")]


def test_stages_of_another_input_are_made_again(spark, tmp_path):
    where, made = str(tmp_path), []

    def make(n):
        def run():
            made.append(n)
            return spark.range(n)

        return run

    for n, want in ((3, 3), (3, 3), (9, 9), (9, 9)):
        assert bundle.stage(spark, where, "s", make(n), bundle.digest(spark.range(n))).count() == want
    assert made == [3, 9]
    assert bundle.stage(spark, where, "s", make(1)).count() == 9
    a = spark.createDataFrame([(1, "x"), (2, None)], "i long, t string")
    assert bundle.digest(a) == bundle.digest(a.orderBy(F.desc("i")).select("t", "i"))
    assert len({bundle.digest(d) for d in (a, a.unionByName(a), a.limit(1), a.select("i"), a.select("t", F.col("i").alias("j")), a.limit(0))}) == 6


def test_authors_are_masked_with_one_run_of_the_detector(spark):
    df = spark.createDataFrame([(1, "7", "write to a@b.example"), (2, "7", "again A@B.example!")], "id long, author string, text string")
    plan = privatize.author_group_mask(df, "author", "text", "id")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("ArrowEvalPython") + physical.count("BatchEvalPython") <= 2  # the masks alone


def test_signs_hide_no_identifier(spark):
    from cloakframe import resources as R
    from cloakframe.functions import text as T

    texts = ["a@b.example", "see http://x.example", "10.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "+1 (555) 010-9999", "5550109999", "nothing", "", None, "1.2", "12345678"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = T.guard_counts(F.col("t"))
    plain = {n: F.regexp_count("t", F.lit(T.ascii_bounds(p))) for n, p in R.GUARD}
    for n in counted:
        assert [r[0] for r in df.select(counted[n]).collect()] == [r[0] for r in df.select(plain[n]).collect()], n
