"""Row identity, verification, suggestions, jobs and bundles."""

import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import restate, rows, verify
from cloakframe.plans import bundle, jobs


def test_row_identity(spark):
    assert rows.is_sensitive("user_id") and rows.is_sensitive("screen_name") and not rows.is_sensitive("row_id")
    df = spark.createDataFrame([(" a ", 1), ("", 2), (None, 3)], "row_id string, i long")
    assert [r[0] for r in df.select(rows.report_row_id("row_id", F.col("i"))).collect()] == ["a", "2", "3"]
    assert [r[0] for r in df.select(rows.report_row_id("user_id", F.col("i"))).collect()] == ["1", "2", "3"]
    assert rows.insert_after(["a", "b", "c"], "a", ["x", "c"]) == ["a", "x", "c", "b"] and rows.insert_after(["a"], "z", ["x"]) == ["a", "x"]
    r = df.limit(1).select(rows.first_nonempty(F.lit(" "), F.lit(None), F.lit(" v ")).alias("f"), rows.split_pipe(F.lit("a| b||")).alias("p"), rows.parse_float(F.lit(" 1.5 ")).alias("x"), rows.parse_float(F.lit("no")).alias("n"), rows.public_case_id(F.lit("a")).alias("c")).first()
    assert (r.f, r.p, r.x, r.n, r.c) == ("v", ["a", "b"], 1.5, None, "case-e40c292c")


def test_overlap_semi_join(spark):
    rng = random.Random(1)
    left = [(k % 3, a := rng.randint(0, 4000), a + rng.randint(1, 700)) for k in range(200)]
    right = [(k % 3, a := rng.randint(0, 4000), a + rng.randint(1, 60)) for k in range(40)]
    schema = "g int, a int, b int"
    got = rows.overlap_semi(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["g"], "a", "b", 64).collect()
    assert sorted(map(tuple, got)) == sorted(x for x in left if any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in right))


def test_quotas():
    assert verify.allocate({"a": 2, "b": 50, "c": 50}, 30) == {"a": 2, "b": 14, "c": 14}
    assert sum(verify.allocate({"a": 1, "b": 2}, 9).values()) == 3 and verify.allocate({}, 3) == {}
    with pytest.raises(ValueError):
        verify.flipped(F.lit(True), F.lit("agree"), "none such")


def test_suggestions():
    text = "Ann went to see Bob and spoke with [PERSON] about the attack on the old bridge in the town"
    given = ["Ann", " ann ", "", "Zoe", "[PERSON]", "attack", text[:70], "Bob"]
    assert [s for _, s in restate.check_suggestions(text, given)] == ["accepted", "duplicate", "empty", "not_in_text", "placeholder", "protected_cue", "placeholder", "accepted"]


def test_jobs_resume(tmp_path):
    folder, source = str(tmp_path / "state"), tmp_path / "a.csv"
    source.write_text("id,text\n1,x\n2,y\n", encoding="utf-8")
    up = jobs.persist_upload(folder, str(source))
    assert up["rows"] == 2 and jobs.persist_upload(folder, str(source)) == up
    job = jobs.build_job(folder, up, {"style": True})
    assert jobs.build_job(folder, up, {"style": True})["id"] == job["id"] != jobs.build_job(folder, up, {})["id"]
    ran = []
    steps = {s: (lambda s=s: ran.append(s)) for s in jobs.STAGES}
    job = jobs.run_job(folder, job, steps, cancelled=lambda: len(ran) == 2)
    assert job["status"] == "stopped" and ran == list(jobs.STAGES[:2])
    job = jobs.run_job(folder, job, steps)
    assert job["status"] == "complete" and ran == list(jobs.STAGES) and jobs.latest_complete(folder)["id"] == job["id"]
    assert jobs.synced(folder, job | {"status": "running", "done": []}, alive=False)["status"] == "interrupted"
    assert jobs.run_job(folder, job | {"done": []}, {"profile": lambda: 1 / 0})["status"] == "failed"


def test_bundle_reuses_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    out = bundle.run(spark, docs, str(tmp_path), "doc_id", "text")
    assert out["protected"].count() == out["audit"].count() == out["cases"].count() == 30
    made = []
    again = bundle.stage(spark, str(tmp_path), "audit", lambda: made.append(1))
    assert again.count() == 30 and not made


def test_protect_masks_what_an_author_repeats(spark):
    from cloakframe.plans import protect

    rows = [(1, "u", "my name is Ines Moreau. Ines Moreau left"), (2, "u", "so wrote Ines Moreau"), (3, "v", "call Bo Berg and Bo Berg"), (4, None, None), (5, "w", "a 'Ines Moreau' quote")]
    df = spark.createDataFrame(rows, "row_index long, who string, text string")
    plain = {r.row_index: r.text for r in protect.protected(df, "text").collect()}
    out = protect.protected(df, "text", author="who")
    assert out.columns == df.columns
    got = {r.row_index: r.text for r in out.collect()}
    assert plain[1] == "my name is [PERSON]. Ines Moreau left" and got[1] == "my name is [PERSON]. [PERSON] left"
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in plain.items() if k != 1} and got[5] == "a 'Ines Moreau' quote"


def test_running_sums(spark):
    import random

    from cloakframe.operators import ranking

    rng = random.Random(2)
    rows = sorted({rng.random() for _ in range(3000)} | {float(k) for k in range(40)})
    made = [(x, rng.randint(0, 9), 1) for x in rows]
    df = spark.createDataFrame(made, "x double, n int, m int")
    for down in (False, True):
        order = sorted(made, reverse=down)
        expected, a, b = {}, 0, 0
        for x, n, m in order:
            a, b = a + n, b + m
            expected[x] = (a, b)
        got = ranking.running_sums(df, "x", ["n", "m"], down).collect()
        assert {r.x: (r.upto_n, r.upto_m) for r in got} == expected and {(r.all_n, r.all_m) for r in got} == {(a, b)}
    assert ranking.running_sums(df.limit(0), "x", ["n"]).count() == 0


def test_cues_are_counted_in_few_passes(spark):
    from cloakframe import resources as R
    from cloakframe.functions import text as T

    texts = ["burn down, BURNED down! attack-attack", "hates hate; not belong should leave", "", None, "shut down shut down forced out vermin_ scum"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one = sum((T.phrase_count(F.col("t"), t) for t in R.CUES["utility"]), F.lit(0))
    assert all(r.a == r.b for r in df.select(one.alias("a"), T.cue_count(F.col("t")).alias("b")).collect())
    lapping = ("a b", "b c", "c")
    both = df.limit(1).select(F.lit("a b c a b c").alias("t")).select(T.cue_count(F.col("t"), lapping).alias("n")).first().n
    assert both == 6


def test_cue_loss_and_candidates_as_columns(spark):
    from cloakframe.operators import privatize

    df = spark.createDataFrame([("write x@y.example now!!!",), ("",), (None,)], "t string")
    got = [r.c for r in df.select(privatize.candidate_select(F.col("t")).alias("c")).collect()]
    assert got[0].name == "style_scrubbed" and got[0].scores[0].terms["target_cue_retention"] == 1.0 and got[1].text == got[2].text == ""
    r = df.select(privatize.row_route(F.col("t"), F.col("t")).alias("r"), privatize.strict_cleanup(F.col("t"), True).alias("s"), privatize.simple_scrub(F.col("t")).alias("p")).collect()
    assert r[0].r.use_providers and r[0].s.text == r[0].p.text == "write [EMAIL] now!!!" and r[1].r.risk_level == "low_privacy_style_risk"
