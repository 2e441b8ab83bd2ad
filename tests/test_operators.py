"""Operators on small made-up tables."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cloakframe.functions import text as T
from cloakframe.operators import compare, evaluate, privatize, profile, ranking, review, signals
from cloakframe.plans import protect
from cloakframe.sources import files, services


def test_exact_csv_round_trip(spark, tmp_path):
    source, target, manifest = (str(tmp_path / x) for x in ("in.csv", "out.csv", "run.json"))
    body = 'id,text,label,meta\r\n1,"hi, mail a@b.example\nnow",1,x\r\n2,,0,\r\n3,"say ""no""",0,é\r\n'
    open(source, "w", encoding="utf-8", newline="").write(body)
    rows = files.read_csv(spark, source)
    assert [tuple(r) for r in rows.orderBy("row_index").collect()] == [("1", "hi, mail a@b.example\nnow", "1", "x", 1), ("2", "", "0", "", 2), ("3", 'say "no"', "0", "é", 3)]
    done = protect.run(spark, source, target, manifest=manifest)
    assert open(target, encoding="utf-8", newline="").read() == body.replace("a@b.example", "[EMAIL]")
    assert done["rows"] == 3 and done["changed"] == 1 and not done["reused"]
    assert protect.run(spark, source, target, manifest=manifest)["reused"]
    open(tmp_path / "bad", "wb").write(b"ab\xff")
    with pytest.raises(ValueError, match="byte 2"):
        files.assert_utf8(str(tmp_path / "bad"))


def test_columns_are_found():
    assert protect.pick(["id", "Body_Text", "hs"], None, protect.TEXT_NAMES) == "Body_Text"
    assert protect.pick(["a", "my_comment_x"], None, protect.TEXT_NAMES) == "my_comment_x"
    assert protect.pick(["a"], "b", protect.TEXT_NAMES) is None


def test_validation_finds_each_issue(spark):
    a = spark.createDataFrame([(1, "x", "t", "m"), (2, "y", "t", "m"), (3, "z", "t", None)], "row_index long, id string, text string, meta string")
    b = spark.createDataFrame([(1, "x", "u", "m"), (2, "q", "t", "n"), (4, "z", "t", None)], "row_index long, id string, text string, meta string")
    got = {r.code: r.n for r in compare.validate_exact(a, b.withColumn("more", F.lit(1)), "row_index", ["text"], "id").collect()}
    assert got == {"extra_column": 1, "row_missing": 1, "row_extra": 1, "metadata_changed": 1, "text_changed": 1, "id_changed": 1}
    assert compare.validate_exact(a, a, "row_index", ["text"], "id").count() == 0


def test_author_groups(spark):
    rows = [(1, "7", "write to a@b.example"), (2, "7", "again A@B.example!"), (3, "8", "write to c@d.example"), (4, "7", None), (5, None, "x@y.example"), (6, None, "x@y.example z")]
    df = spark.createDataFrame(rows, "id long, author string, text string")
    got = {r.id: (r.text, r.n_masked) for r in privatize.author_group_mask(df, "author", "text", "id").collect()}
    assert got[1] == ("write to [EMAIL]", 1) and got[2] == ("again [EMAIL]!", 1) and got[3] == ("write to c@d.example", 0) and got[4][1] == 0
    assert got[5][1] == got[6][1] == 1


def test_scalar_functions(spark):
    df = spark.createDataFrame([("It's a hate-crime, HATE it", [1.0, 2.0], [2.0, 4.0])], "t string, a array<double>, b array<double>")
    r = df.select(
        T.normalize_text(F.col("t")).alias("n"), T.counts_for_terms(F.col("t"), ["hate", "it", "x"]).alias("c"), T.cosine(F.col("a"), F.col("b")).alias("cos"), T.contains_phrase(F.col("t"), F.lit("hate crime")).alias("p"),
        T.counter_positive_delta(F.create_map(F.lit("a"), F.lit(3), F.lit("b"), F.lit(1)), F.create_map(F.lit("a"), F.lit(1), F.lit("c"), F.lit(5))).alias("d"), T.value_hash(F.lit("x")).alias("h"), T.softmax(F.col("a")).alias("s"),
        T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"), T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("j0"), T.is_hate_label(F.lit(" Yes ")).alias("y"), T.retention(F.lit(0), F.lit(0)).alias("keep"),
    ).first()
    assert r.n == "it s a hate crime hate it" and r.c == {"hate": 2, "it": 2} and abs(r.cos - 1) < 1e-12 and r.p and r.d == {"a": 2, "b": 1} and len(r.h) == 12
    assert abs(sum(r.s) - 1) < 1e-12 and r.j == 0.5 and r.j0 == 1 and r.y and r.keep == 1


def test_rank_and_folds_on_one_group(spark):
    df = spark.range(2000).withColumn("g", F.lit("all"))
    ranks = sorted(r["rank"] for r in ranking.hashed_rank(df, "g", F.col("id")).select("rank").collect())
    assert ranks == list(range(2000))
    folds = ranking.stratified_kfold(df, "g", F.col("id"), 7).groupBy("fold").count().collect()
    assert {r["count"] for r in folds} <= {285, 286} and len(folds) == 7


def test_metrics_on_empty_and_one_sided(spark):
    df = spark.createDataFrame([], "gold boolean, p boolean")
    r = evaluate.classification_metrics(df, F.col("gold"), F.col("p")).first()
    assert (r.tp, r.f1, r.accuracy) == (0, 0, 0)
    one = spark.createDataFrame([(True, 0.2), (False, 0.9), (True, 0.9)], "gold boolean, s double")
    assert evaluate.best_threshold(one, F.col("gold"), "s").first().threshold == 0.2


def test_profile_and_intervals(spark):
    df = spark.createDataFrame([("a",), ("A ",), ("",), (None,), ("b",)], "t string")
    r = profile.duplicates(df, "t").first()
    assert (r.n_rows, r.blank_rows, r.unique_values, r.duplicate_groups, r.duplicate_rows) == (5, 2, 2, 1, 2)
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (2, 1, 2)], "g int, a int, b int")
    assert sorted(tuple(r) for r in signals.interval_merge(spans, ["g"], "a", "b").collect()) == [(1, 0, 5, 2), (1, 7, 9, 2), (2, 1, 2, 1)]


def test_training_frame(spark):
    rows = spark.createDataFrame([("a b", 1), ("A  B!", 1), ("c", 1), ("c", 0), ("held out", 1), ("", 1)], "text string, label int")
    held = spark.createDataFrame([("Held, out",)], "x string")
    assert [r.label for r in review.training_frame(rows, "text", "label", held, "x").collect()] == [1]


def test_services_retry_and_fall_back(spark):
    def factory():
        def call(texts):
            if "bad" in texts or len(texts) > 3:
                raise ValueError
            return [t.upper() for t in texts]

        return call

    df = spark.createDataFrame([("a",), ("bad",), ("c",), (None,)], "t string").coalesce(1)
    got = services.apply_service(df, "t", factory, "u", rows=2, retries=0).collect()
    assert [(r.u, r.status) for r in got] == [("A", "retried"), (None, "failed"), ("C", "ok"), ("", "ok")]
    assert list(services.batches(["aa", "b", "cccc", "d"], 2, 3)) == [["aa", "b"], ["cccc"], ["d"]]


def test_predictions_by_key_or_place(spark):
    rows = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "k string, i long")
    found = spark.createDataFrame([("x", 9, 0.1), (None, 2, 0.2)], "k string, i long, p double")
    assert {r.k: r.p for r in services.with_predictions(rows, found, "k", "i", ["p"]).collect()} == {"x": 0.1, "y": 0.2, "z": None}


def test_cache_keeps_the_last_record(spark, tmp_path):
    path = str(tmp_path / "cache")
    files.append_cache(spark.createDataFrame([("a", 1, "old"), ("b", 1, "x")], "id string, seq long, v string"), path)
    files.append_cache(spark.createDataFrame([("a", 2, "new")], "id string, seq long, v string"), path)
    assert {r.id: r.v for r in files.read_cache(spark, path, "id string, seq long, v string", "id").collect()} == {"a": "new", "b": "x"}


def test_forms_are_tried_where_their_sign_is(spark):
    """Each form has a sign that every match holds; the counts are those of the forms alone."""
    rng = random.Random(3)
    bits = [*"http:// HXXPS://a.b www. wWw.x @ a@b.co .c@d.ef é _ - / 12 3 2020 1/2/2020 12-3-99 jan Sept 5, 2001 I am i'm aged 44 years old 7-year-old 12 Year id ID-7 case# ref: A-1 user_9 ( ) .".split(), "\n", *[" "] * 25]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(40)))) for k in range(2000)] + [(-1, None), (-2, "")]
    forms = {p for ps in privatize.FORMS.values() for p in ps}
    assert set(privatize._SIGNS) == forms
    for p in forms:
        assert all(re.search(privatize._SIGNS[p][0], m[0]) for _, t in rows for m in re.finditer(p, t or "", re.I | re.A))
    plain = {k: sum((F.coalesce(F.regexp_count("text", F.lit("(?i)" + T.ascii_bounds(p))), F.lit(0)) for p in ps), F.lit(0)) for k, ps in privatize.FORMS.items()}
    df = spark.createDataFrame(rows, "k long, text string")
    got = df.agg(*(F.sum(n).alias(k) for k, n in privatize.form_counts(F.col("text")).items()), *(F.count_if(n != plain[k]).alias(f"bad_{k}") for k, n in privatize.form_counts(F.col("text")).items())).first()
    assert all(got[k] > 0 and got[f"bad_{k}"] == 0 for k in privatize.FORMS)
