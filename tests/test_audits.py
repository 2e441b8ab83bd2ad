"""Audits, second opinions, reviewers, jobs, providers and chat answers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from cloakframe.operators import audits, lowimpact, privatize, review, verify
from cloakframe.plans import jobs
from cloakframe.sources import chat
from cloakframe.spans import detect as D
from cloakframe.spans import providers


@pytest.mark.parametrize(
    ("text", "tags"),
    [
        ("burn the synagogue of the jews", ["protected_target", "hostile_action", "threat", "missing_context"]),
        ("stop racism, stand with refugees", ["protected_target", "counterspeech"]),
        ("she said 'deport them'", ["hostile_action", "exclusion", "quoted_or_reported"]),
        ("do not attack sikhs", ["protected_target", "hostile_action", "threat", "negated_hate", "counterspeech"]),
        ("the corrupt minister should resign", ["public_interest_or_institutional_criticism"]),
        ("what an idiot", ["offensive_only_risk", "missing_context"]),
        ("they are vermin", ["hostile_action", "dehumanization", "missing_context"]),
        ("shoah survivors spoke", ["protected_target", "historical_victim_group", "missing_context"]),
        ("nice weather", []),
        (None, []),
    ],
)
def test_context(spark, text, tags):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(audits.context(F.col("t"), audits.names_target(F.col("t"))).alias("c")).first().c
    assert got.tags == tags and got.reasons == sorted(got.reasons) and len(got.reasons) == len(tags)


def test_records_and_classes(spark):
    df = spark.createDataFrame([("ann@y.example in Paris, ban sikhs",)], "t string")
    got = df.select(audits.span_records(privatize.spans(F.col("t"), True)).alias("r")).first().r
    assert [(r.entity_type, r.privacy_class, r.utility_class, r.provider) for r in got] == [("EMAIL", "direct_identifier", "none", "deterministic"), ("LOCATION", "quasi_identifier", "none", "deterministic"), ("TARGET_GROUP", "none", "hsd_target", "deterministic")]
    assert df.select(audits.provider(F.lit("ner:PERSON"))).first()[0] == "ner" and df.select(audits.privacy_class(F.lit("STYLE"))).first()[0] == "style"
    assert [r[0] for r in spark.createDataFrame([("None",), ("['none']",), ("sikhs",), (None,)], "t string").select(audits.has_target(F.col("t"))).collect()] == [False, False, True, False]
    many = spark.range(250)
    assert audits.limited(many, "summary", "id").count() == 100 and audits.limited(many, "row", "id").count() == 250


def test_deviation(spark):
    rows = [(1, "ban the sikhs, you idiot", "someone wants to exclude a group", True, 0.0, 0.0), (2, "all fine", "all fine", False, 1.0, 1.0), (3, "all fine", "all fine", True, 1.0, 1.0), (4, "that idiot, a feminist", "an insult", False, 1.0, 1.0), (5, "a moron", "hello", False, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, a string, b string, hate boolean, cat double, cue double")
    got = {r.id: r for r in audits.deviation(df, "a", "b", F.col("hate"), F.col("cat"), F.col("cue")).collect()}
    assert (got[1].deviation_score, got[1].deviation_risk) == (4 + 3 + 3 + 3, "high") and got[1].deviation_reasons == ["target_category_loss", "target_cue_loss", "target_term_loss", "offensive_cue_loss"]
    assert (got[2].deviation_risk, got[2].deviation_reasons) == ("ok", []) and got[3].deviation_reasons == ["no_heuristic_deviation"]
    assert got[4].deviation_reasons == ["context_term_loss", "offensive_cue_abstracted"] and got[4].deviation_score == 1 and got[5].deviation_reasons == ["offensive_cue_loss"]
    assert df.limit(1).select(audits.bracket_tokens(F.lit("[A] x [B] [A]")).alias("m")).first().m == {"[A]": 2, "[B]": 1}


def test_summaries(spark):
    df = spark.createDataFrame([("write x@y.example now!!!",), ("fine",), ("Paris is big lol!!",)], "t string")
    rows = df.withColumn("chosen", privatize.candidate_select(F.col("t"))).withColumn("metrics", privatize.row_metrics(F.col("t"), F.col("chosen.text")))
    s = audits.stage_summary(rows, "t").first()
    assert s.rows == 3 and s.changed_rows == 2 and s.direct_after == 0 and s.chose_balanced + s.chose_style_scrubbed + s.chose_balanced_strict + s.chose_style_scrubbed_strict == 3
    assist = audits.pii_assist({"ner": {"status": "ready", "kind": "model", "secret": 1}}, {"ner": 2}, ("ner", "filth"))
    assert assist["enabled"] and assist["component_details"]["ner"] == {"status": "ready", "load_count": 2, "kind": "model"} and assist["components"]["filth"] == "unknown"
    answers = spark.createDataFrame([("ok", True, 0.5), ("ok", True, 0.7), (None, None, None)], "status string, hate boolean, score double")
    assert {(r.status, r.decision, r.n, r.mean_score) for r in audits.counted(answers, "status", "hate", "score").collect()} == {("ok", "true", 2, 0.6), ("missing", "none", 1, None)}


def test_strategies_against_plain_counts(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.4, rng.choice(["agree", "disagree", "uncertain", None]), rng.choice([True, False, None]), rng.choice([True, False, None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "g boolean, p boolean, cue boolean, d string, s boolean, second boolean")
    got = {r.strategy: r for r in verify.evaluated(df, F.col("g"), F.col("p"), F.col("cue"), F.col("d"), F.col("s"), F.col("second"), 0.9, 0.5).collect()}
    assert set(got) == set(verify.STRATEGIES)
    for name, r in got.items():
        reach = lambda p, cue: {"positive_verifier": p, "recall_router": not p and cue, "combined_router": p or cue}[name]  # noqa: B023, E731
        routed = [d in ("disagree", "uncertain") and reach(p, cue) for g, p, cue, d, *_ in rows]
        kind = ["TP" if g and p else "FN" if g else "FP" if p else "TN" for g, p, *_ in rows]
        share = lambda k, hit: round(sum(h for h, x in zip(hit, kind) if x == k) / kind.count(k), 4)  # noqa: B023, E731
        off = [d == "disagree" for *_, d, _, _ in rows]
        assert (r.fp_rescue_rate, r.fn_rescue_rate, r.tn_route_rate, r.tp_disagree_rate, r.routed_count) == (share("FP", routed), share("FN", routed), share("TN", routed), share("TP", off), sum(routed))
        flip = [(not p) if d == "disagree" and reach(p, cue) and s is (not p) else p for g, p, cue, d, s, _ in rows]
        big = [second if go and second is not None else p for (g, p, _, _, _, second), go in zip(rows, routed)]
        for label, values in (("flip", flip), ("big", big)):
            tp = sum(g and v for (g, *_), v in zip(rows, values))
            assert r[f"{label}_tp"] == tp and r[f"{label}_precision"] == round(tp / sum(values), 4)
        assert r.selection_score == pytest.approx(2 * r.fp_rescue_rate + 1.5 * r.fn_rescue_rate - 2.5 * r.tp_disagree_rate - 1.5 * r.tn_route_rate - 0.1 - 0.1, abs=1e-4)
    best = got["positive_verifier"].asDict() | {"model": "small"}
    text = verify.recommendation_text(best, "positive_verifier", {k: 0.25 for k in ("accuracy", "precision", "recall", "f1")}, [best])
    assert "`small`, as positive verifier" in text and "accuracy 0.2500" in text
    n = verify.run_summary(df, F.col("d"), F.lit("r"), F.col("d").isNotNull()).agg(F.sum("n")).first()[0]
    assert n == 300


def test_reviewers(spark):
    stats = spark.createDataFrame([("a", 3, 1, 1, 1), ("b", 60, 20, 30, 10), ("c", 12, 7, 2, 3)], "reviewer string, total long, hate long, protected long, uncertain long")
    got = {r.reviewer: r for r in review.standings(stats).collect()}
    assert (got["a"].title, got["a"].badges, got["a"].points) == ("New Reviewer", "", 39)
    assert (got["b"].title, got["b"].badges) == ("Speech Guardian", "CS|RS|PS|HB|QC|SG") and (got["c"].title, got["c"].badges) == ("Hate Basher", "CS|RS|HB")
    assert {r.reviewer: r.total for r in review.merged_stats(stats, stats.where("reviewer = 'a'")).collect()} == {"a": 6, "b": 60, "c": 12}
    v = spark.createDataFrame([(1, 2, 1), (0, 0, 0)], "h int, n int, u int").select(*review.votes(F.col("h"), F.col("n"), F.col("u"))).collect()
    assert tuple(v[0]) == (4, "25%", "50%", "25%") and tuple(v[1]) == (0, "0%", "0%", "0%")
    raw = spark.createDataFrame([(1, None, "x", "hate", "odd"), (2, "k", None, "?", "low")], "n int, id string, text string, label string, risk string")
    got = {r.id: r for r in review.normal_item(raw, "n").collect()}
    assert (got["case-1"].protected_text, got["case-1"].restatement, got["case-1"].label, got["case-1"].risk, got["case-1"].score) == ("x", "x", "hate", "medium", 0.0)
    assert (got["k"].source, got["k"].label, got["k"].risk, got["k"].decision) == ("k", "not_hate", "low", "pending")


def test_token_reasons(spark):
    rows = [("[USER]", 9), ("LMAOOO", 9), ("sooooo", 9), ("Capital", 9), ("short", 9), ("specially", 9), ("specially", 1), ("exceptionally", 0)]
    df = spark.createDataFrame(rows, "t string, n int").withColumn("low", F.lower("t"))
    got = [r[0] for r in df.select(lowimpact.token_reason(F.col("t"), F.col("low"), F.col("n"), F.lit(0.8), F.when(F.col("n") == 0, 1).otherwise(9))).collect()]
    assert got == [None, "style_marker", "repeated_letters", None, None, "author_concentrated", None, "rare_long_token"]
    got = [r[0] for r in df.select(lowimpact.tfidf_reason(F.col("t"), F.col("low"), F.col("n"), F.lit(0.06), F.lit(25))).collect()]
    assert got[3:] == ["author_tfidf", None, "author_tfidf", None, None]
    one = lambda *x: df.where("n = 9 and t = 'specially'").select(lowimpact.cluster_reason(F.col("t"), F.col("low"), F.col("n"), F.lit(0.06), F.lit(1), *map(F.lit, x))).first()[0]
    assert one(1.0, 0.8, 1) == "semantic_cluster" and one(1.0, 0.5, 1) is None and one(1.0, 0.8, 9) is None


def test_jobs_stop_and_resume(tmp_path):
    folder = str(tmp_path)
    path = tmp_path / "a.csv"
    path.write_text("id,text\n1,x\n", encoding="utf-8")
    up = jobs.persist_upload(folder, str(path))
    options = jobs.normal_options({"textCol": "body", "idCol": "Auto", "finalScrub": False})
    assert options == {"text_col": "body", "id_col": "", "label_col": "hs", "model": "", "final_scrub": False, "allow_fallback": False}
    job = jobs.build_job(folder, up, options)
    ran = []

    def protect():
        ran.append("protect")
        assert jobs.stop(folder, job["id"], True)["status"] == "stopping"

    steps = {"profile": lambda: ran.append("profile"), "protect": protect, "importance": lambda: ran.append("importance"), "evidence": lambda: None, "audit": lambda: None}
    done = jobs.run_job(folder, job, steps, lambda: jobs.stopping(folder, job["id"]))
    assert done["status"] == "stopped" and ran == ["profile", "protect"] and jobs.decorated(done, False)["can_resume"]
    again = jobs.resume(folder, job["id"])
    assert again["status"] == "queued" and again["done"] == ["profile", "protect"]
    done = jobs.run_job(folder, again, steps | {"protect": None})
    assert done["status"] == "complete" and ran[-1] == "importance" and jobs.resume(folder, job["id"])["status"] == "complete"
    assert not jobs.decorated(done, False)["can_resume"] and jobs.stop(folder, job["id"], False)["status"] == "complete"
    assert jobs.summary(folder, done, {"outputs": {"audit": "a"}, "rows": 1})["artifacts"] == {"job": job["id"], "annotated": None, "audit": "a", "importance": None, "evidence": None, "cases": None}
    with pytest.raises(ValueError):
        jobs.stop(folder, "none", False)


def test_provider_filters():
    text = "Ann Berg met Max in Oslo on 3 May, ban sikhs today"
    at = lambda w: (text.index(w), text.index(w) + len(w))
    found = [("PERSON", *at("Ann Berg"), 0.9), ("PERSON", *at("Max"), 0.9), ("LOCATION", *at("Oslo"), 0.8), ("LOCATION", *at("met"), 0.8), ("DATE_TIME", *at("3 May"), 0.7), ("DATE_TIME", *at("today"), 0.7), ("NRP", *at("sikhs"), 0.9), ("PERSON", *at("sikhs"), 0.9), ("THING", *at("met"), 0.5), ("PERSON", 5, 900, 0.5)]
    spans, audit = providers.from_recogniser(text, found)
    assert [(s.entity_type, s.text) for s in spans] == [("PERSON", "Ann Berg"), ("LOCATION", "Oslo"), ("DATE", "3 May")]
    assert audit["rejected_counts_by_reason"] == {"invalid_offsets": 1, "location_shape": 1, "nrp_preserved": 1, "person_shape": 1, "protected_cue_overlap": 1, "transient_date": 1, "unsupported_type": 1}
    spans, audit = providers.from_filth(text, [("NameFilth", *at("Ann Berg")), ("odd", 0, 1), ("email_filth", 3, 2)])
    assert spans == [D.Span(0, 8, "PERSON", "Ann Berg", 0.7, "filth:name")] and audit["rejected_span_count"] == 2
    assert len(providers.propose_many(["a", "b"], {})) == 2 and providers.like_location("NYC") and not providers.like_location("new york")


def test_chat_answers():
    said = lambda x: {"choices": [{"message": x}]}
    body = {"items": [{"id": "1", "decision": "agree", "suggested_label": None, "reason": "ok"}]}
    call = {"tool_calls": [{"function": {"arguments": json.dumps(body)}}]}
    assert chat.answer(said(call)) == chat.answer(said({"function_call": {"arguments": body}})) == chat.answer(said({"content": f"```json\n{json.dumps(body)}\n```"})) == body
    for bad in ({}, {"choices": []}, said("x"), said({"content": "none"}), said({})):
        with pytest.raises(chat.BadAnswer):
            chat.answer(bad)
    assert chat.verifier_items(body, ["1"], ("ok",))[0]["parse_status"] == "ok"
    for ids, reasons, change in ((["2"], ("ok",), {}), (["1"], ("no",), {}), (["1", "2"], ("ok",), {}), (["1"], ("ok",), {"decision": "maybe"}), (["1"], ("ok",), {"suggested_label": "yes"})):
        with pytest.raises(chat.BadAnswer):
            chat.verifier_items({"items": [body["items"][0] | change]}, ids, reasons)
    hate = {"items": [{"id": "x", "hate": True, "reason": "ok"}, {"id": "b", "hate": False, "reason": "ok"}]}
    assert [r["id"] for r in chat.classifier_items(hate, ["a", "b"], ("ok",), positional=True)] == ["a", "b"]
    with pytest.raises(chat.BadAnswer):
        chat.classifier_items(hate, ["a", "b"], ("ok",))
    assert chat.restatements({"items": [{"id": "1", "restatement": " a \n b "}]}, ["1"])[0]["restatement"] == "a b"
    asked = []

    def service(rows):
        asked.append([r["id"] for r in rows])
        if len(rows) > 1 or rows[0]["id"] == "3":
            return said({"content": "no"})
        return said({"content": json.dumps({"items": [{"id": rows[0]["id"], "restatement": "x"}]})})

    got = chat.ask([{"id": str(k)} for k in range(1, 5)], service, chat.restatements, 2)
    assert [(r["id"], r["parse_status"]) for r in got] == [("1", "ok"), ("2", "ok"), ("3", "skipped"), ("4", "ok")] and asked == [["1", "2"], ["1"], ["2"], ["3", "4"], ["3"], ["4"]]
    assert chat.run_record(got, 8.0) == {"row_count": 4, "parse_count": 3, "parse_success_rate": 0.75, "seconds_per_row": 2.0}
    p = chat.payload("m", "s", [{"id": "1"}], chat.verifier_schema(("ok",)))
    assert p["tool_choice"]["function"]["name"] == "submit_items" and p["tools"][0]["function"]["parameters"]["properties"]["items"]["items"]["required"] == ["id", "decision", "suggested_label", "reason"]
    assert chat.hate_index({0: "non-hate", 1: "hate"}) == 1 and chat.hate_index({0: "hateful", 1: "other"}) == 0 and chat.hate_index({0: "a", 1: "b"}) == 1
