"""Providers, guarded rewriting and SQL functions."""

from cloakframe.operators import privatize
from cloakframe.spans import detect as D
from cloakframe.spans import providers, rewrite


def test_providers():
    ner = lambda text: [D.Span(0, 3, "PERSON", text[:3], 0.9, "x")]
    found, status = providers.load(["ner", "ner", "none", "gone", "bad"], {"ner": lambda: ner, "gone": providers.from_library("no_such_module", lambda: ner), "bad": lambda: 1 / 0})
    assert list(found) == ["ner"] and status == {"ner": "ready", "none": "unknown", "gone": "missing", "bad": "failed"}
    spans, audit = providers.propose("Ann wrote to a@b.example", found | {"broken": lambda t: 1 / 0})
    assert [(s.text, s.source) for s in spans] == [("Ann", "ner"), ("a@b.example", "regex")] and audit["errors"] == ["broken"] and audit["proposed"] == {"ner": 1}


def test_rewrite():
    text = "The peculiar gentleman should attack [PERSON] with extraordinary haste"
    predict = lambda t, a, b: {"peculiarity": 5.0, "gentle": 4.0, "attack": 9.0, t[a:b]: 9.0}
    new, audit = rewrite.rewrite(text, predict, seed=3)
    assert rewrite.rewrite(text, predict, seed=3) == (new, audit) and "[PERSON]" in new and "should attack" in new
    assert rewrite.rewrite("", predict) == ("", {"changed": 0, "rejected": None})
    assert rewrite.sanitized("gentleman", "gentle") == "gentle" and rewrite.sanitized("Gentleman", "gentlemen") == "Gentlemen"
    assert rewrite.sanitized("gentleman", "attack") is None and rewrite.sanitized("gentleman", "x1") is None
    assert all(not rewrite.protected(rewrite.tokens(text)[i][2]) for i in rewrite.eligible(text, 9))


def test_sql_functions(spark):
    privatize.register(spark)
    spark.createDataFrame([(1, "mail a@b.example"), (2, None)], "id int, t string").createOrReplaceTempView("texts")
    assert [tuple(r) for r in spark.sql("select id, privatize_text(t), count_identifiers(t) from texts order by id").collect()] == [(1, "mail [EMAIL]", 1), (2, "", 0)]
    assert [(r.id, r.entity_type, r.start) for r in spark.sql("select id, s.* from texts, lateral detect_spans(t) s").collect()] == [(1, "EMAIL", 5)]
