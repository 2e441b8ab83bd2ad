"""More of the engine's queries: row identity, verification, low-impact masks, restatements."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe import resources as R
from cloakframe.functions import text as T
from cloakframe.operators import lowimpact, privatize, restate, rows, verify
from cloakframe.plans.queries import _DRIFT, _EFFECT, _IMP, _RATES, _SCORED, _TF, _TOK, _drifted, _list, _masked_sql, _q, _scored, query, table


@query("SELECT coalesce(nullif(trim(doc_id::varchar), ''), (doc_id + 1)::varchar) AS row_id, substr(sha256(coalesce(source, '')), 1, 12) AS hash, length(coalesce(source, '')) AS length, trim(coalesce(source, '')) = '' AS blank FROM documents")
def report_rows(spark, d):
    """Row ids for reports, with a summary of the source that does not show it."""
    s = T.safe_value_summary(F.col("source"))
    return table(spark, d, "documents").select(rows.report_row_id("doc_id", F.col("doc_id") + 1).alias("row_id"), s.alias("s")).select("row_id", "s.*")


@query(r"SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(trim(text, ' '), '[ \t\n\r\f]+'), 1, 32), ' ') AS excerpt FROM documents")
def demo_excerpts(spark, d):
    """The first 32 words of each text."""
    return table(spark, d, "documents").select("doc_id", rows.excerpt(F.col("text")).alias("excerpt"))


@query("""SELECT page_id, 'case-' || lpad(to_hex(list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(url, ''), lambda c: ord(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0') AS case_id FROM pages""".replace("to_hex(", "lower(to_hex(").replace(")), 8", "))), 8"))
def public_case_ids(spark, d):
    return table(spark, d, "pages").select("page_id", rows.public_case_id(F.col("url")).alias("case_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id + 1 BETWEEN 101 AND 150")
def row_window(spark, d):
    """Rows 101 to 150 by position (OFFSET and LIMIT)."""
    df = table(spark, d, "documents").select("doc_id", "source").withColumn("i", F.col("doc_id") + 1)
    return rows.window(df, "i", 100, 50).drop("i")


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'blog') OR contains(lower(html), '<h1>the')")
def triage_search(spark, d):
    """Substring search over several fields."""
    p = table(spark, d, "pages")
    return p.where(rows.matches_search("BLOG", p.url) | rows.matches_search("<h1>the", p.html)).select("page_id")


_AB = "user_id, event_id AS a, event_id + 1 + abs(round(coalesce(value, 0)))::bigint AS b"


@query(f"WITH l AS (SELECT {_AB}, event_type FROM events), r AS (SELECT * FROM l WHERE event_type = 'purchase') SELECT user_id, a, b FROM l WHERE event_type <> 'purchase' AND EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND l.a < r.b AND r.a < l.b)")
def interval_overlap_semi_join(spark, d):
    """Intervals that overlap a protected one of the same group (theta semi-join)."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 1 + F.abs(F.round(F.coalesce("value", F.lit(0.0)))).cast("long")).alias("b"), "event_type")
    return rows.overlap_semi(e.where("event_type <> 'purchase'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), ["user_id"], "a", "b")


_CASE = "CASE WHEN toxic = 1 AND p THEN 'TP' WHEN toxic = 1 THEN 'FN' WHEN p THEN 'FP' ELSE 'TN' END"


@query(f"""WITH s AS (SELECT doc_id, toxic, score >= 0.5 AS predicted, {_CASE.replace(' p ', ' (score >= 0.5) ')} AS case_type FROM ({_SCORED}) WHERE toxic IN (0, 1)),
 r AS (SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY sha256(doc_id::varchar)) AS r FROM s) SELECT doc_id, toxic, predicted, case_type FROM r WHERE r <= CASE case_type WHEN 'FP' THEN 60 WHEN 'FN' THEN 60 ELSE 20 END""")
def evaluation_set(spark, d):
    """Up to 60 wrong and 20 right cases of each kind, by hashed id (a sampling operator)."""
    s = _scored(spark, d).withColumn("predicted", F.col("score") >= 0.5).select("doc_id", "toxic", "predicted")
    return verify.evaluation_set(s, "toxic", "predicted", "doc_id")


def _decision(key: str):
    k = F.col(key)
    return F.when(k % 7 == 0, "disagree").when(k % 11 == 0, "uncertain").otherwise("agree")


_VERIFIED = f"SELECT doc_id, toxic, score >= 0.5 AS p, CASE WHEN doc_id % 7 = 0 THEN 'disagree' WHEN doc_id % 11 = 0 THEN 'uncertain' ELSE 'agree' END AS decision FROM ({_SCORED})"


@query(f"""WITH v AS ({_VERIFIED}), x AS (SELECT toxic, unnest(['none', 'positives', 'both']) AS strategy, p, decision = 'disagree' AS off FROM v),
 y AS (SELECT strategy, toxic, CASE strategy WHEN 'none' THEN p WHEN 'positives' THEN p AND NOT off ELSE p <> off END AS q FROM x),
 c AS (SELECT strategy, count(*) FILTER (toxic=1 AND q) AS tp, count(*) FILTER (toxic<>1 AND q) AS fp, count(*) FILTER (toxic=1 AND NOT q) AS fn, count(*) FILTER (toxic<>1 AND NOT q) AS tn FROM y GROUP BY strategy) SELECT *, {_RATES} FROM c""")
def verifier_strategies(spark, d):
    """What each way of using a verifier's decisions does to the metrics; the decisions are made up from the id."""
    return verify.compare_strategies(_scored(spark, d), F.col("toxic") == 1, F.col("score") >= 0.5, _decision("doc_id"))


@query(f"SELECT doc_id, CASE decision WHEN 'agree' THEN 'keep' WHEN 'disagree' THEN 'flip' ELSE 'human_review' END AS action FROM ({_VERIFIED}) WHERE p AND decision <> 'agree'")
def verifier_routes(spark, d):
    """Positives that go to the large model, and what the verifier asks for; the decisions are made up from the id."""
    s = _scored(spark, d)
    return s.where(verify.routed(F.col("score") >= 0.5, _decision("doc_id"), F.lit(False), "positives")).select("doc_id", verify.action(_decision("doc_id")).alias("action"))


@query("""WITH h AS (SELECT doc_id, toxic, sha256(doc_id::varchar) AS h FROM labels), a AS ((SELECT * FROM h WHERE toxic = 1 ORDER BY h LIMIT 1) UNION ALL (SELECT * FROM h WHERE toxic <> 1 ORDER BY h LIMIT 1)),
 b AS (SELECT * FROM h WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY h LIMIT 3) SELECT doc_id, toxic FROM a UNION ALL SELECT doc_id, toxic FROM b""")
def review_draw(spark, d):
    """Five rows to review, both labels among them (a sampling operator)."""
    return verify.draw_review(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", F.col("toxic") == 1)


@query(f"""WITH c AS ({_TF}), m AS (SELECT token, arg_max(author, (tf, author)) AS author, round(max(tf)::double / sum(tf), 6) AS concentration FROM c GROUP BY token HAVING sum(tf) >= 2),
 k AS (SELECT * FROM m WHERE length(token) >= 7 AND concentration >= 0.75 AND token NOT IN (SELECT unnest({_list(lowimpact.NEVER)}))),
 d AS (SELECT DISTINCT doc_id AS key, source, unnest({_TOK}) AS token FROM documents), i AS (SELECT DISTINCT key, token FROM ({_IMP}) WHERE abs(baseline - masked) > 0.003),
 h AS (SELECT d.key, d.token, concentration FROM d JOIN k ON d.token = k.token AND d.source = k.author WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.key = d.key AND i.token = d.token)),
 r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY concentration DESC, token) AS rank FROM h) SELECT * FROM r WHERE rank <= 2""")
def low_impact_tokens(spark, d):
    """Tokens that mark a source and do not matter to the score, two for each text at most (the operator's limit)."""
    return lowimpact.choose(table(spark, d, "documents"), "doc_id", "source", "text")


@query()
def low_impact_mask(spark, d):
    return lowimpact.masked(table(spark, d, "documents"), "doc_id", "source", "text")


@query()
def semantic_clusters(spark, d):
    return lowimpact.clusters(table(spark, d, "embeddings"), "vec_id", "embedding", "label")


_CUT = _masked_sql("text")
_TOK2 = _TOK.replace("lower(text)", f"lower({_CUT})")


@query(f"""SELECT doc_id, round(lr, 6) AS length_ratio, round(j, 6) AS similarity, lr BETWEEN 0.35 AND 1.8 AND j >= 0.82 AND trim({_CUT}) <> '' AS ok FROM (SELECT doc_id, text,
 CASE WHEN length(text) = 0 THEN 1 ELSE length({_CUT})::double / length(text) END AS lr,
 CASE WHEN len(list_distinct(list_concat({_TOK}, {_TOK2}))) = 0 THEN 1 ELSE len(list_intersect(list_distinct({_TOK}), list_distinct({_TOK2})))::double / len(list_distinct(list_concat({_TOK}, {_TOK2}))) END AS j FROM documents)""")
def restatement_gate(spark, d):
    """Whether a masked copy would pass as a restatement."""
    return table(spark, d, "documents").select("doc_id", *restate.gate(F.col("text"), T.guard_mask(F.col("text"))))


_MAIL = R.GUARD[0][1]
_REST = _masked_sql("text", R.GUARD[1:])


@query(f"SELECT doc_id, len(list_filter(list_distinct(list_transform(regexp_extract_all(text, {_q(_MAIL)}), lambda x: lower(x))), lambda x: contains(lower({_REST}), x))) AS n_leaks FROM documents")
def identifier_leaks(spark, d):
    """E-mail addresses of each text that a copy masked for other identifiers still holds."""
    return table(spark, d, "documents").select("doc_id", F.size(restate.leaks(F.col("text"), T.guard_mask(F.col("text"), R.GUARD[1:]), _MAIL)).cast("long").alias("n_leaks"))


_TEMPLATES = ["template one", "template two", "template three"]


@query(f"SELECT doc_id, CASE WHEN toxic = 1 THEN {_list(_TEMPLATES)}[(('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 3)::int + 1] ELSE 'neutral' END AS templated FROM labels")
def label_templates(spark, d):
    return restate.templated(table(spark, d, "labels"), "doc_id", F.col("toxic") == 1, _TEMPLATES, "neutral").select("doc_id", "templated")


@query(f"""{_EFFECT}, p AS (SELECT *, max(delta) OVER (PARTITION BY key) AS best FROM imp WHERE delta >= 0.03), a AS (SELECT key, token_index, row_number() OVER (PARTITION BY key ORDER BY delta DESC, token_index) AS r FROM p WHERE delta >= 0.25 * best),
 w AS (SELECT i.key, i.token_index, i.token FROM imp i JOIN a ON i.key = a.key AND a.r <= 3 AND i.token_index BETWEEN a.token_index - 2 AND a.token_index + 2 GROUP BY ALL), e AS (SELECT key, string_agg(token, ' ' ORDER BY token_index) AS phrase FROM w GROUP BY key),
 s AS (SELECT doc_id, round(least(0.99::double, 0.15::double + 0.3::double * len(list_intersect(list_distinct({_TOK}), {_list(R.SCORE_TERMS)}))), 6) >= 0.5 AS p FROM documents)
SELECT doc_id, p AS predicted, CASE WHEN p AND phrase IS NOT NULL THEN phrase || '.' ELSE 'none' END AS rewritten FROM s LEFT JOIN e ON s.doc_id = e.key""")
def evidence_rewrite(spark, d):
    """Positives become their evidence phrase."""
    return restate.evidence_rewrite(table(spark, d, "documents"), "doc_id", "text", F.lit("none"))


@query(f"SELECT deviation_risk, count(*) AS n, sum(deviation_score)::bigint AS score, sum(len(list_filter(string_split(lost_terms, '|'), lambda x: x <> '')))::bigint AS lost FROM ({_DRIFT}) GROUP BY 1")
def audit_summary(spark, d):
    """Risk counts of the drift audit."""
    a = _drifted(spark, d)
    return a.groupBy("deviation_risk").agg(F.count("*").alias("n"), F.sum("deviation_score").cast("long").alias("score"), F.sum(F.size(rows.split_pipe(F.col("lost_terms")))).cast("long").alias("lost"))


@query("SELECT source, max(n) > 1 AS repeats FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) GROUP BY source")
def author_risk(spark, d):
    """Authors with more than one row."""
    return table(spark, d, "documents").groupBy("source").agg((F.count("*") > 1).alias("repeats"))


@query("SELECT role, count(*) AS turns, round(avg(length(text)), 4) AS mean_chars, sum(CASE WHEN trim(text) = '' THEN 1 ELSE 0 END)::bigint AS blank FROM conversations GROUP BY role")
def role_summary(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.round(F.avg(F.length("text")), 4).alias("mean_chars"), F.sum(F.when(F.trim("text") == "", 1).otherwise(0)).cast("long").alias("blank"))




def _form_sql(kind: str) -> str:
    n = " + ".join(f"len(regexp_extract_all(text, {_q('(?i)' + p)}))" for p in privatize.FORMS[kind])
    return f"SELECT '{kind}' AS entity_type, coalesce(sum({n}), 0)::bigint AS n, count(*) FILTER ({n} > 0) AS n_rows FROM documents"


@query(" UNION ALL ".join(map(_form_sql, privatize.FORMS)))
def identifier_form_counts(spark, d):
    """The detectors' plain forms over all texts, by type."""
    counts = privatize.form_counts(F.col("text"))
    rows = table(spark, d, "documents").select(F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), n.alias("n")) for k, n in counts.items()))).alias("x")).select("x.*")
    return rows.groupBy("entity_type").agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("n_rows"))


_ADDRESSES = f"regexp_extract_all(text, {_q(_MAIL)})"


@query(f"""WITH v AS (SELECT doc_id, source, list_distinct({_ADDRESSES}) AS vs, text FROM documents), f AS (SELECT DISTINCT source, doc_id, regexp_replace(lower(x), '[^a-z0-9]', '', 'g') AS n FROM (SELECT source, doc_id, unnest(vs) AS x FROM v)),
 r AS (SELECT source, n FROM f GROUP BY ALL HAVING count(*) > 1),
 h AS (SELECT doc_id, list(x ORDER BY length(x) DESC, x) AS xs FROM (SELECT doc_id, source, unnest(vs) AS x FROM v) JOIN r USING (source) WHERE n = regexp_replace(lower(x), '[^a-z0-9]', '', 'g') GROUP BY doc_id)
SELECT doc_id, source, CASE WHEN xs IS NULL THEN text ELSE list_reduce(list_prepend(text, xs), lambda t, x: regexp_replace(t, '\b' || regexp_escape(x) || '\b', '[EMAIL]', 'g')) END AS text FROM v LEFT JOIN h USING (doc_id)""")
def author_group_mask_mail(spark, d):
    """Addresses that a source has in two rows or more, masked wherever they stand in those."""
    found = F.transform(F.regexp_extract_all("text", F.lit(T.ascii_bounds(_MAIL)), F.lit(0)), lambda x: F.struct(F.lit("EMAIL").alias("entity_type"), x.alias("text")))
    return privatize.author_group_mask(table(spark, d, "documents"), "source", "text", "doc_id", found=found).drop("n_masked")


@query()
def simple_scrub(spark, d):
    """The second scrubber over all texts."""
    s = privatize.simple_scrub(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", "s.text", "s.n")


@query()
def row_routing(spark, d):
    """Where each turn goes, and why."""
    rows = table(spark, d, "conversations").withColumn("masked", privatize.privatize(F.col("text"))["text"])
    r = privatize.row_route(F.col("text"), F.col("masked"))
    return rows.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.use_providers", "r.use_style", "r.review", "r.risk_level", F.array_join("r.risk_reasons", "|").alias("risk_reasons"), F.array_join("r.low_risk_reasons", "|").alias("low_risk_reasons"))


@query()
def strict_cleanup(spark, d):
    """What a strict second pass still masks in masked texts."""
    rows = table(spark, d, "documents").withColumn("masked", privatize.privatize(F.col("text"))["text"])
    return rows.select("doc_id", privatize.strict_cleanup(F.col("masked")).alias("c")).select("doc_id", "c.text", "c.n", F.to_json("c.counts").alias("counts"))
