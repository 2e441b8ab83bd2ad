"""The engine's queries on the driver tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import resources as R
from cloakframe.functions import text as T
from cloakframe.operators import compare, evaluate, knn, privatize, profile, ranking, review, signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_q, items)) + "]"


_TOK = "regexp_extract_all(lower(text), '[a-z][a-z'']+')"
_NORM = "array_to_string(regexp_extract_all(lower({}), '[a-z0-9]+'), ' ')"
_SCORE = f"round(least(0.99::double, 0.15::double + 0.3::double * len(list_intersect(list_distinct({_TOK}), {_list(R.SCORE_TERMS)}))), 6)"
_SCORED = f"SELECT doc_id, source, toxic, {_SCORE} AS score FROM documents JOIN labels USING (doc_id)"
_RATES = """round(CASE WHEN tp+fp+fn+tn=0 THEN 0 ELSE (tp+tn)::double/(tp+fp+fn+tn) END, 6) AS accuracy,
 round(((CASE WHEN tp+fn=0 THEN 0 ELSE tp::double/(tp+fn) END) + (CASE WHEN tn+fp=0 THEN 0 ELSE tn::double/(tn+fp) END))/2, 6) AS balanced_accuracy,
 round(CASE WHEN tp+fp=0 THEN 0 ELSE tp::double/(tp+fp) END, 6) AS precision, round(CASE WHEN tp+fn=0 THEN 0 ELSE tp::double/(tp+fn) END, 6) AS recall,
 round(CASE WHEN tn+fp=0 THEN 0 ELSE tn::double/(tn+fp) END, 6) AS specificity, round(CASE WHEN 2*tp+fp+fn=0 THEN 0 ELSE 2*tp::double/(2*tp+fp+fn) END, 6) AS f1"""
_CONF = """count(*) FILTER (toxic=1 AND score>=0.5) AS tp, count(*) FILTER (toxic<>1 AND score>=0.5) AS fp,
 count(*) FILTER (toxic=1 AND score<0.5) AS fn, count(*) FILTER (toxic<>1 AND score<0.5) AS tn"""


def _scored(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", "toxic", T.keyword_score(F.col("text")).alias("score"))


@query(f"WITH s AS ({_SCORED}), c AS (SELECT {_CONF} FROM s) SELECT *, {_RATES} FROM c")
def keyword_score_labels(spark, d):
    """Keyword score against gold labels: confusion counts and metrics."""
    return evaluate.classification_metrics(_scored(spark, d), F.col("toxic") == 1, F.col("score") >= 0.5)


@query(f"WITH s AS ({_SCORED}), c AS (SELECT source, {_CONF} FROM s GROUP BY source) SELECT *, {_RATES} FROM c")
def classification_by_source(spark, d):
    return evaluate.classification_metrics(_scored(spark, d), F.col("toxic") == 1, F.col("score") >= 0.5, ("source",))


_SWEEP = f"""WITH s AS ({_SCORED}), g AS (SELECT score AS threshold, count(*) FILTER (toxic=1) AS pos, count(*) FILTER (toxic<>1) AS neg FROM s GROUP BY score),
 r AS (SELECT threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
 c AS (SELECT threshold, tp::bigint AS tp, fp::bigint AS fp, (p-tp)::bigint AS fn, (n-fp)::bigint AS tn FROM r) SELECT *, {_RATES} FROM c"""


@query(_SWEEP)
def threshold_sweep(spark, d):
    return evaluate.threshold_sweep(_scored(spark, d), F.col("toxic") == 1, "score")


@query(f"WITH a AS ({_SWEEP}) SELECT * FROM a ORDER BY f1 DESC, threshold DESC LIMIT 1")
def best_threshold(spark, d):
    """The threshold with the best F1 (a top-1 report)."""
    return evaluate.best_threshold(_scored(spark, d), F.col("toxic") == 1, "score")


@query("SELECT toxic AS label, count(*) AS n, round(sum(count(*)) OVER ()::double / (2 * count(*)), 6) AS weight FROM labels GROUP BY toxic")
def class_weights(spark, d):
    return evaluate.class_weights(table(spark, d, "labels"), "toxic")


_PROFILED = ("doc_id", "text", "lang", "source", "n_chars")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (trim({c}::varchar) = '') AS n_blank, count(DISTINCT {c}) AS n_distinct FROM documents" for c in _PROFILED))
def profile_columns(spark, d):
    return profile.columns(table(spark, d, "documents"), list(_PROFILED))


def _dups(by: str) -> str:
    k, g = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH v AS (SELECT {k}CASE WHEN trim(text) <> '' THEN lower(trim(text)) END AS v, count(*) AS n FROM documents GROUP BY ALL)
SELECT {k}sum(n)::bigint AS n_rows, coalesce(sum(n) FILTER (v IS NULL), 0)::bigint AS blank_rows, count(v) AS unique_values, count(*) FILTER (v IS NOT NULL AND n > 1) AS duplicate_groups,
 coalesce(sum(n) FILTER (v IS NOT NULL AND n > 1), 0)::bigint AS duplicate_rows, coalesce(max(n) FILTER (v IS NOT NULL), 0) AS max_rows_per_value FROM v {g}"""


@query(_dups("source"))
def profile_duplicates_by_source(spark, d):
    return profile.duplicates(table(spark, d, "documents"), "text", ("source",))


@query(_dups(""))
def profile_duplicates(spark, d):
    return profile.duplicates(table(spark, d, "documents"), "text")


@query("""WITH r AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM documents WHERE n_chars IS NOT NULL),
 q AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])::double AS p) SELECT p, v AS value FROM q JOIN r ON i = round_even((n - 1) * p, 0)""")
def profile_text_quantiles(spark, d):
    return profile.quantiles(table(spark, d, "documents"), "n_chars")


@query("SELECT event_type AS value, count(*) AS n, min(event_id) AS first_seen FROM events GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 10")
def profile_top_values(spark, d):
    """The ten most frequent event types (a top-k report)."""
    return profile.top_values(table(spark, d, "events"), "event_type", "event_id")


def _masked_sql(col: str, patterns=R.GUARD) -> str:
    for name, pattern in patterns:
        col = f"regexp_replace({col}, {_q(pattern)}, '[{name}]', 'g')"
    return col


@query(f"""SELECT 'text_changed' AS code, count(*) AS n FROM documents WHERE {_masked_sql('text')} IS DISTINCT FROM text HAVING count(*) > 0""")
def validate_exact_positional(spark, d):
    """A masked copy against its source, by row position: only texts may differ."""
    docs = table(spark, d, "documents")
    masked = docs.withColumn("text", T.guard_mask(F.col("text")))
    return compare.validate_exact(docs, masked, "doc_id", ["text"])


@query(f"SELECT page_id, {_masked_sql('html')} AS masked, {_masked_sql('url')} AS masked_url FROM pages")
def sequential_guard_mask(spark, d):
    return table(spark, d, "pages").select("page_id", T.guard_mask(F.col("html")).alias("masked"), T.guard_mask(F.col("url")).alias("masked_url"))


@query("SELECT source, " + ", ".join(f"sum(len(regexp_extract_all(text, {_q(p)})))::bigint AS n_{n.lower()}" for n, p in R.GUARD) + " FROM documents GROUP BY source")
def identifier_counts_by_source(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(*(F.sum(c).cast("long").alias(f"n_{n.lower()}") for n, c in T.guard_counts(F.col("text")).items()))


_CUE_TERMS = ("the", "and", "of", "not", "is", "hate", "should", "must", "never")


def _count_sql(col: str, term: str) -> str:
    return f"len(regexp_extract_all(lower({col}), {_q(chr(92) + 'b' + term + chr(92) + 'b')}))"


_CUE_SQL = "SELECT doc_id, " + " + ".join(f"({_count_sql('text', t)})" for t in R.CUES["utility"]) + " AS n_cues FROM documents"


@query(_CUE_SQL)
def cue_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.cue_count(F.col("text")).cast("long").alias("n_cues"))


_SHORT_SQL = r"regexp_replace(text, '\b[Tt]he\b', '[X]', 'g')"


@query(f"""WITH c AS (SELECT doc_id, source, {" + ".join(_count_sql("text", t) for t in _CUE_TERMS)} AS b, {" + ".join(_count_sql(_SHORT_SQL, t) for t in _CUE_TERMS)} AS a FROM documents)
SELECT source, count(*) FILTER (a < b) AS rows_with_loss, round(avg(a::double / b) FILTER (b > 0), 6) AS mean_retention FROM c GROUP BY source""")
def cue_retention(spark, d):
    """Cue terms before and after a rewrite, by source."""
    total = lambda c: sum((T.phrase_count(c, t) for t in _CUE_TERMS), F.lit(0))
    rows = table(spark, d, "documents").select("source", total(F.col("text")).alias("b"), total(F.regexp_replace("text", T.ascii_bounds(r"\b[Tt]he\b"), "[X]")).alias("a"))
    return rows.groupBy("source").agg(F.sum(F.when(F.col("a") < F.col("b"), 1).otherwise(0)).cast("long").alias("rows_with_loss"), F.round(F.avg(F.when(F.col("b") > 0, F.col("a") / F.col("b"))), 6).alias("mean_retention"))


@query("SELECT conv_id, turn, " + " || ".join(f"CASE WHEN regexp_matches(lower(text), {_q(p)}) THEN '{n}|' ELSE '' END" for n, p in R.CONTEXT) + " AS tags FROM conversations")
def context_tags(spark, d):
    tags = T.context_tags(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.transform(tags, lambda t: F.concat(t, F.lit("|"))), "").alias("tags"))


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all(text, {_q(p)})) AS {n}" for n, p in R.STYLE_RISK) + " FROM documents")
def style_risk_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", *T.style_risk_counts(F.col("text")))


@query(f"SELECT doc_id, source FROM documents WHERE {_NORM.format('text')} NOT IN (SELECT {_NORM.format('text')} FROM benchmark)")
def duplicate_overlap_anti_join(spark, d):
    held = table(spark, d, "benchmark").select(F.sha2(T.normalize_text(F.col("text")), 256).alias("n")).distinct()
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "source", F.sha2(T.normalize_text(F.col("text")), 256).alias("n")).join(held, "n", "left_anti").select("doc_id", "source")


@query(f"""WITH t AS (SELECT sha256({_NORM.format('text')}) AS text_hash, toxic FROM documents JOIN labels USING (doc_id) WHERE {_NORM.format('text')} <> '')
SELECT text_hash, count(*) AS n, count(DISTINCT toxic) AS n_labels FROM t GROUP BY 1 HAVING count(*) > 1""")
def conflicting_duplicates(spark, d):
    """Texts that occur more than once, and how many labels they have."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("n", T.normalize_text(F.col("text"))).where("n <> ''")
    return rows.groupBy(F.sha2("n", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.countDistinct("toxic").alias("n_labels")).where("n > 1")


@query(f"""WITH t AS (SELECT doc_id, {_NORM.format('text')} AS n, text, toxic FROM documents JOIN labels USING (doc_id)),
 f AS (SELECT * FROM t WHERE n <> '' AND n NOT IN (SELECT {_NORM.format('text')} FROM benchmark)),
 g AS (SELECT n, min(text) AS text, min(toxic) AS toxic, max(toxic) AS hi FROM f GROUP BY n) SELECT toxic, sha256(text) AS text_hash FROM g WHERE toxic = hi""")
def training_frame(spark, d):
    """Distinct labelled texts without conflict that no held-out text equals."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("text", "toxic")
    return review.training_frame(rows, "text", "toxic", table(spark, d, "benchmark"), "text").select("toxic", F.sha2("text", 256).alias("text_hash"))


_TF = f"SELECT source AS author, token, count(*) AS tf FROM (SELECT source, unnest({_TOK}) AS token FROM documents) GROUP BY ALL"


@query(f"""WITH c AS ({_TF}), n AS (SELECT count(DISTINCT author) AS n FROM c), i AS (SELECT token, ln((1 + n)::double / (1 + count(*))) + 1 AS idf FROM c, n GROUP BY token, n),
 w AS (SELECT author, token, (1 + ln(tf)) * idf AS w FROM c JOIN i USING (token)), m AS (SELECT author, sqrt(sum(w * w)) AS norm FROM w GROUP BY author),
 s AS (SELECT author, token, round(w / norm, 6) AS weight FROM w JOIN m USING (author)),
 r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY weight DESC, token) AS rank FROM s) SELECT * FROM r WHERE rank <= 25""")
def source_tfidf_rank(spark, d):
    """The 25 tokens that mark each source most (a top-k report)."""
    return signals.author_tfidf(table(spark, d, "documents"), "source", "text")


@query(f"""WITH c AS ({_TF}) SELECT token, sum(tf)::bigint AS total, count(*) AS authors, arg_max(author, (tf, author)) AS author, round(max(tf)::double / sum(tf), 6) AS concentration FROM c GROUP BY token HAVING sum(tf) >= 2""")
def token_concentration(spark, d):
    return signals.concentration(table(spark, d, "documents"), "source", "text")


_IMP = f"""SELECT doc_id AS key, i - 1 AS token_index, t[i] AS token, round(least(0.99::double, 0.15::double + 0.3::double * k), 6) AS baseline,
 round(least(0.99::double, 0.15::double + 0.3::double * (k - CASE WHEN list_contains(h, t[i]) AND len(list_filter(h, lambda x: x = t[i])) = 1 THEN 1 ELSE 0 END)), 6) AS masked
 FROM (SELECT doc_id, t, h, len(list_distinct(h)) AS k, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, {_TOK} AS t, list_filter({_TOK}, lambda x: list_contains({_list(R.SCORE_TERMS)}, x)) AS h FROM documents))"""


@query(f"SELECT key, token_index, token, baseline, masked, round(baseline - masked, 6) AS delta, round(abs(baseline - masked), 6) AS abs_delta FROM ({_IMP})")
def token_importance(spark, d):
    """Occlusion: the keyword score of every text without each of its tokens."""
    return signals.token_importance(table(spark, d, "documents"), "doc_id", "text")


_EFFECT = f"WITH imp AS (SELECT key, token_index, token, round(baseline - masked, 6) AS delta FROM ({_IMP}))"


@query(f"""{_EFFECT}, p AS (SELECT *, max(delta) OVER (PARTITION BY key) AS best FROM imp WHERE delta >= 0.03),
 a AS (SELECT key, token_index, row_number() OVER (PARTITION BY key ORDER BY delta DESC, token_index) AS r FROM p WHERE delta >= 0.25 * best),
 w AS (SELECT i.key, i.token_index, i.token, max(a.r) AS r FROM imp i JOIN a ON i.key = a.key AND a.r <= 3 AND i.token_index BETWEEN a.token_index - 2 AND a.token_index + 2 GROUP BY ALL)
SELECT key, string_agg(token, ' ' ORDER BY token_index) AS phrase, max(r) AS n_anchors FROM w GROUP BY key""")
def evidence_window(spark, d):
    """Evidence phrases: up to three anchors of each text with two tokens on either side."""
    return signals.evidence(table(spark, d, "documents"), "doc_id", "text")


@query(f"""{_EFFECT}, r AS (SELECT key, token_index, token, delta, row_number() OVER (PARTITION BY key ORDER BY abs(delta) DESC, token DESC, token_index) AS rank FROM imp WHERE abs(delta) > 0)
SELECT * FROM r WHERE rank <= 5""")
def token_highlights_topk(spark, d):
    """The five tokens of each text with the greatest effect (a top-k report)."""
    return review.token_highlights(table(spark, d, "documents"), "doc_id", "text")


_VALUES = "|".join(f"(?:{p})" for _, p in R.GUARD[:1] + R.GUARD[2:3])


@query(f"""SELECT source AS author, value, count(*) AS n_rows FROM (SELECT DISTINCT source, doc_id, unnest(regexp_extract_all(text, {_q(_VALUES)})) AS value FROM documents) GROUP BY ALL HAVING count(*) >= 2""")
def repeated_values_by_source(spark, d):
    return signals.repeated_values(table(spark, d, "documents"), "source", "doc_id", F.regexp_extract_all("text", F.lit(T.ascii_bounds(_VALUES)), F.lit(0)))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY quality ORDER BY sha256(doc_id::varchar)) - 1 AS r FROM labels"


@query(f"SELECT doc_id, quality, toxic, (r % 5)::int AS fold FROM ({_RANKED})")
def stratified_kfold(spark, d):
    return ranking.stratified_kfold(table(spark, d, "labels"), "quality", F.col("doc_id"), 5)


@query(f"SELECT doc_id, quality, toxic FROM ({_RANKED}) WHERE r < CASE quality WHEN 1 THEN 60 ELSE 20 END")
def stratified_sample(spark, d):
    """60 good and 20 poor rows by hashed id (a sampling operator)."""
    return ranking.stratified_sample(table(spark, d, "labels"), "quality", F.col("doc_id"), {1: 60, 0: 20})


@query("""WITH v AS (SELECT DISTINCT user_id, event_id // 100 AS v FROM events), g AS (SELECT user_id, v, v - row_number() OVER (PARTITION BY user_id ORDER BY v) AS i FROM v)
SELECT user_id, min(v) AS first, max(v) AS last, count(*) AS n FROM g GROUP BY user_id, i""")
def rationale_runs(spark, d):
    """Runs of consecutive numbers in each group (gaps and islands)."""
    return signals.runs(table(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 100).cast("long").alias("v")), ["user_id"], "v")


@query("""WITH s AS (SELECT user_id, event_id AS a, event_id + 1 + abs(round(coalesce(value, 0)))::bigint AS b FROM events),
 m AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS f FROM s),
 g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def interval_merge(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + 1 + F.abs(F.round(F.coalesce("value", F.lit(0.0)))).cast("long")).alias("b"))
    return signals.interval_merge(rows, ["user_id"], "a", "b")


@query("SELECT doc_id, (('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 5)::int AS template FROM documents")
def template_hash_bucket(spark, d):
    return table(spark, d, "documents").select("doc_id", T.template_index(F.col("doc_id"), 5).alias("template"))


_HASH = "substr(sha256(coalesce(source, '')), 1, 12)"


@query(f"SELECT {_HASH} AS label, count(*) AS n FROM documents GROUP BY 1")
def safe_label_counts(spark, d):
    """Counts by hashed label, without the label itself."""
    return table(spark, d, "documents").groupBy(T.value_hash(F.coalesce("source", F.lit(""))).alias("label")).agg(F.count("*").alias("n"))


_DRIFT_TERMS = ("the", "and", "hate", "attack", "not")
_PAD = "' ' || " + _NORM + " || ' '"
_AFTER = _masked_sql(_SHORT_SQL)


def _drift_sql() -> str:
    lost = [f"(contains({_PAD.format('text')}, ' {t} ') AND NOT contains({_PAD.format(_AFTER)}, ' {t} '))" for t in _DRIFT_TERMS]
    cue = " + ".join(f"({_count_sql('{}', t)})" for t in R.CUES["utility"])
    return f"""SELECT doc_id, n * CASE WHEN toxic = 1 THEN 3 ELSE 1 END + CASE WHEN cb > ca THEN CASE WHEN toxic = 1 THEN 2 ELSE 1 END ELSE 0 END + CASE WHEN length({_AFTER}) * 2 < length(text) THEN 2 ELSE 0 END AS deviation_score, lost_terms
FROM (SELECT doc_id, text, toxic, {" + ".join(f"{x}::int" for x in lost)} AS n, array_to_string(list_filter([{", ".join(f"CASE WHEN {x} THEN '{t}' END" for x, t in zip(lost, _DRIFT_TERMS))}], lambda x: x IS NOT NULL), '|') AS lost_terms,
 {cue.replace("{}", "text")} AS cb, {cue.replace("{}", _AFTER)} AS ca FROM documents JOIN labels USING (doc_id))"""


_DRIFT = f"SELECT *, CASE WHEN deviation_score >= 5 THEN 'high' WHEN deviation_score >= 3 THEN 'medium' WHEN deviation_score >= 1 THEN 'low' ELSE 'none' END AS deviation_risk FROM ({_drift_sql()})"


def _drifted(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    after = T.guard_mask(F.regexp_replace("text", T.ascii_bounds(r"\b[Tt]he\b"), "[X]"))
    return review.drift(rows, F.col("text"), after, F.col("toxic") == 1, list(_DRIFT_TERMS), ["doc_id"])


@query(_DRIFT)
def drift_score(spark, d):
    """What a masked copy without its articles loses of each labelled text."""
    return _drifted(spark, d)


@query(f"""{_EFFECT}, h AS (SELECT key, token, row_number() OVER (PARTITION BY key ORDER BY abs(delta) DESC, token DESC, token_index) AS r FROM imp WHERE abs(delta) > 0),
 t AS (SELECT key, string_agg(token, '|' ORDER BY r) AS highlights FROM h WHERE r <= 5 GROUP BY key), a AS ({_DRIFT})
SELECT d.doc_id, d.source, a.deviation_score, a.deviation_risk, a.lost_terms, t.highlights FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id LEFT JOIN t ON d.doc_id = t.key""")
def review_cases(spark, d):
    """Documents with their audit and highlighted tokens; those without either stay."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return review.cases(docs, _drifted(spark, d), "doc_id", "text").select("doc_id", "source", "deviation_score", "deviation_risk", "lost_terms", "highlights")


_STATS = """SELECT user_id AS reviewer, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS hate, count(*) FILTER (event_type = 'view') AS protected, count(*) FILTER (event_type = 'click') AS uncertain FROM events GROUP BY user_id"""


@query(f"SELECT *, 10 * total + 4 * hate + 3 * protected + 2 * uncertain AS points FROM ({_STATS})")
def reviewer_stats(spark, d):
    return review.reviewer_stats(table(spark, d, "events"), "user_id", "event_type", "purchase", "view", "click")


@query(f"SELECT *, row_number() OVER (ORDER BY points DESC, reviewer) AS rank FROM (SELECT *, 10 * total + 4 * hate + 3 * protected + 2 * uncertain AS points FROM ({_STATS})) ORDER BY points DESC, reviewer LIMIT 20")
def reviewer_leaderboard(spark, d):
    """The first 20 reviewers (a top-k report)."""
    return review.leaderboard(reviewer_stats(spark, d))


@query("SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_upsert(spark, d):
    """The newest event of each user."""
    return review.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"])


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::double[] AS e FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id, round(list_dot_product(e, embedding::double[]) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(embedding::double[], embedding::double[]))), 6) AS cosine FROM q, embeddings WHERE vec_id <> query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT * FROM r WHERE rank <= 5""")
def embedding_cosine_topk(spark, d):
    """The five nearest rows of each query vector (ids divisible by 100 are the stated query set)."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return knn.cosine_topk(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 5).withColumnRenamed("id", "vec_id")


@query("SELECT event_type, k AS key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL")
def json_key_counts(spark, d):
    """Keys of JSON objects, counted by group."""
    return table(spark, d, "events").select("event_type", F.explode(F.json_object_keys("props")).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))


@query(f"""WITH t AS (SELECT conv_id, turn, list_distinct({_TOK}) AS s FROM conversations), p AS (SELECT *, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(s, b))) = 0 THEN 1 ELSE len(list_intersect(s, b))::double / len(list_distinct(list_concat(s, b))) END, 6) AS jaccard FROM p WHERE b IS NOT NULL""")
def turn_token_jaccard(spark, d):
    """Token-set Jaccard of each turn and the one before it."""
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").select("conv_id", "turn", T.token_set(F.col("text")).alias("s"))
    rows = rows.withColumn("b", F.lag("s").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("s"), F.col("b")), 6).alias("jaccard"))


@query("SELECT doc_id, 'hate' AS verdict FROM labels WHERE toxic = 1 UNION SELECT doc_id, 'poor' FROM labels WHERE quality = 0")
def routed_union(spark, d):
    """Rows routed by either rule, once each (UNION DISTINCT)."""
    rows = table(spark, d, "labels")
    return rows.where("toxic = 1").select("doc_id", F.lit("hate").alias("verdict")).union(rows.where("quality = 0").select("doc_id", F.lit("poor").alias("verdict"))).distinct()


@query("SELECT CASE WHEN toxic = 1 AND p THEN 'TP' WHEN toxic = 1 THEN 'FN' WHEN p THEN 'FP' ELSE 'TN' END AS case_type, count(*) AS n, round(avg(score), 6) AS mean_score FROM (SELECT toxic, score, score >= 0.5 AS p FROM (" + _SCORED + ")) GROUP BY 1")
def case_type_rates(spark, d):
    p, y = F.col("score") >= 0.5, F.col("toxic") == 1
    kind = F.when(y & p, "TP").when(y, "FN").when(p, "FP").otherwise("TN")
    return _scored(spark, d).groupBy(kind.alias("case_type")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query()
def privatize_documents(spark, d):
    """The flagship: identifiers masked, with counts by type and measures of what was kept."""
    docs = table(spark, d, "documents").withColumn("p", privatize.privatize(F.col("text")))
    return docs.select("doc_id", "source", F.col("p.text").alias("masked"), F.col("p.n_spans").alias("n_spans"), F.to_json("p.counts").alias("counts"))


@query()
def style_scrub(spark, d):
    s = privatize.style_scrub(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", s.alias("s")).select("conv_id", "turn", F.col("s.text").alias("scrubbed"), F.to_json("s.steps").alias("steps"))


@query()
def candidate_select(spark, d):
    c = privatize.candidate_select(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", c.alias("c")).select("conv_id", "turn", F.col("c.name").alias("name"), F.col("c.text").alias("chosen"), F.col("c.n_candidates").alias("n_candidates"))


@query()
def author_group_mask(spark, d):
    return privatize.author_group_mask(table(spark, d, "documents"), "source", "text", "doc_id")


@query()
def row_metrics_summary(spark, d):
    """Measures of every turn against its masked text, averaged."""
    rows = table(spark, d, "conversations").withColumn("masked", privatize.privatize(F.col("text"))["text"])
    return privatize.aggregate_metrics(rows.select(privatize.row_metrics(F.col("text"), F.col("masked")).alias("metrics")))


@query()
def rationale_report(spark, d):
    """Whether the first words of each turn survive masking; every turn is given the same rationale, its first three words."""
    rows = table(spark, d, "conversations").withColumn("masked", privatize.privatize(F.col("text"))["text"])
    r = privatize.rationale_report(F.lit("tokens"), F.lit("[[0, 1, 2]]"), F.col("text"), F.col("masked"))
    return rows.select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")
