"""Queries of whole-table mechanisms: exact CSV, scores out of fold, grids of metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakframe import resources as R
from cloakframe.functions import text as T
from cloakframe.operators import clusters, evaluate, oof, sketches, terms
from cloakframe.plans.queries import _RATES, _SCORE, _TOK, ORACLE, _count_sql, _list, query, table
from cloakframe.sources import exact_csv, shared
from cloakframe.sources.keyed import KeyedCache


@query("SELECT row_number() OVER (ORDER BY doc_id, text)::bigint AS row_index, doc_id::varchar AS doc_id, coalesce(source, '') AS source, coalesce(text, '') AS text, '' AS note FROM documents")
def csv_round_trip(spark, d):
    """All documents as one exact CSV file and back, with row numbers in file order."""
    path = f"{shared.folder(spark)}/documents.csv"
    exact_csv.write(table(spark, d, "documents"), path, ["doc_id", "source", "text", "note"], index="doc_id")
    return exact_csv.read(spark, path, range_bytes=1 << 20)


_SETS = [["model", "dataset", "split", "rule"], ["model", "dataset", "rule"], ["model", "rule"], ["rule"]]
_PREDICTED = f"""SELECT doc_id, source AS dataset, lang AS split, toxic, quality, unnest([{{'m': 'keywords_low', 'p': s >= 0.3}}, {{'m': 'keywords_high', 'p': s >= 0.6}}, {{'m': 'length', 'p': n_chars >= 2000}}]) AS m
 FROM (SELECT doc_id, source, lang, n_chars, toxic, quality, {_SCORE} AS s FROM documents JOIN labels USING (doc_id))"""


@query(f"""WITH p AS ({_PREDICTED}), u AS (SELECT dataset, split, m.m AS model, m.p AS p, unnest([{{'rule': 'toxic', 'g': toxic = 1}}, {{'rule': 'poor', 'g': quality = 0}}]) AS u FROM p), r AS (SELECT dataset, split, model, p, u.rule AS rule, u.g AS g FROM u),
 c AS (SELECT model, dataset, split, rule, GROUPING(model, dataset, split, rule)::int AS level, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g AND p) AS fp, count(*) FILTER (g AND NOT p) AS fn, count(*) FILTER (NOT g AND NOT p) AS tn
 FROM r GROUP BY GROUPING SETS ((model, dataset, split, rule), (model, dataset, rule), (model, rule), (rule))) SELECT *, {_RATES} FROM c""")
def evaluation_grid(spark, d):
    """Three models on all sources and languages under two label rules, with subtotals."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("s", T.keyword_score(F.col("text")))
    models = {"keywords_low": F.col("s") >= 0.3, "keywords_high": F.col("s") >= 0.6, "length": F.col("n_chars") >= 2000}
    rules = {"toxic": F.col("toxic") == 1, "poor": F.col("quality") == 0}
    rows = rows.select(F.col("source").alias("dataset"), F.col("lang").alias("split"), *(v.alias(f"p_{k}") for k, v in models.items()), *(v.alias(f"g_{k}") for k, v in rules.items()))
    rows = rows.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("model"), F.col(f"p_{k}").alias("p")) for k in models))).alias("m"))
    rows = rows.select("dataset", "split", "m.model", "m.p", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"g_{k}").alias("g")) for k in rules))).alias("r"), *(f"g_{k}" for k in rules))
    return evaluate.grid(rows.select("model", "dataset", "split", "p", "r.rule", "r.g"), F.col("g"), F.col("p"), _SETS)


def _out_of_fold(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return oof.scores(rows, "doc_id", "text", F.col("toxic"))


@query()
def oof_scores(spark, d):
    """Scores of a text classifier, each by the model that has not seen the row's fold."""
    return _out_of_fold(spark, d).withColumnRenamed("key", "doc_id")


@query()
def oof_threshold_sweep(spark, d):
    """Metrics of every threshold over the scores out of fold."""
    return evaluate.threshold_sweep(_out_of_fold(spark, d), F.col("label") == 1, "score")


_LISTS = {"n_utility": sorted(R.CUES["utility"]), "n_action": sorted(R.CUES["action"])}


@query("SELECT doc_id, " + ", ".join(f"({' + '.join(_count_sql('text', t) for t in ts)})::bigint AS {n}" for n, ts in _LISTS.items()) + " FROM documents")
def term_index_counts(spark, d):
    """Places of the terms of two lists in every document, from one positional index."""
    known = spark.createDataFrame([(t, n) for n, ts in _LISTS.items() for t in ts], "term string, category string")
    return terms.counts(table(spark, d, "documents"), "doc_id", "text", known, "category", list(_LISTS)).withColumnRenamed("key", "doc_id")


_NEAR = _LISTS["n_action"]


@query(f"""WITH w AS (SELECT DISTINCT unnest({_TOK}) AS word FROM documents), t AS (SELECT unnest({_list(_NEAR)}) AS term)
SELECT word, term, levenshtein(word, term)::int AS distance FROM w, t WHERE abs(length(word) - length(term)) < 2 AND levenshtein(word, term) <= 1""")
def words_near_terms(spark, d):
    """Words of the texts that are one edit from a term of hostile action, or are one."""
    words = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("word"))
    known = spark.createDataFrame([(t,) for t in _NEAR], "term string")
    return terms.within_one_edit(words, known, "word", "term").select(F.col("left").alias("word"), F.col("right").alias("term"), "distance")


@query("""WITH r AS (SELECT user_id, event_type, max(event_id) AS event_id, event_type = 'purchase' AS second FROM events GROUP BY ALL), p AS (SELECT user_id, second, max((event_id, event_type)) AS x FROM r GROUP BY ALL)
SELECT user_id, x[1] AS event_id, x[2] AS event_type FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY second DESC) = 1""")
def keyed_cache_upsert(spark, d):
    """The last record of each user in a cache by key: purchases are appended after all other events, then the log is compacted."""
    events = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id", "event_id", "event_type")
    cache = KeyedCache(spark, f"{shared.folder(spark)}/cache", "user_id long, event_id long, event_type string", "user_id")
    cache.append(events.where("event_type <> 'purchase'"))
    cache.append(events.where("event_type = 'purchase'"))
    cache.compact()
    return cache.read()


_CELLS = {"doc_id": "doc_id", "lang": "lang", "source": "source", "n_chars": "n_chars"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (trim({c}::varchar) = '') AS n_blank, min(try_cast({c}::varchar AS double)) AS least, max(try_cast({c}::varchar AS double)) AS most FROM documents" for c in _CELLS))
def merged_profiles(spark, d):
    """Profiles of the parts of a table (its languages), stored and merged: what is exact in them."""
    docs, where = table(spark, d, "documents"), shared.folder(spark)
    for k, part in enumerate([F.col("lang") == "en", ~F.coalesce(F.col("lang") == "en", F.lit(False))]):
        sketches.append(docs.where(part), list(_CELLS), str(k), where)
    return sketches.report(sketches.merged(spark.read.parquet(where))).select("column_name", "n_rows", "n_null", "n_blank", "least", "most")


def _token_cluster_sql(k: int = 8, rounds: int = 5, dims: int = 32) -> str:
    parts = [
        f"t AS ({ORACLE['source_tfidf_rank']})",
        "w AS MATERIALIZED (SELECT author, token, round(weight * 1000000)::bigint AS w FROM t)",
        f"g AS (SELECT token, sum(w)::bigint AS w, list_transform(range(1, length(token) + 1), lambda i: ('0x' || substr(md5(substr('<' || token || '>', i::int, 3)), 1, 4))::int % {dims}) AS g FROM w GROUP BY token HAVING sum(w) > 0)",
        f"n AS (SELECT token, w, list_transform(range({dims}), lambda d: len(list_filter(g, lambda x: x = d))) AS n FROM g)",
        "m AS (SELECT *, sqrt(list_sum(list_transform(n, lambda y: y * y))) AS norm FROM n)",
        "e AS MATERIALIZED (SELECT token, w, list_transform(n, lambda x: floor(x * 1000 / norm)::bigint) AS v FROM m)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('0:' || token), v) - 1 AS k, v AS c FROM e QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT token, any_value(w) AS w, any_value(v) AS v, min((d, k))[2] AS k FROM (SELECT token, w, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint AS d FROM e, c{i}) GROUP BY token)")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list((s // n)::bigint ORDER BY j) AS m FROM
      (SELECT k, j, sum(w::hugeint * v[j]) AS s, sum(w) AS n FROM a{i}, (SELECT unnest(range(1, {dims + 1})) AS j) GROUP BY ALL) GROUP BY k) USING (k))""")
    return f"""WITH {", ".join(parts)}, r AS (SELECT author, k AS cluster, sum(w.w) AS w, array_to_string(list_slice(list(token ORDER BY w.w DESC, token), 1, 5), ' ') AS terms FROM w JOIN a{rounds} USING (token) GROUP BY ALL)
SELECT author, cluster::int AS cluster, round(w::double / 1000000, 6) AS mass, round(w::double / (sum(w) OVER (PARTITION BY cluster))::double, 6) AS concentration, row_number() OVER (PARTITION BY author ORDER BY w DESC, cluster) AS rank, terms FROM r"""


@query(_token_cluster_sql())
def token_clusters(spark, d):
    """How much of each source's TF-IDF weight falls in each cluster of its telling tokens."""
    return clusters.author_clusters(table(spark, d, "documents"), "source", "text")
