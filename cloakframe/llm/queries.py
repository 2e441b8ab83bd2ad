"""The queries of this subpackage: one per operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.llm import balls, chaining, decontam, fim, html, jaccard, kit, lm, mixing, quality, secret, suffix, tokens, urls

END_ID = 2
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(kit.table(spark, sf_dir, "pages"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(kit.table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(kit.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(kit.table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(kit.table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(kit.table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(kit.table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(kit.table(spark, sf_dir, "documents"))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write(kit.table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, kit.scratch(spark))
    return tokens.read(files)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(kit.table(spark, sf_dir, "documents"), kit.table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fim.transform(kit.table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    again = fim.restore(F.col("output"), F.col("form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, base = F.col("spans"), [r.kind for r in secret.BASE]
    counts = [F.size(secret.of(spans, k)).cast("long").alias(f"n_{k}") for k in base]
    found = secret.scan(kit.table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    return found.select("doc_id", *counts, F.sha2(secret.written(secret.of(spans, *base)), 256).alias("base_sha256"), secret.written(spans).alias("spans"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.cluster(kit.table(spark, sf_dir, "embeddings")).drop("centroid")


def _bounded(f):
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(kit.bounded(spark), sf_dir)

    return run


_ALL = (op1_html_extraction, op2_lm_scoring, op3_mixing, op4_suffix_array_dedup, op5_ngram_jaccard_join, op6_url_filters, op7_quality_rules, op8_substring_dedup, op9_token_id_output, op10_benchmark_decontamination, op11_fill_in_middle, op12_secret_scan, op13_centroid_clustering)
QUERIES = {f.__name__: _bounded(f) for f in _ALL}


def quality_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op7: all but the method's verdict."""
    return op7_quality_rules(spark, sf_dir).drop("kept")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op3: all but what is taken."""
    rows = op3_mixing(spark, sf_dir)
    return rows.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op12: how many base spans there are of each kind, and how many bytes they have."""
    rules = [r.kind for r in secret.BASE]
    found = secret.scan(kit.table(spark, sf_dir, "documents"), rules=secret.BASE, keep_columns=["doc_id"])

    def sizes(kind):
        return F.aggregate(secret.of(F.col("spans"), kind), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])

    return found.select("doc_id", *(F.size(secret.of(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in rules), *(sizes(k).alias(f"chars_{k}") for k in rules))


QUERIES |= {f.__name__: _bounded(f) for f in (quality_rule_counts, mixing_targets, secret_counts)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_HOST = r"regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FITS = " UNION ALL ".join(f"SELECT '{h}' AS h, '{p}' AS p, '{v}' AS v" for h, p, v in RULES)


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid, round by round."""
    parts = [
        """e AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1 AS k, x AS c FROM e QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT n, any_value(vec_id) AS vec_id, any_value(x) AS x, min((d, k)) AS b FROM (SELECT n, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM e, c{i}) GROUP BY n)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(((s - ((s % w) + w) % w) // w)::BIGINT ORDER BY j) AS m FROM
      (SELECT b[2] AS k, j, sum(x[j])::BIGINT AS s, count(*) AS w FROM a{i}, (SELECT unnest(range(1, 65)) AS j) GROUP BY ALL) GROUP BY k) USING (k))""")
    last = f"a{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT vec_id, b[2]::INT AS cluster, b[1]::BIGINT AS distance, sum(b[1]) OVER (PARTITION BY b[2])::BIGINT AS cluster_inertia, sum(b[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON k = b[2]"""


_ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_LONG = {"access": r"(AKIA[A-Z0-9]+)", "hex": r"([0-9a-f]+)"}
_FOUND = "list_filter(list_zip(regexp_extract_all(coalesce(text, ''), '{0}', 0), regexp_extract_all(coalesce(text, ''), '{0}', 1)), lambda p: length(p[2]) >= {1})"
_KEPT = {"assign": _FOUND.format(_ASSIGN, 6), "access": _FOUND.format(_LONG["access"], 20), "hex": _FOUND.format(_LONG["hex"], 24)}
ORACLE = {
    "secret_counts": "SELECT doc_id, " + ", ".join([*(f"len({v}) AS n_{k}" for k, v in _KEPT.items()), *(f"coalesce(list_sum(list_transform({v}, lambda p: length(p[1]))), 0)::bigint AS chars_{k}" for k, v in _KEPT.items())]) + " FROM documents",
    "op13_centroid_clustering": _cluster_sql(),
    "op11_fill_in_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(t) AS n, sha256('1:' || coalesce(doc_id::text, '')) AS x FROM documents),
     d AS (SELECT *, ('0x' || x[1:8])::ubigint AS h1, ('0x' || x[9:16])::ubigint AS h2, ('0x' || x[17:24])::ubigint AS h3, ('0x' || x[25:32])::ubigint AS h4 FROM h),
     c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::bigint AS a, greatest(h1 % (n + 1), h2 % (n + 1))::bigint AS b,
                  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
     p AS (SELECT *, substring(t, 1, a) AS l, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS r FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || l || '<S>' || r || '<M>' || m ELSE '<S>' || r || '<P>' || l || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p""",
    "quality_rule_counts": rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
     k AS (SELECT n, i, list_slice(w, i, i + 7) AS g FROM (SELECT n, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 7)),
     r AS (SELECT n, g FROM k GROUP BY ALL HAVING count(*) > 1),
     p AS (SELECT n, count(DISTINCT i + j) AS c FROM k JOIN r USING (n, g), (SELECT unnest(range(8)) AS j) GROUP BY n),
     l AS (SELECT n, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d)
SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words,
       len(w) < 20 OR 100 * coalesce(c, 0) > 30 * len(w) AS base_failed
FROM d JOIN l USING (n) LEFT JOIN p USING (n)""",
    "mixing_targets": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
     s AS (SELECT source, sum(size)::bigint AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::int + 1] AS w FROM d GROUP BY source),
     c AS (SELECT *, 2 * source_size AS cap, 2.0 * source_size / w AS r, sum(source_size) OVER () * 1.5 AS total FROM s),
     o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY r, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY r, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, row_number() OVER (ORDER BY r, source) AS k FROM c),
     m AS (SELECT arg_min((total - before) / w_left, k) FILTER ((total - before) / w_left <= r) AS level FROM o)
SELECT doc_id, size, source_size, round(least(cap, level * w)::double, 3) AS target FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, m""",
    "op6_url_filters": f"""
WITH u AS (SELECT row_number() OVER () AS n, page_id, {_LOWER.format(_HOST)} AS host, {_HOST[:-4]}, 2) AS path FROM pages),
     r AS ({_FITS}),
     m AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
           FROM u JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (n)""",
}
