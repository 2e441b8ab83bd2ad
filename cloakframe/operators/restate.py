"""Restatements: gates, leaks, templates, evidence rewrites, suggestion checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as T
from cloakframe.operators import signals
from cloakframe.spans import measure as M
from cloakframe.spans import style as S


def gate(original: Column, restated: Column, least: float = 0.35, most: float = 1.8, similarity: float = 0.82) -> list[Column]:
    """length_ratio, similarity (token sets), ok: whether a restatement is of the right length and near enough."""
    ratio = T.safe_ratio(F.length(restated), F.length(original), 1.0)
    near = T.jaccard(T.token_set(original), T.token_set(restated))
    return [F.round(ratio, 6).alias("length_ratio"), F.round(near, 6).alias("similarity"), (ratio.between(least, most) & (near >= similarity) & (F.trim(restated) != "")).alias("ok")]


def leaks(original: Column, restated: Column, pattern: str) -> Column:
    """Distinct identifiers of the original that the restatement still holds."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(original, F.lit(pattern), F.lit(0)), F.lower))
    return F.filter(found, lambda x: F.contains(F.lower(restated), x))


def templated(rows: DataFrame, key: str, positive: Column, templates: list[str], neutral: str) -> DataFrame:
    """Rows with column `templated`: positives get a template chosen by the hash of their key, others the neutral text."""
    chosen = F.element_at(F.array(*(F.lit(t) for t in templates)), T.template_index(F.col(key), len(templates)) + 1)
    return rows.withColumn("templated", F.when(positive, chosen).otherwise(F.lit(neutral)))


def evidence_rewrite(docs: DataFrame, key: str, text: str, baseline: Column, threshold: float = 0.5) -> DataFrame:
    """key, rewritten, predicted: positives become their evidence phrase with a full stop, negatives the baseline."""
    j = signals.with_evidence(docs, text)
    positive = T.keyword_score(F.col(text)) >= threshold
    return j.select(key, F.when(positive & F.col("phrase").isNotNull(), F.concat("phrase", F.lit("."))).otherwise(baseline).alias("rewritten"), positive.alias("predicted"))


def check_suggestions(text: str, suggestions: list[str]) -> list[tuple[str, str]]:
    """(suggestion, status) in order; the first reason against it wins: empty, duplicate, not_in_text, placeholder, protected_cue, too_broad; else accepted."""
    out, seen = [], set()
    for s in suggestions:
        norm = re.sub(r"\s+", " ", s or "").strip().lower()
        if not norm:
            status = "empty"
        elif norm in seen:
            status = "duplicate"
        elif s not in text:
            status = "not_in_text"
        elif S.PLACEHOLDER.search(s):
            status = "placeholder"
        elif M.cue_count(s) or M.D.targets(s):
            status = "protected_cue"
        elif len(s) > 80 or len(s) * 2 > len(text) and len(text) > 20 or re.search(r"[.!?]\s+\w", s):
            status = "too_broad"
        else:
            status = "accepted"
        seen.add(norm)
        out.append((s, status))
    return out


def similarity_gate(original: Column, restated: Column) -> Column:
    """Character similarity, the same as the row metrics use."""
    from cloakframe.operators.privatize import char_similarity

    return char_similarity(original, restated)
