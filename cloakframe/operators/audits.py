"""Audits: context tags, audit records of spans, summaries of a run, loss of meaning in restatements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe import resources as R
from cloakframe.functions import text as T
from cloakframe.resources import patterns

# ---- Fixed values: classes of entity types, and sources of the engine's own detectors.
DIRECT = ("ALIAS", "CREDIT_CARD", "CRYPTO_WALLET", "DISCORD_USER", "PERSON", "USER", "EMAIL", "IBAN", "PHONE", "URL", "IP_ADDRESS", "SOCIAL_LINK", "IDENTIFIER")
QUASI = ("AGE", "DATE", "LOCATION", "ORGANIZATION")
OWN = (
    "regex", "regex_crypto_wallet", "regex_deobfuscated_email", "regex_discord_handle", "regex_iban_mod97", "regex_ipv6", "regex_luhn_credit_card", "regex_social_link", "context_person", "context_alias", "context_location",
    "known_location", "target_dictionary", "target_hashtag", "target_variant", "target_spaced_variant", "external_profanity_lexicon", "regex_obfuscated_email",
)
MEANING = ("target_cue_loss", "utility_cue_loss")


def privacy_class(kind: Column) -> Column:
    return F.when(kind.isin(*DIRECT), "direct_identifier").when(kind.isin(*QUASI), "quasi_identifier").when(kind == "STYLE", "style").otherwise("none")


def utility_class(kind: Column) -> Column:
    return F.when(kind == "TARGET_GROUP", "hsd_target").otherwise("none")


def provider(source: Column) -> Column:
    """Who found a span, by its source: the engine, or what stands before the colon."""
    return F.when(source.isin(*OWN), "deterministic").otherwise(F.substring_index(source, ":", 1))


def span_records(spans: Column) -> Column:
    """Audit records of an array of spans, without their text."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["entity_type"].alias("entity_type"), privacy_class(s["entity_type"]).alias("privacy_class"), utility_class(s["entity_type"]).alias("utility_class"),
            provider(s["source"]).alias("provider"), F.round(s["score"], 4).alias("score"), s["source"].alias("explanation_code"), s["category"].alias("category"),
        ),
    )


def limited(df: DataFrame, level: str, order: str) -> DataFrame:
    """The first 100 rows of a summary audit (a report), all of another."""
    return df.orderBy(order).limit(100) if level == "summary" else df


# ---- context


def _any(terms) -> str:
    return rf"(?<![a-z0-9])(?:{'|'.join(re.escape(t) for t in terms)})(?![a-z0-9])"


def has_any(text: Column, terms) -> Column:
    return F.coalesce(F.lower(text).rlike(_any(terms)), F.lit(False))


def has_target(target: Column) -> Column:
    """Whether a row's metadata name a target."""
    return F.coalesce(~F.lower(F.trim(target.cast("string"))).isin(*R.BLANK_TARGETS), F.lit(False))


def historical_victims(text: Column) -> Column:
    return has_any(text, R.TARGETS["historical_victim_group"])




def context(text: Column, target: Column) -> Column:
    """Struct: tags (in a fixed order) and reasons (sorted) of a text; target: whether it speaks of a protected group."""
    low = F.lower(F.coalesce(text, F.lit("")))
    # (?d): to Java a dot is then all but \n, as elsewhere.
    shown = lambda ps: low.rlike("(?d)" + T.ascii_bounds("|".join(ps)))
    hostile, threat, dehuman, excluded = has_any(text, R.CUES["action"]), has_any(text, R.THREATS), has_any(text, R.DEHUMANIZATION), has_any(text, R.EXCLUSION)
    negated, countered, reported = shown(patterns.NEGATION), shown(patterns.COUNTERSPEECH), shown(patterns.REPORT)
    public = has_any(text, R.PUBLIC) & has_any(text, R.CRITICISM) & ~target
    offensive = has_any(text, R.OFFENSIVE) & ~target & ~threat & ~excluded & ~dehuman
    missing = (target | hostile | offensive) & ~countered & ~reported & ~public
    found = (
        ("protected_target", "target_marker_present", target), ("historical_victim_group", "historical_victim_marker_present", historical_victims(text)), ("hostile_action", "action_marker_present", hostile),
        ("threat", "threat_marker_present", threat), ("dehumanization", "dehumanization_marker_present", dehuman), ("exclusion", "exclusion_marker_present", excluded), ("negated_hate", "negation_marker_present", negated),
        ("counterspeech", "counterspeech_marker_present", countered), ("quoted_or_reported", "quote_or_reporting_marker_present", reported),
        ("public_interest_or_institutional_criticism", "public_interest_criticism_marker_present", public), ("offensive_only_risk", "offensive_without_protected_target", offensive),
        ("missing_context", "speaker_audience_context_missing", missing),
    )
    listed = lambda k: F.array_compact(F.array(*(F.when(f[2], F.lit(f[k])) for f in found)))
    return F.struct(listed(0).alias("tags"), F.array_sort(listed(1)).alias("reasons"))


def names_target(text: Column) -> Column:
    """Whether a term of a protected group stands in the text (broad ones need a cue of hostility in it too). Native: no variants."""
    broad, plain = R.BROAD_TARGETS, [t for terms in R.TARGETS.values() for t in terms if t not in R.BROAD_TARGETS]
    return has_any(text, plain) | (has_any(text, broad) & has_any(text, R.CUES["generalisation"]))


# ---- loss of meaning


def terms_in(text: Column, terms) -> Column:
    """The terms that a text holds, as normal words, sorted."""
    normal = F.concat(F.lit(" "), T.normalize_term(text), F.lit(" "))
    listed = sorted({re.sub("[^a-z0-9]+", " ", t.lower()).strip() for t in terms})
    return F.filter(F.array(*map(F.lit, listed)), lambda t: F.contains(normal, F.concat(F.lit(" "), t, F.lit(" "))))


def missing(terms: Column, text: Column) -> Column:
    normal = F.concat(F.lit(" "), T.normalize_term(text), F.lit(" "))
    return F.filter(terms, lambda t: ~F.contains(normal, F.concat(F.lit(" "), t, F.lit(" "))))


def abstracted(text: Column) -> Column:
    """Whether a restatement speaks of an offence in place of repeating it."""
    return F.size(terms_in(text, R.ABSTRACTED)) > 0


def bracket_tokens(text: Column) -> Column:
    """How often each bracketed token stands in a text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[[^\[\]]+\]"), F.lit(0))
    return F.map_from_entries(F.transform(F.array_distinct(found), lambda t: F.struct(t, F.size(F.filter(found, lambda x: x == t)))))


def deviation(rows: DataFrame, source: str, restated: str, positive: Column, category_retention: Column, cue_retention: Column) -> DataFrame:
    """Adds deviation_score, deviation_risk and deviation_reasons of a restatement against its source; the retentions come from the row metrics."""
    p = rows.withColumn("__p", positive).withColumn("__t", terms_in(F.col(source), [t for terms in R.TARGETS.values() for t in terms])).withColumn("__o", terms_in(F.col(source), R.OFFENSIVE)).withColumn("__c", terms_in(F.col(source), R.CONTEXT_TERMS))
    p = p.withColumn("__ml", missing(F.col("__t"), F.col(restated))).withColumn("__mo", missing(F.col("__o"), F.col(restated))).withColumn("__mc", missing(F.col("__c"), F.col(restated)))
    offended = (F.size("__o") > 0) & (F.size("__mo") * 4 > F.size("__o"))
    told = abstracted(F.col(restated))
    weighed = (
        ("target_category_loss", category_retention < 0.95, 4, 2), ("target_cue_loss", cue_retention < 0.95, 3, 1), ("target_term_loss", F.size("__ml") > 0, 3, 1), ("context_term_loss", F.size("__mc") > 0, 2, 1),
        ("offensive_cue_loss", offended & ~told, 3, 1), ("offensive_cue_abstracted", offended & told, 1, 0),
    )
    score = sum((F.when(c, F.when(F.col("__p"), a).otherwise(b)).otherwise(0) for _, c, a, b in weighed), F.lit(0))
    p = p.withColumn("deviation_reasons", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c, _, _ in weighed)))).withColumn("deviation_score", score)
    p = p.withColumn("deviation_reasons", F.when(F.col("__p") & (F.size("deviation_reasons") == 0), F.array(F.lit("no_heuristic_deviation"))).otherwise(F.col("deviation_reasons")))
    s = F.col("deviation_score")
    return p.withColumn("deviation_risk", F.when(s >= 5, "high").when(s >= 3, "medium").when(s >= 1, "low").otherwise("ok")).select(*rows.columns, "deviation_score", "deviation_risk", "deviation_reasons")


# ---- summaries of a run


def pii_assist(statuses: dict[str, dict], loads: dict[str, int], names: tuple[str, ...]) -> dict:
    """State of the components that help to find identifiers; enabled if one of them is there."""
    shown = ("kind", "model", "profile", "local_only", "missing", "detail")
    state = {n: str(statuses.get(n, {}).get("status", "unknown")) for n in names}
    details = {n: {"status": state[n], "load_count": int(loads.get(n, 0))} | {k: v for k, v in statuses.get(n, {}).items() if k in shown} for n in names}
    return {"label": "PII Assist", "enabled": any(s in ("available", "ready", "download_allowed") for s in state.values()), "components": state, "component_details": details}


def stage_summary(rows: DataFrame, text: str, chosen: str = "chosen", metrics: str = "metrics") -> DataFrame:
    """One row: how many rows were changed, what was chosen and why, what was rejected, what is left, means of what was kept.

    chosen: the struct of candidate_select; metrics: that of row_metrics against the chosen text.
    """
    c, m = (lambda x: F.col(f"{chosen}.{x}")), (lambda x: F.col(f"{metrics}.{x}"))
    faults = F.flatten(F.transform(c("scores"), lambda s: s["faults"]))
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("long")
    means = ("privacy_gain", "target_cue_retention", "target_term_retention", "utility_cue_retention", "character_utility_retention")
    return rows.agg(
        F.count("*").alias("rows"), count(c("text") != F.coalesce(F.col(text), F.lit(""))).alias("changed_rows"), F.sum(F.size(c("scores"))).alias("candidates"),
        F.sum(F.size(F.filter(c("scores"), lambda s: F.size(s["faults"]) > 0))).alias("rejected_candidates"), F.sum(F.size(F.filter(faults, lambda f: f.isin(*MEANING)))).alias("cue_loss_rejections"),
        *(count(c("name") == n).alias(f"chose_{n}") for n in ("balanced", "style_scrubbed", "balanced_strict", "style_scrubbed_strict")), count(c("reason").startswith("fallback")).alias("fallbacks"),
        *(F.sum(m(k)).alias(k) for k in ("identifiers_after", "direct_after", "quasi_after")), *(F.round(F.avg(m(k)), 4).alias(f"mean_{k}") for k in means),
    )


def counted(rows: DataFrame, status: str, decision: str, score: str) -> DataFrame:
    """A model's answers by status and decision, with the mean score: the summary of classifiers, reviews and verifiers."""
    return rows.groupBy(F.coalesce(status, F.lit("missing")).alias("status"), F.coalesce(F.col(decision).cast("string"), F.lit("none")).alias("decision")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"))
