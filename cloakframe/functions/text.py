"""Scalar functions on text, as native Column expressions (no Python on executors)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe import resources as R

TOKEN = "[a-z][a-z']+"
_BOUND = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_bounds(pattern: str) -> str:
    r"""Java takes any Unicode letter as part of a word at \b; here only ASCII counts, as elsewhere in the engine."""
    return pattern.replace(r"\b", _BOUND)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def normalize_text(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased, with one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def normalize_term(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    return F.contains(F.concat(F.lit(" "), normalize_text(text), F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))


def phrase_count(text: Column, phrase: str) -> Column:
    """Bounded occurrences, not counting case."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(rf"(?<![A-Za-z0-9_]){re.escape(phrase)}(?![A-Za-z0-9_])")), F.lit(0))


def cue_count(text: Column, terms=R.CUES["utility"]) -> Column:
    """Sum over all cue terms; terms inside others count by themselves.

    Terms that cannot overlap are counted in one pass: all single words, and longer ones unless one ends with a word that another begins with.
    """
    words = [t for t in terms if " " not in t]
    rest = [t for t in terms if " " in t]
    first, last = {t.split()[0] for t in rest}, {t.split()[-1] for t in rest}
    passes = [words, *([rest] if not first & last and len(first) == len(rest) else [[t] for t in rest])]
    return sum((F.coalesce(F.regexp_count(F.lower(text), F.lit(rf"(?<![A-Za-z0-9_])(?:{'|'.join(map(re.escape, p))})(?![A-Za-z0-9_])")), F.lit(0)) for p in passes if p), F.lit(0))


def counts_for_terms(text: Column, terms) -> Column:
    """Map of the terms that occur to how often."""
    pairs = F.map_from_arrays(F.array(*(F.lit(t) for t in terms)), F.array(*(phrase_count(text, t) for t in terms)))
    return F.map_filter(pairs, lambda _, v: v > 0)


def safe_ratio(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.when(d != 0, n / d).otherwise(F.lit(default))


def retention(after: Column, before: Column) -> Column:
    return F.when(before == 0, F.lit(1.0)).otherwise(after / before)


def value_hash(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("string"), 256), 1, 12)


def safe_value_summary(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.struct(value_hash(text).alias("hash"), F.length(text).alias("length"), (F.trim(text) == "").alias("blank"))


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def keyword_score(text: Column, terms=R.SCORE_TERMS) -> Column:
    hits = F.size(F.array_intersect(token_set(text), F.array(*(F.lit(t) for t in terms))))
    return F.round(F.least(F.lit(0.99), F.lit(0.15) + F.lit(0.3) * hits), 6)


def guard_mask(text: Column, patterns=R.GUARD) -> Column:
    """Identifiers replaced in order by [TYPE]."""
    for name, pattern in patterns:
        text = F.regexp_replace(text, ascii_bounds(pattern), f"[{name}]")
    return text


#: What every match of a guard pattern has in it; cheap to look for, so that texts without it never meet the pattern.
_SIGNS = {"EMAIL": lambda t: F.contains(t, F.lit("@")), "URL": lambda t: F.contains(t, F.lit("://")), "IP": lambda t: t.rlike(r"[0-9]\.[0-9]"), "CARD": lambda t: t.rlike("[0-9]{4}[ -]?[0-9]{4}"), "PHONE": lambda t: t.rlike("[0-9][0-9 ().-]{7}")}


def guard_counts(text: Column, patterns=R.GUARD) -> dict[str, Column]:
    """How often each kind of identifier shows; null texts have no counts."""

    def count(name: str, pattern: str) -> Column:
        n = F.regexp_count(text, F.lit(ascii_bounds(pattern)))
        return F.when(~_SIGNS[name](text), 0).otherwise(n) if name in _SIGNS else n

    return {name: count(name, pattern) for name, pattern in patterns}


def style_risk_counts(text: Column) -> list[Column]:
    return [F.coalesce(F.regexp_count(text, F.lit(ascii_bounds(p))), F.lit(0)).cast("long").alias(n) for n, p in R.STYLE_RISK]


def context_tags(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(ascii_bounds(p)), F.lit(n)) for n, p in R.CONTEXT)))


def counter_sum(maps: Column) -> Column:
    """Key-wise sum of an array of maps."""
    return F.aggregate(maps, F.create_map().cast("map<string,bigint>"), lambda s, m: F.map_zip_with(s, m, lambda _, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))


def counter_positive_delta(before: Column, after: Column) -> Column:
    diff = F.map_zip_with(before, after, lambda _, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))
    return F.map_filter(diff, lambda _, v: v > 0)


def template_index(key: Column, n: int) -> Column:
    """First four bytes of the sha256 of a key, big-endian, modulo n."""
    return F.pmod(F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(xs: Column) -> Column:
    e = F.transform(xs, lambda x: F.exp(x - F.array_max(xs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def is_hate_label(label: Column) -> Column:
    return F.lower(F.trim(label.cast("string"))).isin("1", "true", "yes", "hate", "hateful", "hs")
