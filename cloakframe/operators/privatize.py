"""Operators that need the span detectors: Arrow-batched UDFs around plain functions, and plans over them."""

from __future__ import annotations

import functools
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as T
from cloakframe.resources import patterns
from cloakframe.sources import shared
from cloakframe.spans import detect as D
from cloakframe.spans import measure as M
from cloakframe.spans import style as S

SPAN = "start int, end int, entity_type string, text string, score double, source string, category string, replacement string"
CHANGE = "entity_type string, source string, score double, source_start int, source_end int, output_start int, output_end int, replacement string"
METRICS = (
    "depth string, identifiers_before int, identifiers_after int, direct_before int, direct_after int, quasi_before int, quasi_after int, quasi_types_before array<string>, quasi_types_after array<string>, "
    "residual_high_confidence_direct int, counts_before map<string,int>, counts_after map<string,int>, privacy_gain double, cues_before int, cues_after int, utility_cue_retention double, character_utility_retention double, "
    "target_cues_before int, target_cues_after int, target_cue_retention double, target_terms_before int, target_terms_after int, target_term_retention double, target_category_retention double, "
    "target_categories_before array<string>, target_categories_after array<string>, proxy_tradeoff double, placeholders int, placeholder_characters int, tokens int, mask_density double, placeholder_density double, "
    "placeholder_counts map<string,int>, privacy_warnings array<string>, masking_warnings array<string>, warnings array<string>"
)
PROFILE = (
    "length int, changed boolean, style_risk int, provider_reasons array<string>, model_reasons array<string>, review_reasons array<string>, direct_before int, direct_after int, quasi_before int, quasi_after int, "
    "target_cues_before int, target_cue_retention double, utility_cue_retention double"
)
ROUTE = "use_providers boolean, use_style boolean, review boolean, risk_level string, risk_reasons array<string>, low_risk_reasons array<string>"
SCORE = (
    "name string, score double, terms map<string,double>, faults array<string>, direct_after int, quasi_after int, target_cue_retention double, utility_cue_retention double, character_utility_retention double, length_drift double, style_risk int"
)
WARNINGS = (
    "residual_identifier_detected", "residual_direct_identifier_detected", "residual_quasi_identifier_detected", "residual_quasi_identifier_combination", "high_placeholder_density", "high_mask_density",
    "low_character_utility_retention", "target_cue_loss", "changed_without_detected_sensitive_span",
)


def _struct(ddl: str) -> str:
    """struct<...> of a column list."""
    return "struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in re.split(r",\s+(?=\w+ )", ddl)) + ">"


def _udf(f, schema: str, *args: Column) -> Column:
    """A column of f over rows; null texts count as empty. Structs come back as dicts or tuples."""

    @F.udf(schema, useArrow=True)
    def run(*values):
        return f(*("" if v is None else v for v in values))

    return run(*args)


def spans(text: Column, with_targets: bool = False) -> Column:
    return _udf(lambda t: [s._asdict() for s in D.detect(t, with_targets)], f"array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>", text)


def privatize(text: Column, with_style: bool = False, with_targets: bool = False) -> Column:
    """Struct: text (masked), n_spans, counts (by type), changes (offsets before and after)."""
    change = CHANGE.replace(" ", ":").replace(",:", ",")

    def run(t):
        new, done = D.splice(t, D.detect(t, with_targets))
        counts: dict = {}
        for d in done:
            counts[d[0]] = counts.get(d[0], 0) + 1
        names = [c.split()[0] for c in CHANGE.split(", ")]
        return {"text": S.scrub(new)[0] if with_style else new, "n_spans": len(done), "counts": counts, "changes": [dict(zip(names, d)) for d in done]}

    return _udf(run, f"text string, n_spans int, counts map<string,int>, changes array<struct<{change}>>", text)


def style_scrub(text: Column, plain: bool = True) -> Column:
    """Struct: text, steps (how many steps of each name changed it)."""
    return _udf(lambda t: dict(zip(("text", "steps"), S.scrub(t, plain))), "text string, steps map<string,int>", text)


def row_metrics(original: Column, result: Column, deep: bool = True) -> Column:
    return _udf(lambda a, b: M.row_metrics(a, b, deep), METRICS, original, result)


def rationale_report(source: Column, raw: Column, original: Column, result: Column) -> Column:
    return _udf(M.rationale_report, "n_spans int, n_changed int, retention double", source, raw, original, result)


def char_similarity(a: Column, b: Column) -> Column:
    return _udf(lambda x, y: round(M.ratio(x, y), 4), "double", a, b)


def row_profile(original: Column, baseline: Column) -> Column:
    """Counts of a row and the reasons why it needs providers, a model or review."""
    return _udf(M.profile, PROFILE, original, baseline)


def row_route(original: Column, baseline: Column) -> Column:
    """Where a row goes, with reasons for and against."""
    return _udf(lambda a, b: M.route(M.profile(a, b)), ROUTE, original, baseline)


def simple_scrub(text: Column) -> Column:
    """The second scrubber, by form alone, leftmost then longest. Struct: text, n."""
    return _udf(lambda t: dict(zip(("text", "n"), D.simple(t))), "text string, n int", text)


#: The plain forms of identifiers, letters in either case.
FORMS = {"EMAIL": (D._MAIL.pattern,), "URL": (patterns.URL,), "DATE": (patterns.DATE,), "AGE": patterns.AGE, "IDENTIFIER": (patterns.IDENTIFIER,)}


#: What every match of a form has in it, so that texts without it never meet the form; and the letters or digits that it may begin with.
_SIGNS = {
    D._MAIL.pattern: ("@", ""), patterns.URL: ("[:wW][/.]", "[hw]"), patterns.DATE: (r"[\s/-][0-9]", "[0-9jfmasond]"), patterns.AGE[0]: (r"[mMdDeE]\s+[0-9]", "[ia]"), patterns.AGE[1]: ("[0-9][- ][yY]", "[0-9]"),
    patterns.IDENTIFIER: ("[0-9]", "[ictsur]"),
}


def form_counts(text: Column) -> dict[str, Column]:
    """How often each of the plain forms shows, before anything is merged. Native."""

    def count(pattern: str) -> Column:
        sign, first = _SIGNS[pattern]
        # Before a letter or digit, a bound is the lack of one; both are looked at before the form is tried.
        native = "(?i)" + (f"(?={first})(?<![A-Za-z0-9_])" + T.ascii_bounds(pattern.removeprefix(r"\b")) if first else T.ascii_bounds(pattern))
        return F.when(text.rlike(sign) if len(sign) > 1 else F.contains(text, F.lit(sign)), F.regexp_count(text, F.lit(native))).otherwise(F.lit(0)).cast("long")

    return {k: functools.reduce(operator.add, map(count, ps)) for k, ps in FORMS.items()}


def strict_cleanup(text: Column, direct_only: bool = False) -> Column:
    """A second pass over masked text. Struct: text, n, counts (by type)."""

    def run(t):
        new, done = D.splice(t, D.direct(t) if direct_only else D.strict(t))
        counts: dict = {}
        for d in done:
            counts[d[0]] = counts.get(d[0], 0) + 1
        return {"text": new, "n": len(done), "counts": counts}

    return _udf(run, "text string, n int, counts map<string,int>", text)


def candidate_select(text: Column) -> Column:
    """Struct: name, text and reason of the chosen rewrite, n_candidates, scores of all."""

    def run(t):
        options = M.candidates(t)
        k, scores, reason = M.choose(t, options)
        return {"name": options[k][0], "text": options[k][1], "reason": reason, "n_candidates": len(options), "scores": scores}

    return _udf(run, f"name string, text string, reason string, n_candidates int, scores array<{_struct(SCORE)}>", text)


def aggregate_metrics(rows: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Means, sums, and counts of warnings and placeholders over all rows; partial sums are made before the shuffle."""
    m = lambda c: F.col(f"{metrics}.{c}")
    means = ("privacy_gain", "utility_cue_retention", "character_utility_retention", "target_category_retention", "proxy_tradeoff", "mask_density")
    sums = ("identifiers_before", "identifiers_after", "direct_after", "quasi_after")
    return rows.agg(F.count("*").alias("rows"), *(F.round(F.avg(m(c)), 4).alias(f"mean_{c}") for c in means), *(F.sum(m(c)).alias(c) for c in sums), *(F.sum(F.array_contains(m("warnings"), w).cast("long")).alias(f"warn_{w}") for w in WARNINGS))


def author_group_mask(docs: DataFrame, author: str, text: str, key: str, least: int = 2, found: Column | None = None) -> DataFrame:
    """key, author, masked text and number of masked values: those that an author repeats in at least `least` rows.

    found: an array of (entity_type, text) structs, by default the detector's, which runs once a text.
    Values, not texts, are shuffled to find repeats: one row per value and document, counted before the
    shuffle. An author's repeated values are gathered as one array for each row that has some.
    """
    norm = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    rows = docs.select(F.col(key).alias("k"), F.col(author).alias("a"), F.col(text).alias("x"), (spans(F.col(text)) if found is None else found).alias("s"))
    value = lambda s: F.struct(s["entity_type"].alias("t"), norm(s["text"]).alias("v"), s["text"].alias("raw"))
    rows = rows.withColumn("s", F.array_distinct(F.filter(F.transform("s", value), lambda s: F.length(s["v"]) >= 3)))
    # Stored, as it is read for repeats and for hits, and the detector is what costs.
    flat = shared.stored(rows.where(F.size("s") > 0).select("k", "a", F.explode("s").alias("s")).select("k", "a", "s.*"))
    repeated = flat.select("a", "t", "v", "k").distinct().groupBy("a", "t", "v").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    hits = flat.alias("f").join(repeated.alias("r"), F.col("f.a").eqNullSafe(F.col("r.a")) & (F.col("f.t") == F.col("r.t")) & (F.col("f.v") == F.col("r.v")), "left_semi")
    per_row = hits.groupBy("k").agg(F.collect_set(F.struct("raw", "t")).alias("values")).withColumnRenamed("k", "__k")

    def mask(t, values):
        n = 0
        for v in sorted(values or (), key=lambda v: (-len(v["raw"]), v["raw"])):
            t, c = re.subn(rf"(?<!\w){re.escape(v['raw'])}(?!\w)", lambda _: D.TAGS.get(v["t"], f"[{v['t']}]"), t)  # noqa: B023
            n += c
        return {"text": t, "n_masked": n}

    joined = rows.select("k", "a", "x").join(per_row, F.col("k").eqNullSafe(F.col("__k")), "left")
    # Only rows with a repeated value go to Python.
    done = joined.where("values is not null").withColumn("m", _udf(mask, "text string, n_masked int", F.col("x"), F.col("values")))
    rest = joined.where("values is null")
    same = lambda d, t, n: d.select(F.col("k").alias(key), F.col("a").alias(author), t.alias("text"), n.alias("n_masked"))
    return same(done, F.col("m.text"), F.col("m.n_masked")).unionByName(same(rest, F.col("x"), F.lit(0)))


@F.udtf(returnType=SPAN)
class DetectSpans:
    """SELECT * FROM detect_spans(text): a row for each span."""

    def eval(self, text: str):
        for s in D.detect(text or "", True):
            yield tuple(s)


def register(spark) -> None:
    """The detectors for SQL: privatize_text(text), count_identifiers(text) and the table function detect_spans(text)."""

    @F.pandas_udf("string")
    def masked(s: pd.Series) -> pd.Series:
        return s.map(lambda t: D.splice(t or "", D.detect(t or ""))[0])

    @F.pandas_udf("int")
    def count(s: pd.Series) -> pd.Series:
        return s.map(lambda t: len(D.detect(t or "")))

    spark.udf.register("privatize_text", masked)
    spark.udf.register("count_identifiers", count)
    spark.udtf.register("detect_spans", DetectSpans)
