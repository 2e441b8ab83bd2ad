"""Token signals: TF-IDF by author, concentration, occlusion importance, evidence windows, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe import resources as R
from cloakframe.functions.text import tokens
from cloakframe.operators.scans import merged as interval_merge  # noqa: F401  they have stood here
from cloakframe.operators.scans import runs  # noqa: F401


def token_counts(df: DataFrame, author: str, text: str) -> DataFrame:
    """author, token, tf. The one shuffle of exploded tokens, with counts made before it."""
    return df.select(F.col(author).alias("author"), F.explode(tokens(F.col(text))).alias("token")).groupBy("author", "token").agg(F.count("*").alias("tf"))


def author_tfidf(df: DataFrame, author: str, text: str, top: int = 25) -> DataFrame:
    """Top tokens per author: sublinear tf, smooth idf, L2 norm; rank by weight, then token (a top-k report)."""
    counts = token_counts(df, author, text)
    n = counts.select("author").distinct().agg(F.count("*")).scalar()
    idf = counts.groupBy("token").agg(F.count("*").alias("df")).select("token", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    weights = counts.join(idf, "token").withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norms = weights.groupBy("author").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = weights.join(norms, "author").select("author", "token", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("author").orderBy(F.desc("weight"), "token"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def concentration(df: DataFrame, author: str, text: str, least: int = 2) -> DataFrame:
    """token, total, authors, the greatest share of one author (and who): tokens that give an author away."""
    per = token_counts(df, author, text).groupBy("token").agg(F.sum("tf").alias("total"), F.count("*").alias("authors"), F.max(F.struct("tf", "author")).alias("top"))
    return per.where(F.col("total") >= least).select("token", "total", "authors", F.col("top.author").alias("author"), F.round(F.col("top.tf") / F.col("total"), 6).alias("concentration"))


def _score(n: Column) -> Column:
    return F.least(F.lit(0.99), F.lit(0.15) + F.lit(0.3) * n)


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose values are made once: a generator of one row stands between the projections, so that Spark does not put the expressions into lambdas that use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _weighed(df: DataFrame, text: str, terms=R.SCORE_TERMS) -> DataFrame:
    """Adds __t (tokens), __n (distinct terms among them) and __once (terms that occur once).

    Removing one token changes the score only if it is a term that occurs once, so nothing is scored again.
    """
    listed = F.array(*(F.lit(x) for x in terms))
    rows = _fixed(df, __t=tokens(F.col(text)))
    rows = _fixed(rows, __hits=F.filter("__t", lambda x: F.array_contains(listed, x)))
    once = F.filter(F.array_distinct("__hits"), lambda x: F.size(F.filter(F.col("__hits"), lambda y: y == x)) == 1)
    return _fixed(rows, __n=F.size(F.array_distinct("__hits")), __once=once).drop("__hits")


def token_importance(df: DataFrame, key: str, text: str, terms=R.SCORE_TERMS) -> DataFrame:
    """key, token_index, token, baseline, masked, delta, abs_delta of every token: the keyword score without that token."""
    rows = _weighed(df.select(F.col(key).alias("key"), F.col(text).alias("__x")), "__x", terms)
    rows = rows.select("key", F.col("__n").alias("n"), F.col("__once").alias("once"), F.posexplode("__t").alias("token_index", "token"))
    masked, base = _score(F.col("n") - F.array_contains("once", F.col("token")).cast("int")), _score(F.col("n"))
    return rows.select("key", "token_index", "token", F.round(base, 6).alias("baseline"), F.round(masked, 6).alias("masked"), F.round(base - masked, 6).alias("delta"), F.round(F.abs(base - masked), 6).alias("abs_delta"))


def with_effects(df: DataFrame, text: str, terms=R.SCORE_TERMS) -> DataFrame:
    """Adds __t (tokens) and effects: (token_index, token, delta) of the tokens that change the score. All in the row, nothing is shuffled."""
    delta = F.round(_score(F.col("__n")) - _score(F.col("__n") - 1), 6)
    every = F.transform("__t", lambda x, i: F.struct(i.alias("token_index"), x.alias("token")))
    some = F.filter(every, lambda x: F.array_contains("__once", x["token"]))
    effects = F.transform(some, lambda x: F.struct(x["token_index"].alias("token_index"), x["token"].alias("token"), F.col("__delta").alias("delta")))
    rows = _fixed(_weighed(df, text, terms), __delta=delta)
    return _fixed(rows, effects=F.when(F.col("__delta") != 0, effects).otherwise(F.slice(effects, 1, 0))).drop("__n", "__once", "__delta")


def with_evidence(df: DataFrame, text: str, anchors: int = 3, radius: int = 2, least: float = 0.03, relative: float = 0.25) -> DataFrame:
    """Adds phrase and n_anchors: the tokens within `radius` of the row's best anchors, joined in order; null and 0 where there is none."""
    rows = with_effects(df, text)
    rows = _fixed(rows, __good=F.filter("effects", lambda x: x["delta"] >= least))
    rows = _fixed(rows, __best=F.array_max(F.transform("__good", lambda x: x["delta"])))
    ranked = F.array_sort(F.transform(F.filter("__good", lambda x: x["delta"] >= relative * F.col("__best")), lambda x: F.struct((-x["delta"]).alias("d"), x["token_index"].alias("i"))))
    rows = _fixed(rows, __at=F.transform(F.slice(ranked, 1, anchors), lambda x: x["i"]))
    near = F.array_distinct(F.flatten(F.transform("__at", lambda a: F.sequence(F.greatest(a - radius, F.lit(0)), F.least(a + radius, F.size("__t") - 1)))))
    phrase = F.array_join(F.transform(F.array_sort(near), lambda i: F.element_at("__t", i + 1)), " ")
    rows = rows.withColumn("n_anchors", F.size("__at")).withColumn("phrase", F.when(F.col("n_anchors") > 0, phrase))
    return rows.drop("__t", "__good", "__best", "__at", "effects")


def top_effects(k: int) -> Column:
    """The k effects of a row by size, then token, descending, then place."""
    order = lambda a, b: F.when(F.abs(a["delta"]) != F.abs(b["delta"]), F.when(F.abs(a["delta"]) > F.abs(b["delta"]), -1).otherwise(1)).when(a["token"] != b["token"], F.when(a["token"] > b["token"], -1).otherwise(1)).otherwise(a["token_index"] - b["token_index"])
    return F.slice(F.array_sort("effects", order), 1, k)


def evidence(df: DataFrame, key: str, text: str, **options) -> DataFrame:
    """key, phrase, n_anchors of the rows that have an anchor."""
    return with_evidence(df.select(F.col(key).alias("key"), F.col(text).alias("__x")), "__x", **options).where("n_anchors > 0").select("key", "phrase", F.col("n_anchors").cast("int").alias("n_anchors"))


def repeated_values(df: DataFrame, author: str, key: str, values: Column, least: int = 2) -> DataFrame:
    """author, value, n_rows: values that an author has in at least `least` rows."""
    long = df.select(F.col(author).alias("author"), F.col(key).alias("k"), F.explode(F.array_distinct(values)).alias("value"))
    return long.groupBy("author", "value").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") >= least)
