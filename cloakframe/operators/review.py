"""Review of cases: joins with audits and token highlights, reviewer counters, label templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions import text as T
from cloakframe.operators import signals


def drift(rows: DataFrame, before: Column, after: Column, positive: Column, terms: list[str], keep: list[str]) -> DataFrame:
    """keep, deviation_score, deviation_risk, lost_terms: how much of what a row says was lost.

    Each lost term counts 3 in positive rows and 1 in others, a fallen cue count 2 or 1, a halved length 2.
    Both texts, their normal forms and their cues are made once, each in a projection of its own.
    """
    padded = lambda c: F.concat(F.lit(" "), T.normalize_text(c), F.lit(" "))
    rows = rows.select(*keep, positive.alias("__p"), before.alias("__b"), after.alias("__a"))
    rows = rows.select(*keep, "__p", F.length("__b").alias("__nb"), F.length("__a").alias("__na"), padded(F.col("__b")).alias("__fb"), padded(F.col("__a")).alias("__fa"), (T.cue_count(F.col("__b")) > T.cue_count(F.col("__a"))).alias("__cues"))
    lost = F.array_compact(F.array(*(F.when(F.contains("__fb", F.lit(f" {t} ")) & ~F.contains("__fa", F.lit(f" {t} ")), F.lit(t)) for t in terms)))
    rows = rows.select(*keep, "__p", "__nb", "__na", "__cues", lost.alias("__lost"))
    positive = F.col("__p")
    score = F.size("__lost") * F.when(positive, 3).otherwise(1) + F.when(F.col("__cues"), F.when(positive, 2).otherwise(1)).otherwise(0) + F.when(F.col("__na") * 2 < F.col("__nb"), 2).otherwise(0)
    rows = rows.select(*keep, score.cast("int").alias("deviation_score"), F.array_join("__lost", "|").alias("lost_terms"))
    s = F.col("deviation_score")
    return rows.select(*keep, "deviation_score", F.when(s >= 5, "high").when(s >= 3, "medium").when(s >= 1, "low").otherwise("none").alias("deviation_risk"), "lost_terms")


def token_highlights(df: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """key, token_index, token, delta, rank: the k tokens of each row with the greatest effect; equal ones by token, descending (a top-k report). No shuffle."""
    rows = signals.with_effects(df.select(F.col(key).alias("key"), F.col(text).alias("__x")), "__x")
    top = rows.select("key", F.posexplode(signals.top_effects(k)).alias("r", "x"))
    return top.select("key", "x.token_index", "x.token", "x.delta", (F.col("r") + 1).cast("int").alias("rank"))


def cases(rows: DataFrame, audit: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """Rows with their audit and their highlighted tokens, without the text; rows without either stay."""
    names = [c for c in rows.columns if c != text]
    marked = signals.with_effects(rows, text).withColumn("__top", signals.top_effects(k))
    marks = F.when(F.size("__top") > 0, F.array_join(F.transform("__top", lambda x: x["token"]), "|"))
    marked = marked.select(*names, marks.alias("highlights"))
    return marked.join(audit.withColumnRenamed(key, "__a"), F.col(key) == F.col("__a"), "left").drop("__a")


def reviewer_stats(decisions: DataFrame, reviewer: str, kind: str, hate: str, protected: str, uncertain: str) -> DataFrame:
    """Counters and points of each reviewer, and the rank by points."""
    n = lambda v: F.sum(F.when(F.col(kind) == v, 1).otherwise(0)).cast("long")
    stats = decisions.groupBy(F.col(reviewer).alias("reviewer")).agg(F.count("*").alias("total"), n(hate).alias("hate"), n(protected).alias("protected"), n(uncertain).alias("uncertain"))
    points = 10 * F.col("total") + 4 * F.col("hate") + 3 * F.col("protected") + 2 * F.col("uncertain")
    return stats.withColumn("points", points)


#: Badge, title, counter and how many of it are needed, in order.
TITLES = (
    ("CS", "Context Scout", "total", 5), ("RS", "Review Sentinel", "total", 10), ("PS", "Protector of Speech", "protected", 5), ("HB", "Hate Basher", "hate", 5), ("QC", "Queue Champion", "total", 25), ("SG", "Speech Guardian", "total", 50),
)


def standings(stats: DataFrame, streak: str | None = None) -> DataFrame:
    """Adds points (with a streak, 5 for each), badges (joined) and the title of the last one unlocked."""
    points = 10 * F.col("total") + 4 * F.col("hate") + 3 * F.col("protected") + 2 * F.col("uncertain") + (5 * F.col(streak) if streak else 0)
    won = F.array_compact(F.array(*(F.when(F.col(c) >= n, F.struct(F.lit(b).alias("badge"), F.lit(t).alias("title"))) for b, t, c, n in TITLES)))
    rows = stats.withColumn("points", points).withColumn("__won", won)
    title = F.when(F.size("__won") > 0, F.element_at("__won", -1)["title"]).otherwise("New Reviewer")
    return rows.withColumn("title", title).withColumn("badges", F.array_join(F.transform("__won", lambda x: x["badge"]), "|")).drop("__won")


def merged_stats(base: DataFrame, session: DataFrame) -> DataFrame:
    """Counters of both tables added up by reviewer."""
    names = ("total", "hate", "protected", "uncertain")
    return base.select("reviewer", *names).unionByName(session.select("reviewer", *names)).groupBy("reviewer").agg(*(F.sum(c).cast("long").alias(c) for c in names))


def votes(hate: Column, not_hate: Column, uncertain: Column) -> list[Column]:
    """total, and each share in whole percent (halves up), as text."""
    total = hate + not_hate + uncertain
    share = lambda v: F.concat(F.when(total > 0, F.floor(v * 100 / total + 0.5)).otherwise(0).cast("string"), F.lit("%"))
    return [total.alias("total"), share(hate).alias("hate_share"), share(not_hate).alias("not_hate_share"), share(uncertain).alias("uncertain_share")]


def normal_item(rows: DataFrame, order: str) -> DataFrame:
    """Review items with every field in its place: id, source, protected_text, restatement, label, score, risk, decision.

    Fields that are missing come from the next best one; unknown labels are not_hate, unknown risks medium.
    """
    has = set(rows.columns)
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in has), F.lit(""))
    case = F.concat(F.lit("case-"), F.col(order).cast("string"))
    ids = [F.col(n).cast("string") for n in ("id",) if n in has]
    sources = [F.col(n).cast("string") for n in ("source", "id") if n in has]
    risk, score = first("risk"), F.col("score").cast("double") if "score" in has else F.lit(None)
    return rows.select(
        F.coalesce(*ids, case).alias("id"), F.coalesce(*sources, case).alias("source"), first("protected_text", "scrubbed_text", "text").alias("protected_text"), first("restatement", "protected_text", "text").alias("restatement"),
        F.when(first("label") == "hate", "hate").otherwise("not_hate").alias("label"), F.coalesce(score, F.lit(0.0)).alias("score"), F.when(risk.isin("low", "medium", "high"), risk).otherwise("medium").alias("risk"), F.lit("pending").alias("decision"),
    )


def leaderboard(stats: DataFrame, k: int = 20) -> DataFrame:
    """The first k reviewers by points, then name (a top-k report)."""
    top = stats.orderBy(F.desc("points"), "reviewer").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("points"), "reviewer")))


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key (upsert); partial maxima are taken before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("x"))
    return best.select(key, *(F.col(f"x.{c}").alias(c) for c in rest))


def training_frame(df: DataFrame, text: str, label: str, held_out: DataFrame, held_text: str) -> DataFrame:
    """Distinct (text, label) rows whose normalised text is not held out and has one label only. Hashes, not texts, are the keys."""
    rows = df.select(F.col(text), F.col(label), T.normalize_text(F.col(text)).alias("__n")).where(F.length("__n") > 0).withColumn("__n", F.sha2("__n", 256))
    free = rows.join(held_out.select(F.sha2(T.normalize_text(F.col(held_text)), 256).alias("__n")).distinct(), "__n", "left_anti")
    found = free.groupBy("__n").agg(F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.min(text).alias(text))
    return found.where("__lo = __hi").select(F.col("__lo").alias(label), text)
