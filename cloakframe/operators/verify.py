"""Second opinions on a classifier: case types, routing, flips, strategies, shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import evaluate, ranking

QUOTA = {"FP": 60, "FN": 60, "TP": 20, "TN": 20}


def case_type(gold: Column, predicted: Column) -> Column:
    return F.when(gold & predicted, "TP").when(gold, "FN").when(predicted, "FP").otherwise("TN")


def evaluation_set(rows: DataFrame, gold: str, predicted: str, key: str, quota: dict = QUOTA) -> DataFrame:
    """Rows with gold 0 or 1, their case type, and of each type as many as its quota, by hashed key (a sampling operator)."""
    typed = rows.where(F.col(gold).isin(0, 1)).withColumn("case_type", case_type(F.col(gold) == 1, F.col(predicted)))
    return ranking.stratified_sample(typed, "case_type", F.col(key), quota)


def action(decision: Column) -> Column:
    return F.when(decision == "agree", "keep").when(decision == "disagree", "flip").when(decision == "uncertain", "human_review").otherwise("keep")


def routed(predicted: Column, decision: Column, cue: Column, strategy: str) -> Column:
    """Whether a row goes to the large model."""
    doubt = decision.isin("disagree", "uncertain")
    if strategy == "positives":
        return predicted & doubt
    if strategy == "positives_and_cue_negatives":
        return (predicted & doubt) | (~predicted & cue)
    if strategy == "all_doubt":
        return doubt
    raise ValueError(strategy)


def flipped(predicted: Column, decision: Column, strategy: str) -> Column:
    """The label after the verifier alone: its disagreement turns positives (or any label) round."""
    off = decision == "disagree"
    if strategy == "none":
        return predicted
    if strategy == "positives":
        return predicted & ~off
    if strategy == "both":
        return F.when(off, ~predicted).otherwise(predicted)
    raise ValueError(strategy)


# ---- Fixed values: the ways of using a verifier, its answers, and the weights of a way's score.
STRATEGIES = ("positive_verifier", "recall_router", "combined_router")
DECISIONS = ("agree", "disagree", "uncertain")
SCORE = {"fp_rescue_rate": 2.0, "fn_rescue_rate": 1.5, "tp_disagree_rate": -2.5, "tn_route_rate": -1.5, "parse_failure_rate": -1.0, "seconds_per_row": -0.2}


def in_reach(predicted: Column, cue: Column, strategy: str) -> Column:
    """Rows that a strategy looks at: positives, negatives that bear a cue, or both."""
    return {"positive_verifier": predicted, "recall_router": ~predicted & cue, "combined_router": predicted | cue}[strategy]


def flagged(decision: Column) -> Column:
    return F.coalesce(decision.isin("disagree", "uncertain"), F.lit(False))


def disagreed(decision: Column) -> Column:
    return F.coalesce(decision == "disagree", F.lit(False))


def _long(rows: DataFrame, gold: Column, predicted: Column, cue: Column, decision: Column, suggested: Column, second: Column) -> DataFrame:
    """A row for each row and strategy: gold, case_type, off, routed, the label after the verifier alone, and after the second model for what is routed."""
    base = rows.select(gold.alias("g"), predicted.alias("p"), F.coalesce(cue, F.lit(False)).alias("cue"), decision.alias("d"), suggested.alias("s"), second.alias("second"))
    p, off = F.col("p"), disagreed(F.col("d"))
    each = []
    for name in STRATEGIES:
        reach = in_reach(p, F.col("cue"), name)
        turned = off & reach & (F.col("s") == ~p)
        go = flagged(F.col("d")) & reach
        each.append(F.struct(F.lit(name).alias("strategy"), go.alias("routed"), F.when(F.coalesce(turned, F.lit(False)), ~p).otherwise(p).alias("flip"), F.when(go, F.coalesce("second", p)).otherwise(p).alias("big")))
    return base.select("g", case_type(F.col("g"), p).alias("case_type"), off.alias("off"), F.explode(F.array(*each)).alias("x")).select("g", "case_type", "off", "x.*")


def evaluated(rows: DataFrame, gold: Column, predicted: Column, cue: Column, decision: Column, suggested: Column, second: Column, parse_success: float = 1.0, seconds_per_row: float = 0.0) -> DataFrame:
    """One row a strategy: rates of rescue and damage, overhead, score, and metrics of the flips and of routing to the second model.

    decision is null where the verifier's answer could not be read. Rows are read once.
    """
    long = _long(rows, gold, predicted, cue, decision, suggested, second)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    kind = F.col("case_type")
    sums = {f"n_{k.lower()}": n(kind == k) for k in ("FP", "FN", "TP", "TN")}
    sums |= {"fp_rescue": n((kind == "FP") & F.col("routed")), "fn_rescue": n((kind == "FN") & F.col("routed")), "tp_disagree": n((kind == "TP") & F.col("off")), "tn_route": n((kind == "TN") & F.col("routed")), "routed_count": n(F.col("routed")), "rows": F.count("*")}
    for name in ("flip", "big"):
        sums |= {f"{name}_{c}": x for c, x in zip(("tp", "fp", "fn", "tn"), evaluate.confusion(F.col("g"), F.col(name)))}
    out = long.groupBy("strategy").agg(*(x.alias(k) for k, x in sums.items()))
    for name in ("flip", "big"):
        # Metrics of both ways, under their own names.
        renamed = out.select("strategy", *(F.col(f"{name}_{c}").alias(c) for c in ("tp", "fp", "fn", "tn")))
        rated = evaluate.rates(renamed, 4)
        out = out.join(rated.select(F.col("strategy").alias("__s"), *(F.col(c).alias(f"{name}_{c}") for c in ("accuracy", "balanced_accuracy", "precision", "recall", "f1"))), F.col("strategy") == F.col("__s")).drop("__s")
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    out = out.withColumns({"fp_rescue_rate": rate("fp_rescue", "n_fp"), "fn_rescue_rate": rate("fn_rescue", "n_fn"), "tp_disagree_rate": rate("tp_disagree", "n_tp"), "tn_route_rate": rate("tn_route", "n_tn"), "overhead": rate("routed_count", "rows")})
    fixed = SCORE["parse_failure_rate"] * (1 - parse_success) + SCORE["seconds_per_row"] * seconds_per_row
    score = sum((SCORE[c] * F.col(c) for c in ("fp_rescue_rate", "fn_rescue_rate", "tp_disagree_rate", "tn_route_rate")), F.lit(fixed))
    return out.withColumn("selection_score", F.round(score, 4)).drop("fp_rescue", "fn_rescue", "tp_disagree", "tn_route")


def run_summary(rows: DataFrame, decision: Column, reason: Column, parsed: Column) -> DataFrame:
    """decision, reason, n, parsed: what a verifier answered, with answers that could not be read counted apart."""
    return rows.select(F.when(parsed, decision).alias("decision"), F.when(parsed, reason).alias("reason"), parsed.alias("parsed")).groupBy("parsed", "decision", "reason").agg(F.count("*").alias("n"))


def recommendation_text(best: dict, strategy: str, baseline: dict, others: list[dict]) -> str:
    """A short report in Markdown on the model chosen; the values are those of evaluated() and of classification_metrics()."""
    say = lambda m, p="": ", ".join(f"{k} {m[p + k]:.4f}" for k in ("accuracy", "precision", "recall", "f1"))
    lines = [
        "# Verifier evaluation", "", f"- Model: `{best['model']}`, as {strategy.replace('_', ' ')}", f"- Before: {say(baseline)}", f"- After the verifier alone: {say(best, 'flip_')}", f"- After routing to the second model: {say(best, 'big_')}",
        f"- Routed: {best['routed_count']} rows ({best['overhead']:.1%})", f"- False positives rescued {best['fp_rescue_rate']:.1%}, false negatives {best['fn_rescue_rate']:.1%}; right positives doubted {best['tp_disagree_rate']:.1%}, right negatives routed {best['tn_route_rate']:.1%}",
        f"- Score: {best['selection_score']:.4f}", "", "## Others", "", *(f"- `{o['model']}`: score {o['selection_score']:.4f}, f1 {o['big_f1']:.4f}" for o in others),
    ]
    return "\n".join(lines) + "\n"


def compare_strategies(rows: DataFrame, gold: Column, predicted: Column, decision: Column, strategies: tuple = ("none", "positives", "both")) -> DataFrame:
    """strategy with its confusion counts and metrics; rows are read once and counted for all strategies."""
    long = rows.select(gold.alias("g"), F.explode(F.array(*(F.struct(F.lit(s).alias("strategy"), flipped(predicted, decision, s).alias("p")) for s in strategies))).alias("x"))
    return evaluate.classification_metrics(long.select("g", "x.*"), F.col("g"), F.col("p"), ("strategy",))


def shortlist(results: DataFrame, k: int, least_parsed: float = 0.9) -> DataFrame:
    """Best models by score among those that answer well-formed (a top-k report)."""
    return results.where(F.col("parse_rate") >= least_parsed).orderBy(F.desc("score"), "model").limit(k)


def recommendation(results: DataFrame) -> DataFrame:
    return results.agg(F.max(F.struct("f1", "precision", "score", "model")).alias("x")).select("x.*")


def draw_review(rows: DataFrame, key: str, hate: Column, n: int = 5) -> DataFrame:
    """One positive, one negative and others up to n, by hashed key (a sampling operator)."""
    h = F.sha2(F.col(key).cast("string"), 256)
    one = lambda c: rows.where(c).orderBy(h).limit(1)
    both = one(hate).unionByName(one(~hate))
    rest = rows.join(both.select(F.col(key).alias("__k")), F.col(key) == F.col("__k"), "left_anti").orderBy(h).limit(max(0, n - 2))
    return both.unionByName(rest).limit(n)


def allocate(sizes: dict, n: int) -> dict:
    """Quotas of buckets that share n evenly, none over its size; what small buckets leave goes to the others."""
    out = dict.fromkeys(sizes, 0)
    left = min(n, sum(sizes.values()))
    while left:
        open_ = sorted((k for k in sizes if out[k] < sizes[k]), key=str)
        each = max(1, left // len(open_))
        for k in open_:
            m = min(each, sizes[k] - out[k], left)
            out[k] += m
            left -= m
    return out
