"""Metrics of classifiers: confusion counts, sweeps over thresholds, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.functions.text import safe_ratio
from cloakframe.operators import ranking


def confusion(gold: Column, predicted: Column) -> list[Column]:
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return [n(gold & predicted).alias("tp"), n(~gold & predicted).alias("fp"), n(gold & ~predicted).alias("fn"), n(~gold & ~predicted).alias("tn")]


def rates(counted: DataFrame, digits: int = 6) -> DataFrame:
    """Adds accuracy, balanced accuracy, precision, recall, specificity and f1 to confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = safe_ratio(tp, tp + fn), safe_ratio(tn, tn + fp)
    named = {
        "accuracy": safe_ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": (recall + specificity) / 2,
        "precision": safe_ratio(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1": safe_ratio(2 * tp, 2 * tp + fp + fn),
    }
    return counted.select("*", *(F.round(v, digits).alias(k) for k, v in named.items()))


def classification_metrics(df: DataFrame, gold: Column, predicted: Column, by: tuple = ()) -> DataFrame:
    return rates(df.groupBy(*by).agg(*confusion(gold, predicted)))


def grid(df: DataFrame, gold: Column, predicted: Column, sets: list[list[str]]) -> DataFrame:
    """Metrics of all combinations of columns at once, such as of models, data sets, splits and rules: those of every set, with its subtotals.

    Columns that a set leaves out are null; level (a bit for each column left out, the last column lowest) tells
    them from nulls of the data. One shuffle, of counts that are added up before it.
    """
    names = list(dict.fromkeys(c for s in sets for c in s))
    counted = df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(*confusion(gold, predicted), F.grouping_id().alias("level"))
    return rates(counted.select(*names, F.col("level").cast("int").alias("level"), "tp", "fp", "fn", "tn"))


def threshold_sweep(df: DataFrame, gold: Column, score: str) -> DataFrame:
    """One row per distinct score as threshold (score >= threshold is positive), with its metrics.

    Rows are counted per score first, so the running sums see distinct scores only.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(gold, 1).otherwise(0)).alias("pos"), F.sum(F.when(gold, 0).otherwise(1)).alias("neg"))
    run = ranking.running_sums(counts, "threshold", ["pos", "neg"], descending=True).select("threshold", F.col("upto_pos").alias("tp"), F.col("upto_neg").alias("fp"), F.col("all_pos").alias("p"), F.col("all_neg").alias("n"))
    return rates(run.select("threshold", "tp", "fp", (F.col("p") - F.col("tp")).alias("fn"), (F.col("n") - F.col("fp")).alias("tn")))


def best_threshold(df: DataFrame, gold: Column, score: str, metric: str = "f1") -> DataFrame:
    return threshold_sweep(df, gold, score).orderBy(F.desc(metric), F.desc("threshold")).limit(1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("label", "n", F.round(total / (2 * F.col("n")), 6).alias("weight"))


def strategy_score(tp_kept: Column, tn_kept: Column, fp_fixed: Column, fn_fixed: Column, parse_fail: Column, seconds: Column) -> Column:
    """Weights of a second opinion: gains for errors put right, losses for right answers damaged, failures and time."""
    return 2 * fp_fixed + 1.5 * fn_fixed - 2.5 * tp_kept - 1.5 * tn_kept - parse_fail - 0.2 * seconds
