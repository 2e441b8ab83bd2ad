"""Exact ranks, folds and samples that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.operators.scans import running_sums  # noqa: F401  it has stood here


def hashed_rank(df: DataFrame, group: str, key: Column, name: str = "rank") -> DataFrame:
    """Ranks rows of each group (from 0) by the sha256 of a key.

    The first three hex digits are counted for each group; only rows that share
    them are sorted together, so a group may hold any share of all rows.
    """
    rows = df.withColumn("__h", F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)).withColumn("__b", F.substring("__h", 1, 3))
    counts = rows.groupBy(group, "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(group).alias("__g"), F.col("__b").alias("__c"), before.alias("__start"))
    joined = rows.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__c")))
    inner = F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h")) - 1
    return joined.withColumn(name, (F.col("__start") + inner).cast("long")).drop("__h", "__b", "__g", "__c", "__start")


def stratified_kfold(df: DataFrame, label: str, key: Column, folds: int = 5) -> DataFrame:
    """Fold of every row; each label is dealt evenly."""
    return hashed_rank(df, label, key).withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank")


def stratified_sample(df: DataFrame, label: str, key: Column, quota: dict) -> DataFrame:
    """The first rows of each label by hashed key, as many as the label's quota (a sampling operator)."""
    per = F.create_map(*(x for k, v in quota.items() for x in (F.lit(k), F.lit(v))))
    return hashed_rank(df, label, key).where(F.col("rank") < per[F.col(label)]).drop("rank")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, as a report. Spark keeps at most k rows of a group in each task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
