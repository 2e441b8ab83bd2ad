"""Profiles of tables: columns, duplicates, lengths, frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import ranking


def columns(df: DataFrame, names: list[str]) -> DataFrame:
    """column_name, n_rows, n_null, n_blank, n_distinct; one pass over the rows, columns unpivoted before they are counted."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in names))).alias("x")).select("x.*")
    # Long values are known by their hash, so that texts do not cross the network.
    long = long.select("column_name", (F.trim("v") == "").alias("blank"), F.when(F.length("v") > 63, F.sha2("v", 256)).otherwise(F.col("v")).alias("v"))
    per_value = long.groupBy("column_name", "blank", "v").agg(F.count("*").alias("n"))
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return per_value.groupBy("column_name").agg(F.sum("n").cast("long").alias("n_rows"), n(F.col("v").isNull()).alias("n_null"), n(F.col("blank")).alias("n_blank"), F.count("v").alias("n_distinct"))


def duplicates(df: DataFrame, text: str, by: tuple = ()) -> DataFrame:
    """Duplicate statistics of trimmed, lower-cased values, overall or by group."""
    value = F.sha2(F.lower(F.trim(F.col(text))), 256)
    counts = df.groupBy(*by, F.when(F.trim(F.col(text)) != "", value).alias("v")).agg(F.count("*").alias("n"))
    some = F.col("v").isNotNull()
    return counts.groupBy(*by).agg(
        F.sum("n").cast("long").alias("n_rows"), F.sum(F.when(~some, F.col("n")).otherwise(0)).cast("long").alias("blank_rows"), F.count("v").alias("unique_values"),
        F.sum(F.when(some & (F.col("n") > 1), 1).otherwise(0)).cast("long").alias("duplicate_groups"), F.sum(F.when(some & (F.col("n") > 1), F.col("n")).otherwise(0)).cast("long").alias("duplicate_rows"),
        F.coalesce(F.max(F.when(some, F.col("n"))), F.lit(0)).alias("max_rows_per_value"),
    )


def quantiles(df: DataFrame, value: str, at: tuple = (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)) -> DataFrame:
    """Nearest-rank quantiles, exact: values are counted, and running sums are made in ranges of distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    runs = ranking.running_sums(counts, "v", ["n"]).select("v", F.col("upto_n").alias("upto"), F.col("all_n").alias("total"), "n")
    wanted = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.bround((F.col("total") - 1) * F.lit(p)).cast("long").alias("i")) for p in at)))
    return runs.select("v", "upto", "n", wanted.alias("q")).where((F.col("q.i") < F.col("upto")) & (F.col("q.i") >= F.col("upto") - F.col("n"))).select(F.col("q.p").alias("p"), F.col("v").alias("value"))


def top_values(df: DataFrame, value: str, order: str, k: int = 10) -> DataFrame:
    """Most frequent values; equal counts keep the order of first appearance (a report)."""
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)
