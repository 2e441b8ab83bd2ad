"""Profiles that merge: a row of sketches for each part of a table and column, made once, and merged without a look at the part again.

Distinct values by HyperLogLog, quantiles of lengths and numbers by KLL; counts,
minima and maxima are exact. `profile.columns` and `profile.quantiles` are the
exact ways over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG, K = 14, 400  # registers of HyperLogLog (2**LG; about 0.8 % error), and the size of a KLL sketch (about 0.7 % of ranks)
QUANTILES = (0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)


def _lean(df: DataFrame, names: list[str]) -> DataFrame:
    """column_name, v (hashed if it is long), length and number of every cell."""
    value = F.col("x.v")
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), df[f"`{c}`"].cast("string").alias("v")) for c in names))
    rows = df.select(F.explode(cells).alias("x"))
    return rows.select("x.column_name", value.isNull().alias("none"), (F.trim(value) == "").alias("blank"), F.xxhash64(value).alias("h"), F.char_length(value).cast("bigint").alias("length"), value.try_cast("double").alias("number"))


def sketched(df: DataFrame, names: list[str], part: str) -> DataFrame:
    """A row for each column: the profile of one part, ready to be stored and merged. Partial sketches are made before the shuffle."""
    n = lambda c: F.count_if(c)
    some = ~F.col("none")
    return _lean(df, names).groupBy("column_name").agg(
        F.count("*").alias("n_rows"), n(F.col("none")).alias("n_null"), n(F.col("blank")).alias("n_blank"), F.min("number").alias("least"), F.max("number").alias("most"),
        F.hll_sketch_agg(F.when(some, F.col("h")), F.lit(LG)).alias("distinct"), F.kll_sketch_agg_bigint("length", F.lit(K)).alias("lengths"), F.kll_sketch_agg_double("number", F.lit(K)).alias("numbers"),
    ).select(F.lit(part).alias("part"), "*")


def append(df: DataFrame, names: list[str], part: str, path: str) -> None:
    """Adds the profile of a part to the stored ones; doing it again replaces it."""
    sketched(df, names, part).drop("part").write.mode("overwrite").parquet(f"{path}/part={part}")


def merged(parts: DataFrame) -> DataFrame:
    """One row for each column over all parts, as sketches again, so that merges merge."""
    return parts.groupBy("column_name").agg(
        *(F.sum(c).alias(c) for c in ("n_rows", "n_null", "n_blank")), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_bigint("lengths").alias("lengths"), F.kll_merge_agg_double("numbers").alias("numbers"),
    )


def _at(kind: str, sketch: str, p: float) -> Column:
    n, q = (getattr(F, f"kll_sketch_get_{what}_{kind}") for what in ("n", "quantile"))
    return F.when(n(sketch) > 0, q(sketch, F.lit(p)))


def report(sketches: DataFrame) -> DataFrame:
    """What the sketches say: counts, an estimate of distinct values, quantiles of lengths and numbers."""
    named = lambda kind, c, name: [_at(kind, c, p).alias(f"{name}_{round(100 * p)}") for p in QUANTILES]
    return sketches.select("column_name", "n_rows", "n_null", "n_blank", F.hll_sketch_estimate("distinct").alias("n_distinct"), "least", "most", *named("bigint", "lengths", "length"), *named("double", "numbers", "number"))
