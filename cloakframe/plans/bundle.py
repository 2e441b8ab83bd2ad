"""The whole chain over one table, each stage a Parquet table that is reused if it is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe import resources as R
from cloakframe.functions import text as T
from cloakframe.operators import privatize, review, signals
from cloakframe.sources import files

VERSION = 1  # of what the stages compute; another one makes them again


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def digest(df: DataFrame) -> str:
    """Of a table's rows and columns, whatever their order: a count and two sums of hashes, in one pass."""
    names = sorted(df.columns)
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    sums = [F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")).cast("string") for k in (1, 2)]
    return files.stable_hash({"columns": [(c, df.schema[c].dataType.simpleString()) for c in names], "rows": [str(v) for v in df.agg(F.count("*"), *sums).first()]})


def stage(spark: SparkSession, where: str, name: str, make: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
    """The stage's table; made and written unless a complete one lies there that was made of the same (key; null: whatever it was made of).

    Spark marks a complete write by _SUCCESS; what it was made of is written behind that, so that a run that dies between them makes it again.
    """
    path = f"{where}/{name}"
    fs, done = _file(spark, f"{path}/_SUCCESS")
    _, made_of = _file(spark, f"{path}/_made_of_{key}")
    if not (fs.exists(done) and (key is None or fs.exists(made_of))):
        make().write.mode("overwrite").parquet(path)
        if key is not None:
            fs.create(made_of).close()
    return spark.read.parquet(path)


def run(spark: SparkSession, docs: DataFrame, where: str, key: str, text: str) -> dict[str, DataFrame]:
    """predictions, protected, importance, evidence, audit, cases of a table; stages of another input or other columns are made again."""
    out = {}
    made_of = files.stable_hash({"input": digest(docs), "key": key, "text": text, "version": VERSION})
    out["predictions"] = stage(spark, where, "predictions", lambda: docs.select(key, T.keyword_score(F.col(text)).alias("score")).withColumn("predicted", F.col("score") >= 0.5), made_of)
    out["protected"] = stage(spark, where, "protected", lambda: docs.select(key, privatize.privatize(F.col(text), with_style=True)["text"].alias("protected")), made_of)
    out["importance"] = stage(spark, where, "importance", lambda: signals.token_importance(docs, key, text), made_of)
    out["evidence"] = stage(spark, where, "evidence", lambda: signals.evidence(docs, key, text), made_of)
    both = docs.join(out["protected"], key).join(out["predictions"], key)
    out["audit"] = stage(spark, where, "audit", lambda: review.drift(both, F.col(text), F.col("protected"), F.col("predicted"), list(R.CUES["action"]), [key]), made_of)
    out["cases"] = stage(spark, where, "cases", lambda: review.cases(docs.select(key, text).join(out["protected"], key), out["audit"], key, text), made_of)
    return out
