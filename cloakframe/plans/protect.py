"""Whole runs: a CSV in, a CSV of the same shape out, with a manifest and an audit."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.operators import compare, privatize
from cloakframe.sources import files

TEXT_NAMES = ("text", "body_text", "comment", "content", "message", "post", "tweet")
AUTHOR_NAMES = ("author", "author_id", "user", "user_id", "username", "source")
LABEL_NAMES = ("hs", "label", "gold_label", "is_hate_speech", "hate", "class")


def pick(columns: list[str], wanted: str | None, names: tuple) -> str | None:
    """A column asked for (null if it is missing), else the first known name, else the first that contains one."""
    if wanted:
        return wanted if wanted in columns else None
    low = {c.lower(): c for c in reversed(columns)}
    return next((low[n] for n in names if n in low), None) or next((c for c in columns if any(n in c.lower() for n in names)), None)


def protected(df: DataFrame, text: str, with_style: bool = False, author: str | None = None, index: str = "row_index") -> DataFrame:
    """The same rows and columns with the text column rewritten; author: values that an author repeats are masked first, wherever they stand."""
    names = df.columns
    if author:
        masked = privatize.author_group_mask(df, author, text, index).select(F.col(index).alias("__index"), F.col("text").alias("__masked"))
        df = df.join(masked, F.col(index) == F.col("__index"), "left").withColumn(text, F.coalesce("__masked", F.col(text)))
    return df.withColumn(text, privatize.privatize(F.col(text), with_style)["text"]).select(*names)


def run(spark: SparkSession, source: str, target: str, text: str | None = None, manifest: str | None = None, with_style: bool = False, author: str | None = None) -> dict:
    """Writes the protected CSV and, if asked for, its manifest; raises if the result differs in anything but the text.

    A finished run is reused if its manifest names the same input and settings.
    """
    digest, config = files.sha256_file(source), files.stable_hash({"text": text, "with_style": with_style, "author": author})
    old = files.read_json(manifest) if manifest else None
    if old and old.get("input") == digest and old.get("config") == config and os.path.exists(target) and files.sha256_file(target) == old.get("output"):
        return old | {"reused": True}
    rows = files.read_csv(spark, source)
    names = [c for c in rows.columns if c != "row_index"]
    column = pick(names, text, TEXT_NAMES)
    if column is None:
        raise ValueError("no text column")
    n = files.write_csv(protected(rows, column, with_style, author), target, names)
    issues = {r.code: r.n for r in compare.validate_exact(rows, files.read_csv(spark, target), "row_index", [column]).collect()}
    if set(issues) - {"text_changed"}:
        raise ValueError(f"the result differs from its source: {issues}")
    done = {"input": digest, "config": config, "output": files.sha256_file(target), "rows": n, "text_column": column, "changed": issues.get("text_changed", 0)}
    if manifest:
        files.write_json(manifest, done, sort_keys=True)
    return done | {"reused": False}
