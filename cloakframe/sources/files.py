"""File sources and sinks: exact CSV, JSON, JSON-lines caches, digests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.sources import exact_csv


def assert_utf8(path: str) -> None:
    """Raises ValueError with the byte position of the first invalid sequence; reads in blocks."""
    import codecs

    decoder, at = codecs.getincrementaldecoder("utf-8")(), 0
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            try:
                decoder.decode(block)
            except UnicodeDecodeError as e:
                raise ValueError(f"{path}: invalid UTF-8 near byte {at + e.start}") from e
            at += len(block)
        decoder.decode(b"", final=True)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings, an empty cell as '', with row_index (1, 2, ...) in file order; ranges of the file are read in parallel."""
    df = exact_csv.read(spark, path)
    return df.select(*(df[f"`{c}`"] for c in df.columns[1:]), df[df.columns[0]]) if len(set(df.columns)) == len(df.columns) else df


def write_csv(df: DataFrame, path: str, columns: list[str], index: str = "row_index") -> int:
    """One file in row order with the given columns, CRLF line ends and minimal quoting; missing columns are empty. Returns the number of rows."""
    exact_csv.write(df, path, columns, index)
    return df.count()


def write_json(path: str, value, sort_keys: bool = False) -> None:
    """Replaces the file at once, so that a reader sees either the old or the new content."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False, sort_keys=sort_keys)
        f.write("\n")
    os.replace(temp, path)


def read_json(path: str):
    """The value, or None if the file is missing or blank."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        body = f.read()
    return json.loads(body) if body.strip() else None


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def stable_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def read_cache(spark: SparkSession, path: str, schema: str, key: str, order: str = "seq") -> DataFrame:
    """A JSON-lines cache with the last record of each key; broken lines are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x"))
    return best.select(key, F.col(f"x.{order}").alias(order), *(F.col(f"x.{c}").alias(c) for c in rest))


def append_cache(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
