"""Structured Streaming variants. The batch columns are stateless, so they hold on streams unchanged."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import privatize as P


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Event times without a zone count as times of the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def privatized(stream: DataFrame, text: str) -> DataFrame:
    """The stream with its text masked."""
    return stream.withColumn(text, P.privatize(F.col(text))["text"])


def decisions(stream: DataFrame, time: str, kind: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Decisions by kind in tumbling windows; rows later than `late` are left out once their window has closed."""
    return _timed(stream, time).withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"))


def distinct_texts(stream: DataFrame, time: str, text: str, late: str = "1 hour") -> DataFrame:
    """The first row of each text within the watermark."""
    return _timed(stream, time).withWatermark(time, late).withColumn("__h", F.sha2(F.col(text), 256)).dropDuplicatesWithinWatermark(["__h"]).drop("__h")


def repeated_values(stream: DataFrame, author: str, value: str) -> DataFrame:
    """author, value, n: each time a value comes again from an author, from its second occurrence on.

    State is one count per author and value; earlier rows are not corrected.
    """

    def count(key, frames, state):
        seen = state.get[0] if state.exists else 0
        before, rows = seen, sum(len(f) for f in frames)
        seen += rows
        state.update((seen,))
        if seen > 1 and rows:
            yield pd.DataFrame({"author": [key[0]], "value": [key[1]], "n": [seen], "new": [before < 2]})

    return stream.groupBy(author, value).applyInPandasWithState(count, "author string, value string, n long, new boolean", "n long", "update", "NoTimeout")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Each micro-batch once, under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
