"""Models and services behind factories: batched calls per partition, with retries and defined fallbacks.

A factory is a picklable callable that gives, on the executor, a function from
a list of texts to a list of values. It is called once per partition.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Factory = Callable[[], Callable[[list[str]], list]]


def noop() -> Callable[[list[str]], list]:
    return lambda texts: list(texts)


def http_json(endpoint: str, model: str, timeout: float = 60.0) -> Factory:
    """A chat-completion service that answers {"items": [...]}, one value for each text in order."""

    def make():
        def call(texts: list[str]) -> list:
            body = {"model": model, "temperature": 0, "messages": [{"role": "user", "content": json.dumps({"texts": texts}, ensure_ascii=False)}]}
            request = urllib.request.Request(endpoint, json.dumps(body).encode(), {"Content-Type": "application/json"})
            with urllib.request.urlopen(request, timeout=timeout) as r:
                answer = json.loads(r.read())["choices"][0]["message"]["content"]
            items = json.loads(answer)["items"]
            if len(items) != len(texts):
                raise ValueError("the service returned another number of items")
            return items

        return call

    return make


def batches(values: list[str], rows: int, chars: int) -> Iterator[list[str]]:
    """Consecutive batches of at most so many rows and characters; a longer text stands alone."""
    held, size = [], 0
    for v in values:
        if held and (len(held) >= rows or size + len(v) > chars):
            yield held
            held, size = [], 0
        held.append(v)
        size += len(v)
    if held:
        yield held


#: What a service may do: be out of reach or slow, give an answer that does not parse or lacks a part.
FAULTS = (OSError, ValueError, LookupError)


def apply_service(df: DataFrame, text: str, factory: Factory, output: str, kind: str = "string", rows: int = 16, chars: int = 20_000, retries: int = 2, pause: float = 0.5) -> DataFrame:
    """Adds output and status (ok, retried, failed). A batch that fails is tried again, then its rows one by one; a failed row gives null.

    Only faults of services and of their answers (FAULTS) count as failures; other errors of a factory or a call end the query.
    """

    def attempt(call, batch):
        for k in range(retries + 1):
            try:
                return call(batch)
            except FAULTS:
                if k == retries:
                    return None
                time.sleep(pause * (k + 1))

    def run(frames):
        call = factory()
        for pdf in frames:
            got, status = [], []
            for batch in batches(pdf[text].fillna("").tolist(), rows, chars):
                values = attempt(call, batch)
                if values is not None:
                    got += values
                    status += ["ok"] * len(batch)
                    continue
                for one in batch:
                    v = attempt(call, [one])
                    got.append(v[0] if v else None)
                    status.append("retried" if v else "failed")
            yield pdf.assign(**{output: pd.Series(got, index=pdf.index, dtype=object), "status": status})

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema, *T._parse_datatype_string(f"{output} {kind}, status string")])
    return df.mapInPandas(run, schema)


def with_predictions(df: DataFrame, predictions: DataFrame, key: str, index: str, columns: list[str]) -> DataFrame:
    """Left join by key, else by row position; rows that neither finds have nulls."""
    # One prediction a key and one a place: the last one by place, of several there the greatest.
    found = F.max(F.struct(F.col(index).alias("__at"), *columns))
    by_key = predictions.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(found.alias("__x"))
    by_place = predictions.where(F.col(index).isNotNull()).groupBy(F.col(index).alias("__i")).agg(found.alias("__y"))
    j = df.join(by_key, F.col(key) == F.col("__k"), "left").join(by_place, F.col(index) == F.col("__i"), "left")
    return j.withColumn("__z", F.coalesce("__x", "__y")).select(*df.columns, *(F.col(f"__z.{c}").alias(c) for c in columns))
