"""The nearest rows of query vectors, exactly, block by block.

Rows are packed to blocks where they lie; queries are dealt to blocks by hash
and gathered by Spark. Every block of rows meets every block of queries by an
equal join on the number of the query block, and a pair of blocks gives the k
best rows of each query only. Neither the plan nor the driver grows with the
number of queries; the driver learns their count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cloakframe.operators import ranking

ROWS, QUERIES = 4096, 1024  # vectors in a block


def _packed(rows: DataFrame, kind: pa.DataType, ddl: str) -> DataFrame:
    """Rows (ids, vectors): up to ROWS vectors each, as doubles in a row."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column("id")]))
                yield pa.RecordBatch.from_arrays([ids.cast(pa.list_(kind)), pa.array([flat.tobytes()], pa.binary())], names=["ids", "vectors"])

    return rows.mapInArrow(run, f"ids array<{ddl}>, vectors binary")


def _unit(flat: np.ndarray, n: int) -> np.ndarray:
    x = flat.reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def cosine_topk(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, digits: int = 6) -> DataFrame:
    """query_id, id, cosine and rank of the k rows nearest to each query but itself; equal ones by id.

    Vectors count that have as many components as the longest query, none null; zero vectors have cosine 0 with all.
    """
    n, dims = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    ddl, kind = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)

    def good(df: DataFrame) -> DataFrame:
        whole = (F.size("v") == F.lit(dims or 0)) & F.forall("v", lambda x: x.isNotNull())
        return df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(F.col("v").isNotNull() & whole)

    parts = max(1, -(-(n or 0) // QUERIES))
    dealt = good(queries).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    blocks = dealt.groupBy("block").agg(F.collect_list("id").alias("q_ids"), F.flatten(F.collect_list(F.transform("v", lambda x: x.cast("double")))).alias("q_vectors"))
    met = _packed(good(rows), kind, ddl).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(blocks, "block").select("ids", "vectors", "q_ids", "q_vectors")

    def best(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, asked = batch.column("ids")[i].values, batch.column("q_ids")[i].values
                x = _unit(np.frombuffer(batch.column("vectors")[i].as_buffer(), np.float64), len(ids))
                q = _unit(batch.column("q_vectors")[i].values.to_numpy(), len(asked))
                c = np.round(x @ q.T, digits)
                # The same id on both sides is the query itself.
                _, number = np.unique(np.array(ids.to_pylist() + asked.to_pylist(), object).astype(str), return_inverse=True)
                c[number[: len(ids), None] == number[None, len(ids) :]] = -np.inf
                place = np.argsort(np.argsort(np.array(ids.to_pylist(), object), kind="stable"), kind="stable")
                order = np.lexsort((np.broadcast_to(place[:, None], c.shape), -c), axis=0)[:k]
                at = np.broadcast_to(np.arange(len(asked)), order.shape)
                row, col = order.ravel(), at.ravel()
                there = np.isfinite(c[row, col])
                row, col = row[there], col[there]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(col)), ids.take(pa.array(row)), pa.array(c[row, col])], names=["query_id", "id", "cosine"])

    found = met.mapInArrow(best, f"query_id {ddl}, id {ddl}, cosine double")
    return ranking.top_per_group(found, ["query_id"], [F.desc("cosine"), F.col("id")], k)
