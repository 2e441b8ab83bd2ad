"""Windows, joins and timers on streams that run over files, a file a batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cloakframe.streaming import windows

T0 = datetime(2024, 1, 1, 12)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def feed(spark, where, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
        import time

        time.sleep(1.1)  # files are taken in order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(where)


def run(out, spark, name, mode, checkpoint):
    out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


def test_sessions_and_late_rows(spark, tmp_path):
    schema = "user string, ts timestamp"
    batches = [[("a", at(0)), ("a", at(20)), ("b", at(5))], [("a", at(45)), ("a", at(200))], [("c", at(200))], [("a", at(30)), ("b", at(6))], [("z", at(400))], [("z", at(401))]]
    stream = feed(spark, str(tmp_path / "in"), batches, schema)
    got = {(r.user, r.begin, r.end, r.n) for r in run(windows.sessions(stream, "ts", ["user"], "30 minutes", "10 minutes"), spark, "sessions", "append", str(tmp_path / "c"))}
    # Rows of the fourth batch come after the watermark (190) has closed their sessions.
    assert got == {("a", at(0), at(75), 3), ("b", at(5), at(35), 1), ("a", at(200), at(230), 1), ("c", at(200), at(230), 1)}


def test_sliding_windows(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), [[("a", at(1)), ("a", at(6)), ("b", at(11))]], "kind string, ts timestamp")
    got = {(r.kind, r.begin, r.n) for r in run(windows.sliding(stream, "ts", ["kind"]), spark, "slid", "update", str(tmp_path / "c"))}
    assert got == {("a", at(-5), 1), ("a", at(0), 2), ("a", at(5), 1), ("b", at(5), 1), ("b", at(10), 1)}


@pytest.mark.parametrize("how", ["inner", "leftOuter"])
def test_two_streams_within_a_span(spark, tmp_path, how):
    left = feed(spark, str(tmp_path / "l"), [[("a", at(0)), ("b", at(1))], [("c", at(120))], [("d", at(300))], [("e", at(301))], [("f", at(302))]], "k string, asked timestamp")
    right = feed(spark, str(tmp_path / "r"), [[("a", at(5), 1), ("b", at(30), 2)], [("a", at(9), 3), ("c", at(119), 4)], [("x", at(300), 5)], [("b", at(2), 6), ("x", at(301), 7)], [("x", at(302), 8)]], "k string, answered timestamp, v int")
    out = windows.within(left, right, "k", "asked", "answered", "10 minutes", "10 minutes", how).select("k", "v")
    got = {(r.k, r.v) for r in run(out, spark, f"joined_{how}", "append", str(tmp_path / "c"))}
    pairs = {("a", 1), ("a", 3)}
    # b is answered too late, and once behind the watermark of both; c before it was asked.
    assert got == (pairs if how == "inner" else pairs | {("b", None), ("c", None)})


def test_jobs_without_progress_are_interrupted(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = "job_id string, status string, done long, at timestamp"
        batches = [[("a", "running", 1, at(0)), ("b", "running", 1, at(0)), ("c", "running", 5, at(1))], [("b", "running", 7, at(12)), ("c", "completed", 9, at(13))], [("b", "running", 3, at(11)), ("z", "running", 0, at(20))], [("z", "running", 1, at(21))]]
        stream = feed(spark, str(tmp_path / "in"), batches, schema)
        where = str(tmp_path / "out")

        def go(until):
            # A restart from the checkpoint goes on where it ended.
            query = windows.job_states(stream, patience=15 * 60).writeStream.outputMode("update").foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").json(where)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()

        go(None)
        rows = spark.read.json(where).collect()
        last = {r.job_id: (r.status, r.done) for r in sorted(rows, key=lambda r: r.batch)}
        assert last == {"a": ("interrupted", 1), "b": ("running", 7), "c": ("completed", 9), "z": ("running", 1)}
        go(None)
        assert sorted(map(str, spark.read.json(where).collect())) == sorted(map(str, rows))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
