"""Streams run to their end over files."""

from cloakframe import streaming


def test_masked_stream_and_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    streaming.decisions(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("decided").trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from decided").first()[0] == events.count()
    docs = spark.createDataFrame([(1, "mail a@b.example"), (2, "none")], "id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
    streaming.to_parquet(streaming.privatized(stream, "text"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["mail [EMAIL]", "none"]


def test_repeated_values_stream(spark, tmp_path):
    schema = "author string, value string"
    for k, rows in enumerate(([("a", "x"), ("b", "x")], [("a", "x"), ("b", "y")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streaming.repeated_values(stream, "author", "value").writeStream.outputMode("update").format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.author, r.value, r.n) for r in spark.table("again").collect()] == [("a", "x", 2)]
