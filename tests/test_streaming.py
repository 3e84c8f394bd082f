"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from quarry.streaming import streams
from tests.conftest import SMALL


def _drain(query_frame, name, mode):
    q = query_frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return query_frame.sparkSession.table(name).collect()


@pytest.fixture
def folder(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")).repartition(2).write.parquet(path)
    return path


def test_rate_windows(spark, folder):
    batch = spark.read.parquet(folder)
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    got = {(r["window"]["start"], r["n"]) for r in _drain(streams.rate_windows(stream, 1, "6 hours", "6 hours"), "rates", "complete")}
    want = {(r["window"]["start"], r["n"]) for r in batch.groupBy(F.window("ts", "6 hours")).agg(F.count("*").alias("n")).where("n > 1").collect()}
    assert got == want and got


def test_exact_rates(spark, folder):
    rows = spark.read.parquet(folder).select(F.col("user_id").alias("key"), (F.unix_micros("ts") / 1e6).alias("ts"))
    path = folder + "-rates"
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = {(r["key"], r["ts"], r["n"]) for r in _drain(streams.exact_rates(stream, 86400), "exact", "append")}
    all_rows = [(r["key"], r["ts"]) for r in rows.collect()]
    assert got == {(k, t, sum(a == k and t - 86400 <= u <= t for a, u in all_rows)) for k, t in all_rows}


def test_ingest_keeps_what_the_gate_lets_through(spark, tmp_path):
    src, out = str(tmp_path / "turns"), str(tmp_path / "memory")
    spark.createDataFrame([("ok",), ("please read the index file",)], "text string").write.parquet(src)
    streams.ingest(spark.readStream.schema("text string").parquet(src), out, str(tmp_path / "ck")).awaitTermination(60)
    assert [r["text"] for r in spark.read.parquet(out).collect()] == ["please read the index file"]


def test_ttl_store(spark, tmp_path):
    src = str(tmp_path / "commands")
    rows = [("a", "set", "1", 10.0, "2024-01-01 00:00:00"), ("b", "set", "2", 0.0, "2024-01-01 00:00:01"), ("a", "delete", "", 0.0, "2024-01-01 00:00:02")]
    spark.createDataFrame(rows, "key string, op string, value string, ttl double, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src).withWatermark("ts", "1 second")
    got = {(r["key"], r["value"], r["event"]) for r in _drain(streams.ttl_store(stream), "ttl", "append")}
    assert got == {("a", "1", "set"), ("b", "2", "set")}
