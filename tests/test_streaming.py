"""Streams give what batches give."""

from pyspark.sql import functions as F

from quarry.operators.bits import same_rows
from quarry.operators.bloom import BloomParams, CountingBloomFilter
from quarry.operators.cardinality import HLLParams, HyperLogLog
from quarry.operators.cuckoo import CuckooFilter, CuckooParams
from quarry.operators.frequency import CMSParams, CountMinSketch
from quarry.sources.store import load
from quarry.streaming.sketches import cuckoo_stream, drain, drain_to, read_files, sessions, upsert, windowed


def test_monoids(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = lambda: read_files(spark, sf, "events.parquet")
    for name, build in (
        ("hll", lambda df: HyperLogLog.build(df, "user_id", HLLParams(64), ("event_type",)).state),
        ("cms", lambda df: CountMinSketch.build(df, "user_id", CMSParams(50, 3)).state),
        ("cb", lambda df: CountingBloomFilter.build(df, "user_id", BloomParams(500, 3)).state),
    ):
        assert same_rows(drain(build(stream()), f"m_{name}"), build(batch))


def test_drain_to_a_table(spark, sf, tmp_path):
    build = lambda df: CountMinSketch.build(df, "user_id", CMSParams(50, 3)).state
    got = drain_to(build(read_files(spark, sf, "events.parquet")), str(tmp_path / "out"))
    assert same_rows(got, build(spark.read.parquet(f"{sf}/events.parquet")))


def test_windows_and_sessions(spark, sf):
    stream = windowed(read_files(spark, sf, "events.parquet"), "ts", "1 hour", "1 hour")
    got = drain(HyperLogLog.build(stream, "user_id", HLLParams(64), ("window_start",)).state, "w")
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("window_start", F.date_trunc("hour", F.col("ts").cast("timestamp")))
    assert same_rows(got, HyperLogLog.build(batch, "user_id", HLLParams(64), ("window_start",)).state)
    n = drain(sessions(read_files(spark, sf, "events.parquet"), "ts", "1 hour", "10 minutes", ("user_id",)), "s").agg(F.sum("n")).first()[0]
    assert n == spark.read.parquet(f"{sf}/events.parquet").count()


def test_upsert(spark, tmp_path):
    p = HLLParams(64)
    build = lambda df: HyperLogLog.build(df, "id", p)
    for k in range(3):
        spark.range(100 * k, 100 * k + 150).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        upsert(stream, build, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    import json

    head = json.loads(spark.read.text(str(tmp_path / "out" / "pointer")).first()[0])
    assert load(spark, str(tmp_path / "out" / head["version"])).equals(build(spark.range(350)))


def test_cuckoo_stream(spark, tmp_path):
    rows = spark.range(300).select(F.col("id").cast("string").alias("e"), F.col("id").alias("seq"))
    rows.write.parquet(str(tmp_path / "in"))
    p = CuckooParams(128, 12)
    stream = spark.readStream.schema("e string, seq long").parquet(str(tmp_path / "in"))
    got = drain(cuckoo_stream(stream, "e", "seq", p), "ck", "update").orderBy(F.desc("used")).first()
    assert got.used == CuckooFilter.build(rows, "e", "seq", p).length() == 300 and got.rejected == 0
