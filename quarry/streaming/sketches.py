"""Sketches over streams.

The states of the monoid sketches are grouped aggregates, so their build() works on a streaming
DataFrame as it is: state is bounded by the number of cells, and with windows by the watermark.
Ordered filters keep one table a shard as keyed state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.hashing import element
from quarry.operators.cuckoo import CuckooFilter, CuckooParams, Table


def read_files(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def windowed(stream: DataFrame, ts: str, late: str, size: str, slide: str | None = None) -> DataFrame:
    """The stream with a column window_start, rows later than `late` being dropped by the watermark.

    Group any sketch by ("window_start",). A time without zone is taken as it stands: only
    timestamps with zone can bear a watermark.
    """
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.withColumn("window", F.window(ts, size, slide) if slide else F.window(ts, size)).withColumn("window_start", F.col("window.start"))


def sessions(stream: DataFrame, ts: str, late: str, gap: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, session, n): sessions of events less than gap apart."""
    stamped = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(*keys, F.session_window(ts, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def drain(state: DataFrame, name: str, mode: str = "complete", checkpoint: str | None = None) -> DataFrame:
    """Run a streaming state over all that is there and return it as a table in memory. For bounded states."""
    writer = state.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    query = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
    query.awaitTermination()
    return state.sparkSession.table(name)


def drain_to(state: DataFrame, path: str) -> DataFrame:
    """Run a streaming state over all that is there into a Parquet table of states of any size; the last batch's whole state stands there at the end."""

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state")

    writer = state.writeStream.outputMode("complete").foreachBatch(keep).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{path}/checkpoint").start().awaitTermination()
    return state.sparkSession.read.schema(state.schema).parquet(f"{path}/state")


def upsert(stream: DataFrame, build, path: str, checkpoint: str):
    """Fold a stream into a stored sketch, batch by batch: build(batch) makes a sketch, the stored one is merged with it.

    Versions alternate under path; the pointer names the batch it holds, so that a batch that is
    run again after a failure isn't folded twice.
    """
    from quarry.sources.store import load, save

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        pointer = fs.Path(f"{path}/pointer")
        exists = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(pointer)
        last = json.loads(spark.read.text(f"{path}/pointer").first()[0]) if exists else None
        if last and last["batch"] >= batch_id:
            return
        sketch = build(batch)
        merged = load(spark, f"{path}/{last['version']}").merge(sketch) if last else sketch
        version = f"v{batch_id % 2}"
        save(merged, f"{path}/{version}")
        spark.createDataFrame([(json.dumps({"batch": batch_id, "version": version}),)], "p string").coalesce(1).write.mode("overwrite").text(f"{path}/pointer")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def cuckoo_stream(stream: DataFrame, column: str, order: str, params: CuckooParams, op: str | None = None) -> DataFrame:
    """(shard, used, rejected, buckets) after each batch, buckets being JSON; within a batch elements go in the given order."""
    shard, fp, first, _ = CuckooFilter(params, stream).locations(element(column, dict(stream.dtypes)[column]))
    sign = F.lit(True) if op is None else F.coalesce(F.col(op) != "-", F.lit(True))
    rows = stream.where(F.col(column).isNotNull()).select(shard.alias("shard"), fp.alias("fp"), first.alias("i"), sign.alias("plus"), F.col(order).alias("o"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shard = int(key[0])
        table, rejected = Table(params, shard), 0
        if state.exists:
            rejected, held = state.get[0], json.loads(state.get[1])
            for bucket, slots in zip(table.buckets, held, strict=True):
                bucket.slots = slots
        for fp, i, plus, _ in sorted((r for f in frames for r in f[["fp", "i", "plus", "o"]].itertuples(index=False, name=None)), key=lambda r: r[3]):
            if plus:
                rejected += not table.add(int(fp), int(i))
            else:
                table.remove(int(fp), int(i))
        text = json.dumps([b.slots for b in table.buckets])
        state.update((rejected, text))
        yield pd.DataFrame({"shard": [shard], "used": [sum(b.length for b in table.buckets)], "rejected": [rejected], "buckets": [text]})

    return rows.groupBy("shard").applyInPandasWithState(step, "shard int, used long, rejected long, buckets string", "rejected long, buckets string", "update", GroupStateTimeout.NoTimeout)
