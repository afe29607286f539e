"""Sketches in storage: states as Parquet with their parameters beside them, and JSON for interchange."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import fields

from pyspark.sql import SparkSession

from quarry.functions.hashing import SPECS, HashSpec
from quarry.operators import bloom, cardinality, cuckoo, frequency, reconcile, similarity, xor_filter

#: The interchange types and the classes that read them.
TYPES = {
    "BloomFilter": bloom.BloomFilter,
    "CountingBloomFilter": bloom.CountingBloomFilter,
    "PartitionedBloomFilter": bloom.PartitionedBloomFilter,
    "ScalableBloomFilter": bloom.ScalableBloomFilter,
    "XorFilter": xor_filter.XorFilter,
    "CuckooFilter": cuckoo.CuckooFilter,
    "InvertibleBloomFilter": reconcile.IBLT,
    "HyperLogLog": cardinality.HyperLogLog,
    "CountMinSketch": frequency.CountMinSketch,
    "TopK": frequency.TopK,
    "MinHash": similarity.MinHash,
}
PARAMS = {c.__name__: c for c in (bloom.BloomParams, bloom.PartitionedParams, bloom.ScalableParams, xor_filter.XorParams, cuckoo.CuckooParams, reconcile.IBLTParams, cardinality.HLLParams, frequency.CMSParams)}


def scratch(spark: SparkSession) -> str:
    """A new folder in what spark.checkpoint.dir names, deleted when the session's JVM ends; in a local session without that setting a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="quarry-")
    path = f"{top}/quarry-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def from_json(spark: SparkSession, text: str):
    """Any exported sketch."""
    kind = json.loads(text).get("type")
    if kind not in TYPES:
        raise ValueError(f"unknown type {kind!r}")
    return TYPES[kind].from_json(spark, text)


def _plain(value):
    return value.name if isinstance(value, HashSpec) else value


def save(sketch, path: str) -> None:
    """Write a sketch's state and parameters; the state stays distributed, whatever its size."""
    if type(sketch) is frequency.SketchedTopK:  # its sketch beside it
        save(sketch.sketch, f"{path}/sketch")
    kind = next(k for k, c in TYPES.items() if isinstance(sketch, c) and (type(sketch) is c or c is frequency.TopK))
    head = {"type": kind, "sketched": type(sketch) is frequency.SketchedTopK, "by": list(getattr(sketch, "by", ()))}
    if (p := getattr(sketch, "params", None)) is not None:
        head |= {"params": type(p).__name__, "values": {f.name: _plain(getattr(p, f.name)) for f in fields(p)}}
    head |= {k: getattr(sketch, k) for k in ("k", "family", "shards", "generations", "overflow") if hasattr(sketch, k)}
    sketch.state.write.mode("overwrite").parquet(f"{path}/state")
    spark = sketch.state.sparkSession
    spark.createDataFrame([(json.dumps(head),)], "head string").coalesce(1).write.mode("overwrite").text(f"{path}/head")


def load(spark: SparkSession, path: str):
    """A sketch that save() wrote."""
    head = json.loads(spark.read.text(f"{path}/head").first()[0])
    state, by = spark.read.parquet(f"{path}/state"), tuple(head["by"])
    kind = TYPES[head["type"]]
    if kind is frequency.TopK and head.get("sketched"):
        return frequency.SketchedTopK(head["k"], load(spark, f"{path}/sketch"), state)
    if kind is frequency.TopK:
        return kind(head["k"], state, by)
    if kind is similarity.MinHash:
        return kind(head["family"], state, by)
    values = head["values"]
    p = PARAMS[head["params"]](**{k: SPECS[v] if k == "spec" else v for k, v in values.items()})
    if kind is bloom.ScalableBloomFilter:
        return kind(p, state, head["generations"])
    if kind is xor_filter.XorFilter:
        return kind(p, head["shards"], state)
    return kind(p, state, head.get("overflow", False)) if kind is cuckoo.CuckooFilter else kind(p, state, by)


