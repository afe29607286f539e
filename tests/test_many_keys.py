"""Exports beyond what one JSON text holds, and XOR filters of a given number of shards."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.hashing import PORTABLE
from quarry.operators import frequency
from quarry.operators.frequency import TopK
from quarry.operators.xor_filter import XorFilter, XorParams
from quarry.plans import queries as plans


def test_topk_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frequency, "EXPORTED", 100)
    df = spark.range(500).select(F.concat(F.lit('a "\n'), F.col("id") % 300).alias("e"), "id")
    t = TopK.build(df, "e", "id", 7)
    with pytest.raises(ValueError):
        t.to_json()
    t.to_json_lines().write.text(str(tmp_path / "t"))
    back = TopK.from_json_lines(spark.read.text(str(tmp_path / "t")))
    assert back.equals(t) and back.add(df, "e", "id").equals(t.add(df, "e", "id"))
    none = TopK.from_json_lines(t.clear().to_json_lines())
    assert none.k == 7 and none.state.count() == 0 and none.equals(t.clear())
    undated = TopK.build(df.withColumn("id", F.when(F.col("id") > 250, F.col("id"))), "e", "id", 7)
    assert TopK.from_json_lines(undated.to_json_lines()).equals(undated)


def test_topk_json_goes_on_beyond_one_text(spark, sf, monkeypatch):
    want = sorted(map(tuple, plans.QUERIES["topk_json_goes_on"](spark, sf).collect()))
    monkeypatch.setattr(frequency, "EXPORTED", 5)
    assert sorted(map(tuple, plans.QUERIES["topk_json_goes_on"](spark, sf).collect())) == want


def test_xor_in_one_shard(spark):
    keys = spark.range(2000).select(F.col("id").cast("string").alias("e"))
    f = XorFilter.build(keys, "e", XorParams(16, shard_keys=500, spec=PORTABLE), shards=1)
    assert f.shards == 1 and f.state.count() == 1 and f.probe(keys, "e").where("has").count() == 2000


def test_xor_geometry_of_more_keys_than_a_shard_takes(spark, tmp_path):
    spark.range(300_000).select(F.col("id").alias("p_partkey"), F.lit(30).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    slots = int(1.23 * 300_000 + 32) // 3 * 3
    assert [tuple(r) for r in plans.QUERIES["xor_geometry"](spark, str(tmp_path)).collect()] == [(0, slots // 3, slots)]
