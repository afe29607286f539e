"""A scalable filter of many generations is probed without exploding its positions."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.hashing import PORTABLE, XXH64
from quarry.operators.bloom import ScalableBloomFilter, ScalableParams


@pytest.mark.parametrize("spec", [XXH64, PORTABLE])
def test_words_say_what_the_join_says(spark, spec):
    keys = spark.range(4000).select(F.col("id").cast("string").alias("e"))
    f = ScalableBloomFilter.build(keys.where("e % 2 = 0"), "e", ScalableParams(64, 0.05, spec=spec)).add(keys.where("e % 2 = 1"), "e")
    asked = spark.range(9000).select(F.when(F.col("id") % 10 > 0, F.col("id")).cast("string").alias("e"), "id")
    got, by_join = f.probe(asked, "e"), f.probe(asked, "e", packed_bits=0)
    assert f.generations > 4 and sorted(map(tuple, got.select("id", "has").collect())) == sorted(map(tuple, by_join.select("id", "has").collect()))
    assert got.where("e < 4000 AND has").count() == keys.where("e % 10 > 0").count() and "Generate explode" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin" not in plan
