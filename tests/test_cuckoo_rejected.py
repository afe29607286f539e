"""The cuckoo semi-join stays exact where the filter had no place for some keys."""

from quarry.operators.cuckoo import CuckooFilter, CuckooParams


def test_semi_join_with_rejected_keys(spark):
    keys = spark.range(60).withColumnRenamed("id", "k")
    f = CuckooFilter.build(keys, "k", "k", CuckooParams(8, 16, 2, 5, 2))
    assert f.load().first().n_rejected > 0
    rows = spark.range(200).selectExpr("id AS v", "id AS k")
    for g in (f, CuckooFilter.from_json(spark, f.to_json())):
        assert sorted(r.v for r in g.semi_join(rows, "k", keys, "k").collect()) == list(range(60))
