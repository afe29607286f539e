"""A cuckoo filter with overflow keeps every element, however many more than it has slots."""

import pytest
from pyspark.sql import functions as F

from quarry.functions.hashing import PORTABLE
from quarry.operators.cuckoo import CuckooFilter, CuckooParams, Table
from quarry.plans import queries as plans
from quarry.sources.store import from_json, load, save

P = CuckooParams(8, 12, 2, 20, 2, spec=PORTABLE)  # 32 slots


def keys(spark, a, b):
    return spark.range(a, b).withColumnRenamed("id", "k")


def found(f, df):
    return {r.k for r in f.probe(df, "k").where("has").collect()}


def test_all_are_held(spark, tmp_path):
    f = CuckooFilter.build(keys(spark, 0, 200), "k", "k", P, overflow=True)
    assert f.load().first()[:3] == (200, -168, 32) and f.load().first().n_rejected == 0 and found(f, keys(spark, 0, 200)) == set(range(200))
    save(f, str(tmp_path / "f"))
    for g in (from_json(spark, f.to_json()), load(spark, str(tmp_path / "f"))):
        assert g.overflow and g.equals(f) and g.add(keys(spark, 200, 300), "k", "k").length() == 300


def test_added_merged_and_removed(spark):
    build = lambda a, b: CuckooFilter.build(keys(spark, a, b), "k", "k", P, overflow=True)
    f = build(0, 60).merge(build(60, 120)).add(keys(spark, 120, 200), "k", "k").remove(keys(spark, 0, 100), "k")
    want = build(100, 200)
    rows = lambda x: sorted(map(tuple, held(x).collect()))
    assert f.length() == 100 and f.load().first().n_rejected == 0 and rows(f) == rows(want) and found(f, keys(spark, 100, 200)) == set(range(100, 200))


def held(f):
    """Fingerprints with the lesser of their buckets."""
    other = plans.turn(F.col("fp"), f.params.spec).bitwiseAND(F.lit(f.params.buckets - 1).cast("long"))
    return f.state.where("slot >= 0").groupBy("shard", "fp", F.least("bucket", F.col("bucket").bitwiseXOR(other)).alias("low")).count()


def test_table_takes_free_slots_again():
    t = Table(P, 0, overflow=True)
    assert all(t.add(fp, fp % 8) for fp in range(1, 41)) and sum(len(b.slots) for b in t.buckets) >= 40
    assert all(t.remove(fp, fp % 8) for fp in range(1, 31)) and not t.remove(1, 1)
    assert sorted(x for b in t.buckets for x in b.slots if x is not None) == list(range(31, 41))
    assert all(None not in b.slots or len(b.slots) <= P.bucket_size for b in t.buckets)


def test_rejections_are_no_certain_absence(spark):
    """Without overflow a filter that rejected elements doesn't say of any of them that it is certainly not there."""
    f = CuckooFilter.build(keys(spark, 0, 200), "k", "k", P)
    assert f.load().first().n_rejected > 0 and found(f, keys(spark, 0, 200)) == set(range(200))
    assert found(from_json(spark, f.to_json()), keys(spark, 0, 200)) == set(range(200))


@pytest.mark.parametrize("name", ["cuckoo_fingerprints", "cuckoo_added_and_removed", "cuckoo_load", "cuckoo_json", "cuckoo_after_delete"])
def test_more_parts_than_slots(spark, tmp_path, name):
    """The queries over three times as many parts as their filters have slots, against their SQL."""
    import duckdb

    spark.range(100_000).select(F.col("id").alias("p_partkey"), F.lit(30).alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = c.sql(plans.SQL[name]).df()
    got = plans.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.values.tolist())) == sorted(map(repr, want.values.tolist()))
