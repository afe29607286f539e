"""Membership filters: no false negatives, bounded false positives, algebra, interchange."""

import math

import pytest
from pyspark.sql import functions as F

from quarry.operators.bits import BitSet
from quarry.operators.bloom import BloomFilter, BloomParams, CountingBloomFilter, PartitionedBloomFilter, PartitionedParams, ScalableBloomFilter, ScalableParams
from quarry.operators.cuckoo import Bucket, CuckooFilter, CuckooParams, Table
from quarry.operators.xor_filter import XorFilter, XorParams
from quarry.sources.store import from_json, load, save


def items(spark, a, b):
    return spark.range(a, b).select(F.col("id").cast("string").alias("e"))


def share(f, df):
    return f.probe(df, "e").agg(F.avg(F.col("has").cast("int"))).first()[0]


def at_most(p, n):
    return p + 4 * math.sqrt(p * (1 - p) / n)


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "e string")


# ------------------------------------------------------------------ bit sets

def test_bit_set(spark):
    s = BitSet.of(spark.range(0, 56, 3), "id", 50)
    assert s.size == 56 and s.max() == 54 and s.bit_count() == 19
    back = BitSet.from_json(spark, s.to_json())
    assert back.equals(s) and not back.equals(BitSet(64, s.state))
    assert BitSet(8, s.state.limit(0)).max() == 0
    assert s.add(spark.createDataFrame([(1000,)], "id long"), "id").equals(s)  # out of range
    assert [r.has for r in s.has(spark.range(4), "id").orderBy("id").collect()] == [True, False, False, True]
    with pytest.raises(ValueError):
        BitSet.from_json(spark, '{"size": 8, "content": 3}')


def test_packed_layout(spark):
    r = BitSet.of(spark.createDataFrame([(0,), (9,), (17,)], "i long"), "i", 24).packed().first()
    assert bytes(r.bitmap[:3]).hex() == "010202"


# ------------------------------------------------------------------ Bloom

@pytest.mark.parametrize("packed_bits", [1 << 24, 0])
def test_bloom_rates(spark, packed_bits):
    f = BloomFilter.from_items(items(spark, 0, 10_000), "e", 0.01)
    has = lambda df: f.probe(df, "e", packed_bits=packed_bits).agg(F.avg(F.col("has").cast("int"))).first()[0]
    assert f.params.size == 95_851 and has(items(spark, 0, 10_000)) == 1.0
    assert has(items(spark, 10_000, 110_000)) <= at_most(0.01, 100_000)
    assert 0 < f.rate() < 0.02


def test_bloom_small(spark):
    f = BloomFilter.build(words(spark, "alice", "bob", "alice", None), "e", BloomParams.create(15, 0.1))
    assert 0 < f.set_bits() <= 2 * f.params.hashes
    got = {r.e: r.has for r in f.probe(words(spark, "alice", "bob", "zed", None), "e").collect()}
    assert got["alice"] and got["bob"] and got[None] is False
    with pytest.raises(ValueError):
        BloomParams(15, 0)


@pytest.mark.parametrize("parts", [1, 8])
def test_bloom_algebra(spark, parts):
    p = BloomParams(2000, 4)
    build = lambda a, b: BloomFilter.build(items(spark, a, b).repartition(parts), "e", p)
    a, b, c, ab = build(0, 100), build(50, 150), build(150, 200), build(0, 150)
    assert a.merge(b).equals(b.merge(a)) and a.merge(b).equals(ab) and a.merge(a).equals(a)
    assert a.merge(b).merge(c).equals(a.merge(b.merge(c))) and a.add(items(spark, 50, 150), "e").equals(ab)
    assert not a.equals(b) and not a.equals(BloomFilter.build(items(spark, 0, 100), "e", BloomParams(2000, 4, seed=1)))


def test_seed_zero_counts(spark):
    a, b = (BloomFilter.build(items(spark, 0, 50), "e", BloomParams(500, 3, seed=s)) for s in (0, 5))
    assert not a.equals(BloomFilter(a.params, b.state))


def test_grouped_probe(spark):
    df = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "3")], "g string, e string")
    f = BloomFilter.build(df, "e", BloomParams(5000, 5), ("g",))
    probe = spark.createDataFrame([("x", "1"), ("x", "3"), ("y", "3"), ("z", "1"), ("x", None)], "g string, e string")
    assert {(r.g, r.e): r.has for r in f.probe(probe, "e").collect()} == {("x", "1"): True, ("x", "3"): False, ("y", "3"): True, ("z", "1"): False, ("x", None): False}


def test_legacy_bits(spark):
    f = BloomFilter.build(items(spark, 0, 20), "e", BloomParams(100, 3))
    on = {r.bit for r in f.state.collect()}
    import json

    text = json.dumps(json.loads(f.to_json()) | {"_filter": [int(i in on) for i in range(100)]})
    assert BloomFilter.from_json(spark, text).equals(f)


def test_counting(spark):
    log = spark.createDataFrame([("+", "alice"), ("+", "bob"), ("+", "carl"), ("-", "bob")], "op string, e string")
    f = CountingBloomFilter.build(log, "e", BloomParams.create(15, 0.001), op="op")
    got = {r.e: r.has for r in f.probe(words(spark, "alice", "bob", "carl"), "e").collect()}
    assert got == {"alice": True, "bob": False, "carl": True} and f.n_items() == 2 and f.negative_cells() == 0
    g = f.remove(words(spark, "nobody"), "e")
    assert g.n_items() == 1 and g.negative_cells() > 0 and g.add(words(spark, "nobody"), "e").equals(f)
    big = CountingBloomFilter.from_items(items(spark, 0, 1000), "e", 0.01)
    assert share(big, items(spark, 0, 1000)) == 1.0 and share(big, items(spark, 1000, 11_000)) <= at_most(0.011, 10_000)
    assert 0 < big.rate() < 0.02


def test_partitioned(spark):
    f = PartitionedBloomFilter.from_items(items(spark, 0, 10_000), "e", 0.001)
    assert f.params.slices == 10 and f.params.slice_bits == 14_378 and f.params.capacity >= 10_000
    assert share(f, items(spark, 0, 10_000)) == 1.0 and share(f, items(spark, 10_000, 110_000)) <= at_most(0.0015, 100_000)
    assert 0.4 < f.load() < 0.6 and f.slices().agg(F.max("idx")).first()[0] < 14_378


def test_null_is_in_no_filter(spark):
    """Not even in one whose bits are all set."""
    full = lambda n: spark.range(n).withColumnRenamed("id", "bit")
    df = spark.createDataFrame([("a",), (None,)], "e string")
    p = PartitionedParams.create(4, 0.1)
    all_set = (BloomFilter(BloomParams(64, 3), full(64)), PartitionedBloomFilter(p, full(p.slices * p.slice_bits)), ScalableBloomFilter(ScalableParams(4, 0.1), full(200).withColumn("generation", F.lit(0)), 1))
    for f in all_set:
        assert {r.e: r.has for r in f.probe(df, "e").collect()} == {"a": True, None: False}


def test_scalable_growth(spark):
    """10,243 insertions into a filter of 128 at 0.0001 make six generations."""
    names = ["alice", "bob", "carl", *map(str, range(10_240))]
    df = spark.createDataFrame(list(enumerate(names)), "seq long, e string")
    f = ScalableBloomFilter.build_ordered(df, "e", "seq", ScalableParams(128, 0.0001))
    assert f.generations == 6 and share(f, df) == 1.0
    # slices of m bits know m^2 pairs of hashes, so that double hashing adds n / m^2 a generation to the rate
    assert share(f, items(spark, 20_000, 40_000)) <= 0.01
    assert f.current.params.slices >= 14 and f.current.state.count() > 0
    g = ScalableBloomFilter.build(df, "e", ScalableParams(128, 0.0001))
    assert share(g, df) == 1.0 and g.capacity() >= len(names) and g.rate()["any"] < 0.01


def test_scalable_grows_after_the_build(spark):
    """Added in three parts, and many times over: no false negatives, rates as planned, generations as needed."""
    f = ScalableBloomFilter.build(items(spark, 0, 100), "e", ScalableParams(128, 0.001))
    assert f.generations == 1
    for lo, hi in ((100, 130), (130, 4000), (0, 4000)):
        before = f.generations
        f = f.add(items(spark, lo, hi), "e")
        assert f.generations >= before
    assert share(f, items(spark, 0, 4000)) == 1.0 and f.capacity() >= 4000 and share(f, items(spark, 10_000, 30_000)) <= 0.02
    assert all(g.load() < 0.6 for g in f.filters()) and f.generations == len(ScalableParams(128, 0.001).plan_for(4000))
    g = f.merge(ScalableBloomFilter.build(items(spark, 5000, 5200), "e", ScalableParams(128, 0.001)))
    assert share(g, items(spark, 0, 4000)) == 1.0 == share(g, items(spark, 5000, 5200)) and g.generations == f.generations
    with pytest.raises(ValueError):
        f.merge(ScalableBloomFilter.build(items(spark, 0, 9), "e", ScalableParams(128, 0.01)))


def test_ordered_growth_has_no_last_generation(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(3000)], "seq long, e string")
    f = ScalableBloomFilter.build_ordered(df, "e", "seq", ScalableParams(1, 0.5, 0.9))
    assert share(f, df) == 1.0 and f.generations == len(list(f.filters()))


def test_filters_reach_the_scan_below_a_probe(spark, tmp_path):
    df = items(spark, 0, 100).withColumn("id", F.col("e").cast("long"))
    df.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    for f in (BloomFilter.build(df, "e", BloomParams(2000, 4)), ScalableBloomFilter.build(df, "e", ScalableParams(2000, 0.01))):
        plan = f.probe(stored, "e").where("has AND id = 5")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(id,5)" in plan
        assert [r.e for r in f.probe(stored, "e").where("has AND id = 5").collect()] == ["5"]


def test_scalable_of_one_generation(spark):
    """Few enough positions for the packed path."""
    f = ScalableBloomFilter.build(items(spark, 0, 1000), "e", ScalableParams(2000, 0.01))
    assert f.generations == 1 and share(f, items(spark, 0, 1000)) == 1.0 and share(f, items(spark, 5000, 15_000)) <= 0.02
    assert [r.has for r in f.probe(words(spark, None, "1"), "e").orderBy("e").collect()] == [False, True]


# ------------------------------------------------------------------ XOR and cuckoo

@pytest.mark.parametrize("width", [8, 16, 32, 64])
def test_xor(spark, width):
    keys = spark.range(1000).select(F.concat(F.lit("hash:"), "id").alias("e"))
    other = spark.range(10_000, 20_000).select(F.concat(F.lit("hash:"), "id").alias("e"))
    f = XorFilter.build(keys.unionAll(keys.limit(5)), "e", XorParams(width))
    assert share(f, keys) == 1.0 and share(f, other) <= at_most(2.0**-width, 10_000)
    assert from_json(spark, f.to_json()).equals(f)


def test_xor_shards_and_errors(spark):
    f = XorFilter.build(items(spark, 0, 3000), "e", XorParams(8, shard_keys=500))
    assert f.shards == 6 and share(f, items(spark, 0, 3000)) == 1.0
    with pytest.raises(ValueError):
        XorParams(12)
    with pytest.raises(ValueError):
        XorFilter.build(items(spark, 0, 0), "e")


def test_bucket():
    b = Bucket(3)
    assert b.add("foo") and b.add("bar") and b.length == 2 and b.next_empty_slot() == 2 and b.has("foo") and not b.add(None)
    assert b.add("moo") and not b.add("boo") and not b.is_free() and b.next_empty_slot() == -1
    assert b.remove("bar") and not b.remove("bar") and b.at(1) is None and b.swap(0, "x") == "foo" and b.has("x")
    b.set(1, "y")
    b.unset(0)
    assert b.slots == [None, "y", "moo"] and b.equals(Bucket(3, [None, "y", "moo"])) and not b.equals(Bucket(3))


def test_cuckoo_after_kicks(spark):
    """Elements that were moved away are still found, at a load that needs many moves."""
    df = spark.range(1900).select(F.col("id").cast("string").alias("e"), F.col("id").alias("seq"))
    f = CuckooFilter.build(df, "e", "seq", CuckooParams(512, 16))
    load = f.load().first()
    assert load.load > 0.9 and load.n_rejected == 0 and share(f, df) == 1.0
    assert share(f, items(spark, 5000, 25_000)) <= at_most(f.rate(), 20_000)


def test_cuckoo_changelog(spark):
    log = [(1, "+", "foo"), (2, "+", "foo"), (3, "-", "foo"), (4, "+", "bar"), (5, "-", "bar"), (6, "-", "never"), (7, "+", None)]
    f = CuckooFilter.build(spark.createDataFrame(log, "seq long, op string, e string"), "e", "seq", CuckooParams(16, 12), op="op")
    assert {r.e: r.has for r in f.probe(words(spark, "foo", "bar", None), "e").collect()} == {"foo": True, "bar": False, None: False}
    assert f.length() == 1 and CuckooFilter.build(spark.createDataFrame([], "seq long, e string"), "e", "seq", CuckooParams(4, 8)).rate() == 0.0


def test_cuckoo_goes_on(spark):
    """Added to, removed from and merged after the build, over several shards, one of them new."""
    seq = lambda df: df.withColumn("seq", F.col("e").cast("long"))
    p = CuckooParams(256, 14, shards=3)
    f = CuckooFilter.build(seq(items(spark, 0, 1)), "e", "seq", p).add(seq(items(spark, 1, 900)), "e", "seq")
    g = f.merge(CuckooFilter.build(seq(items(spark, 900, 1500)), "e", "seq", p)).remove(items(spark, 0, 500), "e")
    assert f.length() == 900 and g.length() == 1000 and g.load().first().n_rejected == 0
    assert share(g, items(spark, 500, 1500)) == 1.0 and share(g, items(spark, 0, 500)) <= at_most(p.rate(), 500) and g.equals(CuckooFilter(p, g.state))
    full = CuckooFilter.build(seq(items(spark, 0, 40)), "e", "seq", CuckooParams(4, 8, 2, 5))
    both = full.merge(full)
    assert both.load().first().n_rejected + both.length() == 80
    with pytest.raises(ValueError):
        f.merge(full)


@pytest.mark.parametrize("destructive", [False, True])
def test_cuckoo_rollback(destructive):
    """A full table rejects; without destructive it stays as it was, with it the moves stay."""
    t = Table(CuckooParams(2, 8, bucket_size=1, max_kicks=3), 0)
    for b, fp in enumerate((3, 5)):
        t.buckets[b].set(0, fp)
    before = [list(b.slots) for b in t.buckets]
    assert not t.add(9, 0, destructive)
    assert ([list(b.slots) for b in t.buckets] == before) != destructive


def test_cuckoo_params():
    with pytest.raises(ValueError):
        CuckooParams(10, 8)
    assert CuckooParams.create(20, 1e-9, bucket_size=1).fp_bits == 31


# ------------------------------------------------------------------ storage

def test_save_and_load(spark, tmp_path):
    df = items(spark, 0, 200)
    for i, s in enumerate((BloomFilter.build(df, "e", BloomParams(2000, 3)), PartitionedBloomFilter.build(df, "e", PartitionedParams.create(200, 0.01)), CountingBloomFilter.build(df, "e", BloomParams(2000, 3)), XorFilter.build(df, "e"))):
        save(s, str(tmp_path / str(i)))
        assert load(spark, str(tmp_path / str(i))).equals(s)
    with pytest.raises(ValueError):
        from_json(spark, '{"type": "nothing"}')


def test_scalable_json(spark):
    df = spark.createDataFrame([(i, f"elem:{i}") for i in range(50)], "seq long, e string")
    f = ScalableBloomFilter.build_ordered(df, "e", "seq", ScalableParams(1, 0.1))
    back = from_json(spark, f.to_json())
    assert back.generations == f.generations and share(back, df) == 1.0


# ------------------------------------------------------------------ protocols, draws

def test_protocols(spark):
    from quarry.operators.frequency import CMSParams, CountMinSketch
    from quarry.operators.interfaces import Counting, Membership, Removable, with_seed

    df = items(spark, 0, 5)
    p = BloomParams(100, 2)
    assert isinstance(BloomFilter.build(df, "e", p), Membership) and not isinstance(BloomFilter.build(df, "e", p), Removable)
    assert isinstance(CountingBloomFilter.build(df, "e", p), Removable) and isinstance(CountMinSketch.build(df, "e", CMSParams(10, 2)), Counting)
    other = with_seed(p, 7)
    assert other.seed == 7 and other.size == p.size
    with pytest.raises(ValueError):
        BloomFilter.build(df, "e", p).merge(BloomFilter.build(df, "e", other))


def test_draws(spark):
    from quarry.functions.draws import next_int32, random_int

    got = [r.x for r in spark.range(2000).select(random_int(3, 6, 1).alias("x")).collect()]
    assert set(got) == {3, 4, 5, 6} and got == [r.x for r in spark.range(2000).select(random_int(3, 6, 1).alias("x")).collect()]
    assert spark.range(10).select(next_int32(1).alias("x")).distinct().count() == 10
    with pytest.raises(ValueError):
        random_int(2, 1, 0)
