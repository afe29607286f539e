"""Frequencies, distinct counts, similarity, reconciliation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators.cardinality import HLLParams, HyperLogLog, native_hll, native_hll_estimate
from quarry.operators.bloom import BloomFilter, BloomParams, CountingBloomFilter, PartitionedBloomFilter, PartitionedParams
from quarry.operators.frequency import CMSParams, CountMinSketch, MinHeap, TopK, native_cms, native_top_k
from quarry.operators.reconcile import IBLT, IBLTParams, exact_difference
from quarry.operators.similarity import MinHash
from quarry.sources.store import from_json, load, save


def words(spark, *ws):
    return spark.createDataFrame([(i, w) for i, w in enumerate(ws)], "seq long, e string")


def estimates(s, spark, *ws):
    return [r.estimate for r in s.estimate(words(spark, *ws), "e").orderBy("seq").collect()]


# ------------------------------------------------------------------ count-min

def test_cms_small_and_merge(spark):
    p = CMSParams.create(0.001, 0.999, reference=True)
    assert (p.columns, p.rows) == (2719, 1) and CMSParams.create(0.001, 0.999).rows == 7
    a = CountMinSketch.build(spark.createDataFrame([("foo", 3), ("bar", 1)], "e string, w long"), "e", p, "w")
    assert estimates(a, spark, "foo", "bar", "moo", None) == [3, 1, 0, 0]
    b = CountMinSketch.build(spark.createDataFrame([("foo", 1), ("bar", 1), ("moo", 2), (None, 9)], "e string, w long"), "e", p, "w")
    m = a.merge(b)
    assert estimates(m, spark, "foo", "bar", "moo") == [4, 2, 2] and m.total().first()[0] == 8 and m.equals(b.merge(a))
    assert from_json(spark, m.to_json()).equals(m)
    with pytest.raises(ValueError):
        a.merge(CountMinSketch.build(words(spark, "x"), "e", CMSParams(10, 2)))


def test_cms_bound(spark):
    random.seed(1)
    draws = [str(random.randrange(1000)) for _ in range(50_000)]
    df = spark.createDataFrame([(x,) for x in draws], "e string")
    p = CMSParams.create(0.005, 0.99)
    got = CountMinSketch.build(df, "e", p).estimate(df.groupBy("e").count(), "e").collect()
    assert all(r.estimate >= r["count"] for r in got)
    assert sum(r.estimate - r["count"] > 0.005 * len(draws) for r in got) / len(got) <= 0.03


def test_cms_packed_and_joined_estimates_agree(spark):
    df = spark.createDataFrame([(f"k{i % 37}", 1 + i % 5) for i in range(300)] + [(None, 2)], "e string, w long")
    s = CountMinSketch.build(df, "e", CMSParams(31, 3), "w")
    got = [sorted(map(tuple, s.estimate(df, "e", packed_cells=n).collect()), key=repr) for n in (1 << 18, 0)]
    assert got[0] == got[1]


def test_cms_refuses_bad_weights(spark):
    df = spark.createDataFrame([("a", -1)], "e string, w long")
    with pytest.raises(Exception, match="positive"):
        CountMinSketch.build(df, "e", CMSParams(10, 2), "w").state.collect()
    assert CountMinSketch.build(df, "e", CMSParams(10, 2), "w", turnstile=True).total().first()[0] == -1


# ------------------------------------------------------------------ top-k

def ranks(t):
    return [(r.value, r.frequency, r["rank"]) for r in t.iterator()]


def test_topk_order(spark):
    df = words(spark, "alice", "bob", "alice", "carol", "bob", "alice", None)
    want = [("alice", 3, 1), ("bob", 2, 2), ("carol", 1, 3)]
    assert ranks(TopK.build(df, "e", "seq", 3)) == ranks(TopK.build(df, "e", "seq", 10)) == want
    long = words(spark, *"alice daniel esther bob alice bob alice carol carol alice bob".split())
    assert ranks(TopK.build(long, "e", "seq", 3)) == [("alice", 4, 1), ("bob", 3, 2), ("carol", 2, 3)]


def test_topk_ties_go_to_the_earlier(spark):
    assert [r[0] for r in ranks(TopK.build(words(spark, "c", "a", "b", "c"), "e", "seq", 3))] == ["c", "a", "b"]


def test_topk_weights_merge_clear(spark):
    w = spark.createDataFrame([("a", 2, 1), ("b", 5, 2), ("a", 4, 3)], "e string, w long, seq long")
    t = TopK.build(w, "e", "seq", 2, "w")
    assert ranks(t) == [("a", 6, 1), ("b", 5, 2)]
    assert ranks(t.add(words(spark, "b", "b"), "e", "seq"))[0] == ("b", 7, 1) and ranks(t.clear()) == []
    assert ranks(from_json(spark, t.to_json())) == ranks(t)
    with pytest.raises(Exception, match="positive"):
        TopK.build(w.withColumn("w", F.lit(0)), "e", "seq", 2, "w").values().collect()
    with pytest.raises(ValueError):
        TopK.build(w, "e", "seq", 0)


def test_topk_json_goes_on(spark):
    """What is read back knows the totals outside the k best, and their order of time."""
    first, more = words(spark, *["a"] * 2, *["b"] * 2, "c"), words(spark, "c", "c")
    more = more.withColumn("seq", F.col("seq") + 10)
    t = TopK.build(first, "e", "seq", 2)
    back = from_json(spark, t.to_json())
    assert back.equals(t) and ranks(back.add(more, "e", "seq")) == ranks(t.add(more, "e", "seq")) == [("c", 3, 1), ("a", 2, 2)]
    late = words(spark, *["x"] * 11, "y").where("seq IN (2, 10) OR e = 'y'")
    assert ranks(from_json(spark, TopK.build(late.where("seq <> 2").unionAll(late.where("seq = 2")), "e", "seq", 1).to_json()))[0] == ("x", 2, 1)
    two = spark.createDataFrame([("p", 10), ("q", 9)], "e string, seq long")
    assert [r[0] for r in ranks(from_json(spark, TopK.build(two, "e", "seq", 2).to_json()))] == ["q", "p"]  # 9 comes before 10


def test_sketched_topk_holds_k_rows(spark):
    df = words(spark, *(str(i % 17) for i in range(400)))
    t = TopK.from_sketch(df, "e", "seq", 5, CMSParams(50_000, 3))
    assert t.state.count() == 5 and [e["frequency"] for e in t.heap().content] == sorted(e["frequency"] for e in t.heap().content)
    more = words(spark, *["16"] * 9, *["new"] * 40).withColumn("seq", F.col("seq") + 1000)
    whole = TopK.build(df.unionAll(more), "e", "seq", 5)
    for s in (t, from_json(spark, t.to_json())):
        assert ranks(s.add(more, "e", "seq")) == ranks(whole) == ranks(s.merge(TopK.from_sketch(more, "e", "seq", 5, CMSParams(50_000, 3))))
    assert from_json(spark, t.to_json()).equals(t) and ranks(t.clear()) == [] and t.clear().sketch.params == t.sketch.params


def test_min_heap():
    h = MinHeap()
    for v, n in (("a", 3), ("b", 1), ("c", 2)):
        h.add({"value": v, "frequency": n})
    assert h.length == 3 and h.get(0)["value"] == "b" and h.get(9) is None and h.index_of("c") == 1 and h.index_of("z") == -1
    assert MinHeap.from_json(h.to_json()).content == h.content and h.pop_min()["value"] == "b"
    h.remove(0)
    assert [e["value"] for e in h.content] == ["a"]
    h.clear()
    assert h.length == 0 and h.pop_min() is None


def test_grouped_sketches_have_no_json(spark):
    df = words(spark, "a", "b").withColumn("g", F.col("seq"))
    made = (
        BloomFilter.build(df, "e", BloomParams(100, 2), ("g",)),
        CountingBloomFilter.build(df, "e", BloomParams(100, 2), ("g",)),
        PartitionedBloomFilter.build(df, "e", PartitionedParams.create(10, 0.1), ("g",)),
        CountMinSketch.build(df, "e", CMSParams(20, 2), by=("g",)),
        TopK.build(df, "e", "seq", 2, by=("g",)),
        HyperLogLog.build(df, "e", HLLParams(16), ("g",)),
        MinHash.build(df, "seq", MinHash.make_family(4, 100), ("g",)),
        IBLT.build(df, "e", IBLTParams(10), ("g",)),
    )
    for s in made:
        with pytest.raises(ValueError, match="grouped"):
            s.to_json()


def test_topk_sketch_is_exact_when_wide(spark):
    df = words(spark, *(str(i % 17) for i in range(400)))
    assert ranks(TopK.from_sketch(df, "e", "seq", 5, CMSParams(50_000, 3))) == ranks(TopK.build(df, "e", "seq", 5))


def test_native_aggregates(spark):
    df = words(spark, *(["a"] * 5 + ["b"] * 3 + ["c"]))
    assert {r.value: r.frequency for r in native_top_k(df, "e", 2).collect()} == {"a": 5, "b": 3}
    assert native_cms(df, "e", 0.1, 0.9, 1).first().sketch


# ------------------------------------------------------------------ HyperLogLog

@pytest.mark.parametrize("n", [10, 100, 640, 100_000])
def test_hll_error(spark, n):
    s = HyperLogLog.build(spark.range(n), "id", HLLParams(256))
    assert abs(s.count() - n) <= 4 * s.params.relative_error * n + 1


def test_hll_reference_estimator_halves_small_counts(spark):
    s = HyperLogLog.build(spark.range(100), "id", HLLParams(256))
    assert 30 <= s.estimate(reference=True).first()[0] <= 75


def test_hll_algebra(spark):
    p = HLLParams(64)
    a, b = (HyperLogLog.build(spark.range(x, y), "id", p) for x, y in ((0, 500), (300, 900)))
    assert a.merge(b).equals(b.merge(a)) and a.merge(b).equals(HyperLogLog.build(spark.range(900).repartition(7), "id", p)) and a.merge(a).equals(a)
    assert from_json(spark, a.to_json()).equals(a) and HyperLogLog.build(spark.range(0), "id", p).count() == 0.0
    by = HyperLogLog.build(spark.range(900).withColumn("g", F.col("id") % 3), "id", p, ("g",))
    assert by.rollup().equals(a.merge(b)) and by.estimate().count() == 3
    for m in (0, 1, 8, 100):
        with pytest.raises(ValueError):
            HLLParams(m)


def test_native_hll(spark):
    got = native_hll_estimate(native_hll(spark.range(5000).withColumn("g", F.col("id") % 2), "id", ("g",))).first()[0]
    assert abs(got - 5000) < 250


# ------------------------------------------------------------------ MinHash

def test_minhash_estimates_jaccard(spark):
    fam = MinHash.make_family(400, 19_998)
    a = MinHash.build(spark.range(1, 10_000), "id", fam)
    b = MinHash.build(spark.range(1, 10_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("id") * 2).alias("id")), "id", fam)
    j = 4999 / 12_499
    assert abs(a.compare(b) - j) <= 4 * math.sqrt(j * (1 - j) / 400) + 0.03 and a.compare(a) == 1.0


def test_minhash_edges(spark):
    fam = MinHash.make_family(10, 100)
    empty, some = MinHash.build(spark.range(0), "id", fam), MinHash.build(spark.range(5), "id", fam)
    assert empty.is_empty() and not some.is_empty()
    for a, b in ((empty, some), (some, empty)):
        with pytest.raises(ValueError):
            a.compare(b)
    with pytest.raises(ValueError):
        some.compare(MinHash.build(spark.range(5), "id", MinHash.make_family(10, 100, 1)))
    assert from_json(spark, some.to_json()).compare(some) == 1.0 and from_json(spark, empty.to_json()).is_empty()
    assert some.merge(MinHash.build(spark.range(3, 9), "id", fam)).compare(MinHash.build(spark.range(9), "id", fam)) == 1.0


def test_minhash_candidates(spark):
    rows = [(k, x) for k in range(4) for x in range(50)] + [(9, x + 70 * (x % 25 == 0)) for x in range(50)] + [(20, x + 1000) for x in range(50)]
    got = {(r.a, r.b): r.matches for r in MinHash.build(spark.createDataFrame(rows, "k long, x long"), "x", MinHash.make_family(32, 2000), ("k",)).candidates(4).collect()}
    assert {(0, 1), (0, 2), (0, 3), (0, 9)} <= set(got) and got[0, 1] == 32 and not any(20 in p for p in got)


# ------------------------------------------------------------------ IBLT

P = IBLTParams(100, 1.5, 3)


def values(df):
    return {(r.side, r.value) for r in df.collect()}


def test_iblt_entries(spark):
    ws = ["help", "meow", '{"data":"hello world"}', "\0lead", "été"]
    t = IBLT.build(words(spark, *ws, None), "e", P)
    assert P.size == 153 and t.length() == 5 and {r.value for r in t.list_entries().collect()} == set(ws)
    assert {r.e: r.has for r in t.probe(words(spark, *ws), "e").collect()} == dict.fromkeys(ws, True)
    gone = t.remove(words(spark, *ws), "e")
    assert gone.length() == 0 and gone.decode_status() == {"success": True, "additional": 0, "missing": 0}
    assert from_json(spark, t.to_json()).equals(t)
    with pytest.raises(Exception, match="bytes"):
        IBLT.build(words(spark, "x" * 100), "e", P).state.collect()


@pytest.mark.parametrize("seed", range(3))
def test_iblt_difference(spark, seed):
    rng = random.Random(seed)
    both = [str(i) for i in range(900)]
    left, right = [], []
    for i in range(900, 1000):
        (left if rng.random() < 0.5 else right).append(str(i))
    a, b = words(spark, *both, *left), words(spark, *both, *right)
    p = IBLTParams(100, 2.0, 4, seed=seed)  # with three hashes two of 100 elements share all cells in 4 % of cases
    diff = IBLT.build(a, "e", p).subtract(IBLT.build(b, "e", p))
    assert values(diff.decode()) == values(exact_difference(a, b, "e"))


def test_iblt_of_long_elements(spark):
    a, b = words(spark, "x" * 1000, '{"data": "' + "é" * 300 + '"}', "s"), words(spark, "s", "y" * 77)
    p = IBLTParams.fitting(10, a.select("e"), b.select("e"), alpha=3.0, hashes=4)
    assert p.max_bytes == 1000
    diff = IBLT.build(a, "e", p).subtract(IBLT.build(b, "e", p))
    assert values(diff.decode()) == values(exact_difference(a, b, "e")) and from_json(spark, diff.to_json()).equals(diff)


def test_iblt_overload_is_reported(spark):
    t = IBLT.build(spark.range(5000).select(F.col("id").cast("string").alias("e")), "e", IBLTParams(10, 1.5, 3))
    assert t.decode_status()["success"] is False


def test_store(spark, tmp_path):
    df = words(spark, *map(str, range(30)))
    for i, s in enumerate((HyperLogLog.build(df, "e", HLLParams(16)), CountMinSketch.build(df, "e", CMSParams(20, 2)), IBLT.build(df, "e", IBLTParams(20)))):
        save(s, str(tmp_path / str(i)))
        assert load(spark, str(tmp_path / str(i))).equals(s)
    t = TopK.build(df, "e", "seq", 3)
    save(t, str(tmp_path / "t"))
    assert ranks(load(spark, str(tmp_path / "t"))) == ranks(t)
    s = TopK.from_sketch(df, "e", "seq", 3, CMSParams(100, 2))
    save(s, str(tmp_path / "s"))
    assert load(spark, str(tmp_path / "s")).equals(s)
