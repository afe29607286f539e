"""Formulas and hashing against their definitions."""

import math

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import hashing as H
from quarry.functions import params as P
from quarry.operators.bits import high_bit, xor_bytes

WORDS = ["", "a", "alice", "été", "x" * 200, "\0\0z", "中文"]


@pytest.mark.parametrize("seed", [0, 42, P.DEFAULT_SEED, P.DEFAULT_SEED + 1, 2**64 - 1])
def test_seeded_hash_is_xxh64(spark, seed):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = [r.h % 2**64 for r in df.select(H.XXH64.of(F.col("w"), seed).alias("h")).collect()]
    assert got == [xxhash.xxh64_intdigest(w.encode(), seed) for w in WORDS]


def test_known_seed_literals():
    assert H.seed_literal(P.DEFAULT_SEED) == 2927906834985356666
    assert H.seed_literal(P.DEFAULT_SEED + 1) == 5528831853752490958


@given(st.integers(0, 2**64 - 1))
@settings(max_examples=200, deadline=None)
def test_seed_literal_inverts_the_long_hash(seed):
    assert H.xxh64_long(H.seed_literal(seed)) == seed


@pytest.mark.parametrize("m", [2, 7, 1000, 2**31 - 1, 95851])
def test_indexes_follow_the_formula(spark, m):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    for r in df.select("w", F.array(*H.indexes(F.col("w"), m, 9)).alias("i")).collect():
        a, b = (xxhash.xxh64_intdigest(r.w.encode(), P.DEFAULT_SEED + k) for k in (1, 2))
        assert r.i == [(a + i * b + i**3 - i // 6) % m for i in range(9)]


def test_portable_hash_in_python(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "w string")
    got = [r.h for r in df.select(H.PORTABLE.of(F.col("w"), 5).alias("h")).collect()]
    assert got == [H.PORTABLE.py(w.encode(), 5) for w in WORDS] and min(got) >= 0


def test_custom_hash(spark):
    """Under a constant hash all elements are one."""
    from quarry.operators.bloom import BloomFilter, BloomParams

    same = H.HashSpec("constant", lambda c, seed: F.lit(1).cast("long"))
    p = BloomParams.create(2, 0.01, spec=same)
    a, b = (BloomFilter.build(spark.createDataFrame([(w,)], "w string"), "w", p) for w in "ab")
    assert a.equals(b)


def test_hex_forms(spark):
    r = spark.createDataFrame([("alice",)], "w string").select(H.hash_twice_struct(F.col("w")).alias("h")).first().h
    assert r.first_hex == format(r.first % 2**64, "x") and r.second_hex == format(r.second % 2**64, "x")


def test_sizing():
    assert (P.optimal_size(3, 0.1), P.optimal_hashes(15, 3)) == (15, 4)
    assert (P.optimal_size(10_000, 0.01), P.optimal_hashes(95_851, 10_000)) == (95_851, 7)
    assert P.xor_slots(1000) == 1260 and P.iblt_cells(100, 1.5, 3) == 153
    assert [P.hll_alpha(m) for m in (8, 16, 32, 64)] == [1.0, 0.673, 0.697, 0.709]
    assert not P.is_prime(1) and not P.is_prime(25) and P.next_prime(24) == 29
    with pytest.raises(ValueError):
        P.check_rate(1.0)


def test_hash_family_is_seeded():
    assert P.hash_family(8, 1000, 3) == P.hash_family(8, 1000, 3) != P.hash_family(8, 1000, 4)
    assert all(a >= 1 for a, _, _ in P.hash_family(500, 3))
    with pytest.raises(ValueError):
        P.hash_family(1, 2**32)


def test_generation_plan_grows():
    plan = P.generation_plan(128, 0.0001, 0.8, 6)
    m0 = plan[0]["slice_bits"]
    assert [g["items"] for g in plan] == [128] + [m0 * 2**i for i in range(1, 6)]
    assert all(math.isclose(b["rate"], a["rate"] * 0.8) for a, b in zip(plan, plan[1:], strict=False))


@given(st.binary(max_size=12), st.binary(max_size=12))
def test_xor_laws(a, b):
    strip = lambda x: x.lstrip(b"\0")
    assert xor_bytes(a, b) == xor_bytes(b, a) and xor_bytes(a, a) == b"" and xor_bytes(xor_bytes(a, b), b) == strip(a)


def test_high_bit(spark):
    df = spark.range(256)
    assert all(r.h == (r.id.bit_length() - 1 if r.id else -1) for r in df.select("id", high_bit(F.col("id")).alias("h")).collect())
