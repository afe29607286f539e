"""Bloom filters: classic, counting, partitioned and scalable."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import SPECS, XXH64, HashSpec, element, from_pair, hash_twice, pair
from quarry.functions.params import DEFAULT_SEED, check_rate, generation_plan, optimal_hashes, optimal_size
from quarry.llm.common import settle
from quarry.operators import bits
from quarry.operators.bits import HANDED_BITS, PACKED_BITS


#: Bit tests of a scalable probe that are put into one generated predicate.
TERMS = 32


def seed_out(seed: int) -> dict:
    return {"$bf$bigint": str(seed)}


def seed_in(x: dict) -> int:
    return int(x["$bf$bigint"])


class Filter:
    """What the filters share. Subclasses have params (with seed and spec), state and by, and say how many bits there are,
    what modulus the hashes take and how bits come from them."""

    def __init__(self, params, state: DataFrame, by: tuple[str, ...] = (), packed: DataFrame | None = None):
        """packed: the state's words, where a build has them at hand."""
        self.params, self.state, self.by, self.packed = params, state, tuple(by), packed

    n_bits: int

    modulus: int

    def spread(self, a: Column, b: Column) -> list[Column]:
        raise NotImplementedError

    def pair(self, c: Column) -> tuple[Column, Column]:
        return pair(c, self.modulus, self.params.seed, self.params.spec)

    def bits(self) -> DataFrame:
        return self.state

    def probe(self, df: DataFrame, column: str, out: str = "has", packed_bits: int = PACKED_BITS) -> DataFrame:
        """df with a boolean column: perhaps in the filter, or certainly not."""
        c = element(column, dict(df.dtypes)[column])
        return bits.probe(df, c, self.pair(c), self.spread, self.bits(), self.n_bits, self.by, out, packed_bits, self.packed)

    def prefilter(self, df: DataFrame, column: str, **options) -> DataFrame:
        """The rows of df that may be in the filter."""
        return self.probe(df, column, "__q_has", **options).where("__q_has").drop("__q_has")

    def semi_join(self, df: DataFrame, column: str, keys: DataFrame, key: str, **options) -> DataFrame:
        """df left semi keys: the filter (built from keys) thins df out, an exact join has the last word."""
        return self.prefilter(df, column, **options).join(keys.select(F.col(key).alias(column)), column, "left_semi")

    def anti_join(self, df: DataFrame, column: str, keys: DataFrame, key: str, **options) -> DataFrame:
        """df left anti keys: what the filter refuses is out of keys for certain, the rest is looked up."""
        marked = self.probe(df, column, "__q_has", **options)
        rest = marked.where("__q_has").drop("__q_has").join(keys.select(F.col(key).alias(column)), column, "left_anti")
        return marked.where("not __q_has").drop("__q_has").unionByName(rest)

    def equals(self, other: Filter) -> bool:
        """Same parameters, seed included, and same state."""
        return type(self) is type(other) and self.params == other.params and bits.same_rows(self.state, other.state)

    def fill(self) -> DataFrame:
        """(by, set_bits)."""
        return bits.bit_count(self.bits(), self.by)

    def set_bits(self) -> int:
        return self.bits().count()

    def with_state(self, state: DataFrame) -> Filter:
        return type(self)(self.params, state, self.by)


@dataclass(frozen=True)
class BloomParams:
    size: int
    hashes: int
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    def __post_init__(self):
        if self.hashes < 1:
            raise ValueError("a filter needs one hash function at least")

    @classmethod
    def create(cls, n: int, rate: float, **more) -> BloomParams:
        size = optimal_size(n, check_rate(rate))
        return cls(size, optimal_hashes(size, n), **more)


class BloomFilter(Filter):
    """State: (by, bit)."""

    @property
    def n_bits(self) -> int:
        return self.params.size

    modulus = n_bits

    def spread(self, a: Column, b: Column) -> list[Column]:
        return from_pair(a, b, self.params.size, self.params.hashes)

    @classmethod
    def build(cls, df: DataFrame, column: str, params: BloomParams, by: tuple[str, ...] = ()) -> BloomFilter:
        """Null elements are passed over."""
        empty = cls(params, df, by)
        c = element(column, dict(df.dtypes)[column])
        rows = bits.positions(df.where(F.col(column).isNotNull()), empty.pair(c), empty.spread, by).drop("i")
        small = not by and empty.n_bits <= PACKED_BITS and not df.isStreaming
        packed = bits.gather(rows, by, empty.n_bits if small else None)
        return cls(params, bits.from_words(packed, by), by, packed if small else None)

    @classmethod
    def from_items(cls, df: DataFrame, column: str, rate: float, n: int | None = None, **more) -> BloomFilter:
        """Sized by n, or else by a count of the rows (repeats count)."""
        return cls.build(df, column, BloomParams.create(max(1, n if n is not None else df.count()), rate, **more))

    def add(self, df: DataFrame, column: str) -> BloomFilter:
        return self.merge(self.build(df, column, self.params, self.by))

    def merge(self, other: BloomFilter) -> BloomFilter:
        if self.params != other.params:
            raise ValueError("filters of other parameters can't be merged")
        return self.with_state(self.state.unionByName(other.state).distinct())

    def rate(self, reference: bool = False) -> float:
        """Expected false positive rate: fill^k; with reference (1 - e^(-set bits / size))^k."""
        x = self.set_bits() / self.params.size
        return ((1 - math.exp(-x)) if reference else x) ** self.params.hashes

    def to_json(self) -> str:
        """Of an ungrouped filter."""
        bits.single(self.by)
        return json.dumps({"type": "BloomFilter", "_size": self.params.size, "_nbHashes": self.params.hashes, "_filter": bits.export(self.state, self.params.size), "_seed": seed_out(self.params.seed), "_hash": self.params.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> BloomFilter:
        x = json.loads(text)
        return cls(BloomParams(x["_size"], x["_nbHashes"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")]), bits.load(spark, x["_filter"]))


class CountingBloomFilter(Filter):
    """State: (by, bit, cnt). Removals subtract whether or not the element was there."""

    n_bits = modulus = BloomFilter.n_bits
    spread = BloomFilter.spread

    @classmethod
    def build(cls, df: DataFrame, column: str, params: BloomParams, by: tuple[str, ...] = (), op: str | None = None) -> CountingBloomFilter:
        """From a changelog if op names its column: '-' removes, all else adds."""
        empty = cls(params, df, by)
        sign = F.lit(1) if op is None else F.when(F.col(op) == "-", -1).otherwise(1)
        c = element(column, dict(df.dtypes)[column])
        rows = bits.positions(df.where(F.col(column).isNotNull()), empty.pair(c), empty.spread, by, sign.cast("long").alias("w"))
        return cls(params, rows.groupBy(*by, "bit").agg(F.sum("w").alias("cnt")), by)

    @classmethod
    def from_items(cls, df: DataFrame, column: str, rate: float, n: int | None = None, **more) -> CountingBloomFilter:
        return cls.build(df, column, BloomParams.create(max(1, n if n is not None else df.count()), rate, **more))

    def bits(self) -> DataFrame:
        return self.state.where("cnt > 0").select(*self.by, "bit")

    def merge(self, other: CountingBloomFilter, sign: int = 1) -> CountingBloomFilter:
        if self.params != other.params:
            raise ValueError("filters of other parameters can't be merged")
        both = self.state.unionByName(other.state.withColumn("cnt", F.col("cnt") * sign))
        return self.with_state(both.groupBy(*self.by, "bit").agg(F.sum("cnt").alias("cnt")))

    def add(self, df: DataFrame, column: str) -> CountingBloomFilter:
        return self.merge(self.build(df, column, self.params, self.by))

    def remove(self, df: DataFrame, column: str) -> CountingBloomFilter:
        return self.merge(self.build(df, column, self.params, self.by), -1)

    def equals(self, other: Filter) -> bool:
        live = lambda f: f.with_state(f.state.where("cnt <> 0"))
        return type(self) is type(other) and Filter.equals(live(self), live(other))

    def n_items(self) -> int:
        """Net number of insertions."""
        return (self.state.agg(F.sum("cnt")).first()[0] or 0) // self.params.hashes

    def negative_cells(self) -> int:
        """Cells below zero: a sign that elements were removed which were never added."""
        return self.state.where("cnt < 0").count()

    def rate(self) -> float:
        return (1 - math.exp(-self.params.hashes * self.n_items() / self.params.size)) ** self.params.hashes

    def to_json(self) -> str:
        """Of an ungrouped filter."""
        bits.single(self.by)
        cells = [[0, 0] for _ in range(self.params.size)]
        for r in self.state.toLocalIterator():
            cells[r.bit] = [int(r.cnt > 0), r.cnt]
        return json.dumps({"type": "CountingBloomFilter", "_size": self.params.size, "_nbHashes": self.params.hashes, "_filter": cells, "_length": self.n_items(), "_seed": seed_out(self.params.seed), "_hash": self.params.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> CountingBloomFilter:
        x = json.loads(text)
        rows = [(i, c) for i, (_, c) in enumerate(x["_filter"]) if c]
        return cls(BloomParams(x["_size"], x["_nbHashes"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")]), spark.createDataFrame(rows, "bit long, cnt long"))


@dataclass(frozen=True)
class PartitionedParams:
    bits: float
    slices: int
    rate: float
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    @property
    def slice_bits(self) -> int:
        return math.ceil(self.bits / self.slices)

    @property
    def capacity(self) -> int:
        return math.floor(self.slices * self.slice_bits * math.log(2) ** 2 / abs(math.log(self.rate)))

    @classmethod
    def create(cls, n: int, rate: float, slices: int | None = None, **more) -> PartitionedParams:
        k = max(slices or math.ceil(math.log2(1 / check_rate(rate))), 2)
        return cls(n * abs(math.log(rate)) / math.log(2) ** 2, k, rate, **more)


class PartitionedBloomFilter(BloomFilter):
    """One slice of bits for each hash function. State: (by, bit), bit being slice * slice_bits + index."""

    @property
    def n_bits(self) -> int:
        return self.params.slices * self.params.slice_bits

    @property
    def modulus(self) -> int:
        return self.params.slice_bits

    def spread(self, a: Column, b: Column) -> list[Column]:
        return [e + i * self.modulus for i, e in enumerate(from_pair(a, b, self.modulus, self.params.slices))]

    @classmethod
    def from_items(cls, df: DataFrame, column: str, rate: float, n: int | None = None, **more) -> PartitionedBloomFilter:
        return cls.build(df, column, PartitionedParams.create(max(1, n if n is not None else df.count()), rate, **more))

    def slices(self) -> DataFrame:
        """(by, slice, idx)."""
        m = F.lit(self.params.slice_bits)
        return self.state.select(*self.by, F.expr(f"bit div {self.params.slice_bits}").alias("slice"), F.pmod("bit", m).alias("idx"))

    def load(self) -> float:
        """Share of set bits; may pass 1 a little, as slices are rounded up."""
        return self.set_bits() / self.params.bits

    def rate(self) -> float:
        return self.load() ** self.params.slices

    def n_elements(self) -> int:
        """Distinct elements that most likely set so many bits."""
        p = self.params
        full = self.set_bits() / (p.slices * p.slice_bits)
        return p.capacity if full >= 1 else round(math.log1p(-full) / math.log1p(-1 / p.slice_bits)) if p.slice_bits > 1 else round(full)

    def to_json(self) -> str:
        """Of an ungrouped filter."""
        bits.single(self.by)
        p, m = self.params, self.params.slice_bits
        sets = bits.exports(self.slices().withColumnRenamed("idx", "bit"), "slice", p.slices, m)
        return json.dumps({"type": "PartitionedBloomFilter", "_bits": p.bits, "_k": p.slices, "_m": m, "_filter": sets, "_errorRate": p.rate, "_seed": seed_out(p.seed), "_hash": p.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> PartitionedBloomFilter:
        x = json.loads(text)
        p = PartitionedParams(x["_bits"], x["_k"], x["_errorRate"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")])
        return cls(p, spark.createDataFrame([(i,) for i in cls._read(x)], "bit long"))

    @staticmethod
    def _read(x: dict) -> list[int]:
        """The set bits of an export."""
        return [i * math.ceil(x["_bits"] / x["_k"]) + b for i, s in enumerate(x["_filter"]) for b in bits.set_positions(s)]


@dataclass(frozen=True)
class ScalableParams:
    initial: int = 128
    rate: float = 0.001
    ratio: float = 0.8
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    def plan(self, count: int) -> list[PartitionedParams]:
        return [PartitionedParams(g["bits"], g["slices"], g["rate"], self.seed, self.spec) for g in generation_plan(self.initial, self.rate, self.ratio, count)]

    def plan_for(self, n: int) -> list[PartitionedParams]:
        """As many generations as hold n elements."""
        count = 1
        while sum(p.capacity for p in self.plan(count)) < n:
            count += 1
        return self.plan(count)


class ScalableBloomFilter(Filter):
    """A chain of partitioned filters of growing size. State: (generation, bit)."""

    def __init__(self, params: ScalableParams, state: DataFrame, generations: int, by: tuple[str, ...] = ()):
        super().__init__(params, state, by)
        self.generations = generations

    @classmethod
    def build(cls, df: DataFrame, column: str, params: ScalableParams = ScalableParams(), n: int | None = None) -> ScalableBloomFilter:
        """All at once: distinct elements are dealt to the generations by hash, in the shares of their capacities.

        No order and no global rank is needed; every generation expects as many elements as it
        holds. Sized by n, or else by a count of the distinct elements.
        """
        keys = cls._keys(df, column)
        plan = params.plan_for(keys.count() if n is None else n)
        return cls(params, cls._dealt(keys, params, plan, [p.capacity for p in plan]), len(plan))

    @staticmethod
    def _keys(df: DataFrame, column: str) -> DataFrame:
        return df.where(F.col(column).isNotNull()).select(element(column, dict(df.dtypes)[column]).alias("e")).distinct()

    @classmethod
    def _dealt(cls, keys: DataFrame, params: ScalableParams, plan: list[PartitionedParams], room: list[int]) -> DataFrame:
        """(generation, bit) of elements e that go to the generations by hash, in the shares of their room."""
        place = params.spec.mod(params.spec.of(F.col("e"), params.seed + 3), max(1, sum(room)))
        generation = F.lit(len(plan) - 1)
        for i in reversed(range(len(plan) - 1)):
            generation = F.when(place < sum(room[: i + 1]), i).otherwise(generation)
        return cls._positions(keys.withColumn("generation", generation), params, plan).select("generation", "bit").distinct()

    def add(self, df: DataFrame, column: str) -> ScalableBloomFilter:
        """With more elements: those that the filter doesn't have go to the room left in the last generation and to as many new ones as they need."""
        held = ScalableBloomFilter(self.params, settle(self.state), self.generations)
        new = settle(held.probe(self._keys(df, column), "e", "__q_has").where("not __q_has").select("e"))
        n, last = new.count(), held.current
        left = max(0, last.params.capacity - last.n_elements())
        count = self.generations
        while left + sum(p.capacity for p in self.params.plan(count)[self.generations :]) < n:
            count += 1
        plan = self.params.plan(count)
        room = [0] * (self.generations - 1) + [left] + [p.capacity for p in plan[self.generations :]]
        more = self._dealt(new, self.params, plan, room)
        return ScalableBloomFilter(self.params, settle(held.state.unionByName(more).distinct()), count)

    def merge(self, other: ScalableBloomFilter) -> ScalableBloomFilter:
        """The union, generation by generation. Generations may then be fuller than planned; rate() says how much that costs."""
        if self.params != other.params:
            raise ValueError("filters of other parameters can't be merged")
        return ScalableBloomFilter(self.params, self.state.unionByName(other.state).distinct(), max(self.generations, other.generations))

    @staticmethod
    def _positions(rows: DataFrame, params: ScalableParams, plan: list[PartitionedParams]) -> DataFrame:
        """(e, generation, k, bit) for rows (e, generation): the modulus and the number of slices come from the plan, row by row."""
        h1, h2 = hash_twice(F.col("e"), params.seed, params.spec)
        of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("generation") + 1)
        m, wrap, i = F.col("m"), F.col("wrap"), F.col("i")
        mod = lambda h: F.pmod(F.pmod(h, m) + (F.when(h < 0, wrap).otherwise(0) if params.spec.signed else 0), m)
        rows = rows.select("e", "generation", h1.alias("h1"), h2.alias("h2"))
        rows = rows.select("e", "generation", "h1", "h2", of([p.slice_bits for p in plan]).alias("m"), of([(1 << 64) % p.slice_bits for p in plan]).alias("wrap"), of([p.slices for p in plan]).alias("k"))
        rows = rows.select("e", "generation", "m", "k", mod(F.col("h1")).alias("a"), mod(F.col("h2")).alias("b"))
        rows = rows.select("e", "generation", "m", "k", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
        return rows.select("e", "generation", "k", (i * m + (F.col("a") + i * F.col("b") + i * i * i - F.expr("i div 6")) % m).alias("bit"))

    @classmethod
    def build_ordered(cls, df: DataFrame, column: str, order: str, params: ScalableParams = ScalableParams()) -> ScalableBloomFilter:
        """Element by element in the given order: a generation is added when the last one's load reaches one half.

        This is sequential and runs in one task; it is for streams small enough for that.
        """
        c = element(column, dict(df.dtypes)[column])
        a, b = hash_twice(c, params.seed, params.spec)
        rows = df.where(F.col(column).isNotNull()).select(F.col(order).alias("o"), a.alias("a"), b.alias("b"), F.lit(0).alias("shard"))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("o", kind="stable")
            sets, plan = [set()], params.plan(1)
            for a, b in zip(pdf["a"].to_numpy().astype(np.uint64).tolist(), pdf["b"].to_numpy().astype(np.uint64).tolist(), strict=True):
                p = plan[len(sets) - 1]
                if len(sets[-1]) / p.bits >= 0.5:
                    sets.append(set())
                    plan = params.plan(len(sets))
                    p = plan[-1]
                m = p.slice_bits
                sets[-1].update(i * m + (a + i * b + i**3 - i // 6) % m for i in range(p.slices))
            return pd.DataFrame([(g, x) for g, s in enumerate(sets) for x in s], columns=["generation", "bit"])

        state = rows.groupBy("shard").applyInPandas(grow, "generation int, bit long").persist()
        return cls(params, state, 1 + (state.agg(F.max("generation")).first()[0] or 0))

    def filters(self) -> Iterator[PartitionedBloomFilter]:
        for i, p in enumerate(self.params.plan(self.generations)):
            yield PartitionedBloomFilter(p, self.state.where(F.col("generation") == i).select("bit"))

    def probe(self, df: DataFrame, column: str, out: str = "has", packed_bits: int = PACKED_BITS) -> DataFrame:
        """In one generation at least.

        Up to TERMS positions in all, the generations are packed into one value and the largest is
        asked first. Else, up to HANDED_BITS, the words go to the tasks, which ask them for the
        distinct elements; beyond, these are joined with the set bits of all generations.
        """
        filters = list(self.filters())
        starts = [sum(f.n_bits for f in filters[:i]) for i in range(len(filters) + 1)]
        got, c = df.drop(out), element(column, dict(df.dtypes)[column])
        flat = self.state.select((F.col("bit") + F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("generation") + 1)).alias("bit"))
        if starts[-1] <= min(packed_bits, PACKED_BITS) and sum(f.params.slices for f in filters) <= TERMS:
            packed = bits.words(bits.gather(flat, (), starts[-1])).scalar()
            pairs = {f"__q_{n}{i}": x for i, f in enumerate(filters) for n, x in zip("ab", f.pair(c), strict=True)}
            hit = F.lit(False)
            for i, f in reversed(list(enumerate(filters))):
                hit = hit | bits.all_set(packed, [e + starts[i] for e in f.spread(F.col(f"__q_a{i}"), F.col(f"__q_b{i}"))])
            return bits.computed_once(got, pairs).withColumn(out, c.isNotNull() & F.coalesce(hit, F.lit(False))).drop(*pairs)
        if packed_bits and starts[-1] <= HANDED_BITS:
            hits = self._held(got.where(c.isNotNull()).select(c.alias("e")).distinct(), filters, starts, bits.held_words(flat.select("bit"), starts[-1]))
            hits = hits.select(F.col("e").alias("__q_e"), F.lit(True).alias(out))
            return got.withColumn("__q_e", c).join(hits, "__q_e", "left").drop("__q_e").withColumn(out, F.coalesce(out, F.lit(False)))
        asked = got.where(c.isNotNull()).select(c.alias("e")).distinct().withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(self.generations - 1))))
        cells = self._positions(asked, self.params, [f.params for f in filters]).join(self.state, ["generation", "bit"], "left_semi")
        hits = cells.groupBy("e", "generation").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k")).where("n = k").select(F.col("e").alias("__q_e")).distinct().withColumn(out, F.lit(True))
        return got.withColumn("__q_e", c).join(hits, "__q_e", "left").drop("__q_e").withColumn(out, F.coalesce(out, F.lit(False)))

    def _held(self, asked: DataFrame, filters: list[PartitionedBloomFilter], starts: list[int], words: np.ndarray) -> DataFrame:
        """Those of the elements e that one of the generations has, the last being asked first. Each is asked for no more positions than it takes."""
        u = np.uint64
        sent = asked.sparkSession.sparkContext.broadcast(words)  # HANDED_BITS at most
        plan = [(u(f.params.slice_bits), f.params.slices, u(at)) for f, at in zip(filters, starts, strict=False)][::-1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = sent.value
            for batch in batches:
                h1, h2 = (batch.column(i).to_numpy().view(u) for i in (1, 2))
                found = np.zeros(len(h1), bool)
                for m, k, start in plan:
                    left = np.flatnonzero(~found)
                    for i in range(k):
                        bit = start + u(i) * m + (h1[left] % m + u(i) * (h2[left] % m) + u(i**3 - i // 6)) % m
                        left = left[(words[bit >> u(6)] >> (bit & u(63))) & u(1) == 1]
                    found[left] = True
                yield batch.filter(pa.array(found)).select(["e"])

        h1, h2 = hash_twice(F.col("e"), self.params.seed, self.params.spec)
        return asked.select("e", h1.alias("h1"), h2.alias("h2")).mapInArrow(run, f"e {dict(asked.dtypes)['e']}")

    @property
    def current(self) -> PartitionedBloomFilter:
        """The latest generation."""
        return list(self.filters())[-1]

    def capacity(self) -> int:
        return sum(p.capacity for p in self.params.plan(self.generations))

    def rate(self) -> dict[str, float]:
        """product: that all generations are wrong at once; any: that one of them is."""
        rates = [f.rate() for f in self.filters()]
        return {"product": math.prod(rates), "any": 1 - math.prod(1 - r for r in rates)}

    def to_json(self) -> str:
        p = self.params
        return json.dumps({"type": "ScalableBloomFilter", "_initial_size": p.initial, "_initial_error_rate": p.rate, "_ratio": p.ratio, "_seed": seed_out(p.seed), "_hash": p.spec.name, "_filters": [json.loads(f.to_json()) for f in self.filters()]})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> ScalableBloomFilter:
        x = json.loads(text)
        p = ScalableParams(x["_initial_size"], x["_initial_error_rate"], x["_ratio"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")])
        rows = [(i, b) for i, f in enumerate(x["_filters"]) for b in PartitionedBloomFilter._read(f)]
        state = spark.createDataFrame(rows, "generation int, bit long")
        return cls(p, state, len(x["_filters"]))


