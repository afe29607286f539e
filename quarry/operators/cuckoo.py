"""Cuckoo filters: ordered insertion and deletion a shard at a time, probes by join."""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import SPECS, XXH64, HashSpec, element, xxh64_long
from quarry.functions.params import DEFAULT_SEED, check_rate, fingerprint_bits, power_of_two
from quarry.operators.bits import same_rows
from quarry.operators.bloom import seed_in, seed_out


@dataclass(frozen=True)
class CuckooParams:
    """buckets (a power of two) of bucket_size fingerprints of fp_bits, a shard."""

    buckets: int
    fp_bits: int
    bucket_size: int = 4
    max_kicks: int = 500
    shards: int = 1
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    def __post_init__(self):
        if self.buckets & (self.buckets - 1) or self.buckets < 1:
            raise ValueError("the number of buckets must be a power of two: only then do both places of a fingerprint name each other")
        if not 1 <= self.fp_bits <= 32:
            raise ValueError("fingerprints have 1 to 32 bits")

    @classmethod
    def create(cls, n: int, rate: float, bucket_size: int = 4, max_kicks: int = 500, shard_keys: int = 1 << 17, **more) -> CuckooParams:
        shards = max(1, -(-n // shard_keys))
        buckets = power_of_two(n / shards / bucket_size / 0.955)
        return cls(buckets, min(32, fingerprint_bits(bucket_size, check_rate(rate))), bucket_size, max_kicks, shards, **more)

    def rate(self) -> float:
        """2 b / 2^bits."""
        return 2 * self.bucket_size / 2.0**self.fp_bits


class Bucket:
    """A few slots, empty ones being None."""

    def __init__(self, size: int, slots: list | None = None):
        self.slots = list(slots) if slots else [None] * size

    @property
    def size(self) -> int:
        return len(self.slots)

    @property
    def length(self) -> int:
        return sum(x is not None for x in self.slots)

    def is_free(self) -> bool:
        return None in self.slots

    def next_empty_slot(self) -> int:
        return self.slots.index(None) if None in self.slots else -1

    def at(self, i: int):
        return self.slots[i]

    def add(self, x) -> bool:
        if x is None or not self.is_free():
            return False
        self.slots[self.next_empty_slot()] = x
        return True

    def remove(self, x) -> bool:
        if x is None or x not in self.slots:
            return False
        self.slots[self.slots.index(x)] = None
        return True

    def has(self, x) -> bool:
        return x is not None and x in self.slots

    def set(self, i: int, x) -> None:
        self.slots[i] = x

    def unset(self, i: int) -> None:
        self.slots[i] = None

    def swap(self, i: int, x):
        self.slots[i], old = x, self.slots[i]
        return old

    def swap_random(self, x, rng: random.Random):
        return self.swap(rng.randrange(self.size), x)

    def equals(self, other: Bucket) -> bool:
        return self.slots == other.slots


def partner(i: int, fp: int, buckets: int, spec: HashSpec = XXH64) -> int:
    """The other bucket of a fingerprint; its own inverse."""
    return i ^ ((xxh64_long(fp) if spec.name == XXH64.name else spec.py(str(fp).encode(), 0)) & (buckets - 1))


def turn(fp: Column, spec: HashSpec) -> Column:
    """What partner() mixes into a bucket, as a column."""
    return F.xxhash64(fp) if spec.name == XXH64.name else spec.of(fp.cast("string"), 0)


class Table:
    """One shard's buckets. With overflow, a fingerprint that finds no place lengthens one of its two buckets, so none is rejected."""

    def __init__(self, p: CuckooParams, shard: int, overflow: bool = False):
        self.p, self.buckets, self.rng = p, [Bucket(p.bucket_size) for _ in range(p.buckets)], random.Random(p.seed * 31 + shard)
        self.overflow, self.full, self.turns = overflow, False, {}

    def other(self, i: int, fp: int) -> int:
        if fp not in self.turns:
            self.turns[fp] = partner(0, fp, self.p.buckets, self.p.spec)
        return i ^ self.turns[fp]

    def put(self, b: int, slot: int, fp: int) -> None:
        """A fingerprint of a stored state, into a slot that may lie past the bucket's size."""
        slots = self.buckets[b].slots
        slots.extend([None] * (slot + 1 - len(slots)))
        slots[slot] = fp

    def is_long(self, b: int) -> bool:
        return len(self.buckets[b].slots) > self.p.bucket_size

    def rows(self, shard: int) -> list[tuple[int, int, int, int]]:
        return [(shard, b, s, x) for b, bucket in enumerate(self.buckets) for s, x in enumerate(bucket.slots) if x is not None]

    def add(self, fp: int, i: int, destructive: bool = False) -> bool:
        """Into one of its two buckets, moving others away if both are full. A failure undoes the moves unless destructive."""
        both = i, self.other(i, fp)
        for b in both:
            if not self.is_long(b) and self.buckets[b].add(fp):
                return True
        if self.full:  # moves failed before, and no slot came free since
            return self._lengthen(both, fp)
        new, b, undo = fp, self.rng.choice(both), []
        for _ in range(self.p.max_kicks):
            slot = self.rng.randrange(self.p.bucket_size)
            old = self.buckets[b].swap(slot, fp)
            undo.append((b, slot, old))
            fp, b = old, self.other(b, old)
            if not self.is_long(b) and self.buckets[b].add(fp):
                return True
        if self.overflow or not destructive:
            for b, slot, old in reversed(undo):
                self.buckets[b].set(slot, old)
        self.full = self.overflow
        return self.overflow and self._lengthen(both, new)

    def _lengthen(self, both: tuple[int, int], fp: int) -> bool:
        min((self.buckets[b].slots for b in both), key=len).append(fp)
        return True

    def remove(self, fp: int, i: int) -> bool:
        for b in (i, self.other(i, fp)):
            if self.buckets[b].remove(fp):
                if self.is_long(b):  # it has no empty slot but this one, which its last fingerprint takes
                    slots = self.buckets[b].slots
                    last = slots.pop()
                    if last is not None:
                        slots[slots.index(None)] = last
                else:
                    self.full = False
                return True
        return False


_STATE = "shard int, bucket long, slot int, fp long"


class CuckooFilter:
    """State: (shard, bucket, slot, fp); slot -1 and the count in fp for elements that found no place.

    With overflow every element finds a place, whatever the load: slots past the bucket size are what its bucket was
    lengthened by. Without it, all elements of a shard that rejected some may be in the filter.
    """

    def __init__(self, params: CuckooParams, state: DataFrame, overflow: bool = False):
        self.params, self.state, self.overflow = params, state, overflow

    def locations(self, c: Column) -> tuple[Column, Column, Column, Column]:
        """Shard, fingerprint (never 0) and both buckets."""
        p = self.params
        h = p.spec.of(c, p.seed)
        fp = F.pmod(F.shiftrightunsigned(h, 24), F.lit((1 << p.fp_bits) - 1).cast("long")) + 1
        first = h.bitwiseAND(F.lit(p.buckets - 1).cast("long"))
        second = first.bitwiseXOR(turn(fp, p.spec).bitwiseAND(F.lit(p.buckets - 1).cast("long")))
        return p.spec.mod(p.spec.of(c, p.seed + 1), p.shards).cast("int"), fp, first, second

    @classmethod
    def build(cls, df: DataFrame, column: str, order: str, params: CuckooParams, op: str | None = None, destructive: bool = False, overflow: bool = False) -> CuckooFilter:
        """Adds (and with op '-': removes) elements in the given order. Each shard is one task of some 2^17 elements, if the parameters fit their number."""
        rows = cls._log(df, column, order, params, op)

        def replay(pdf: pd.DataFrame) -> pd.DataFrame:
            shard = int(pdf["shard"].iloc[0])
            return cls._replayed(Table(params, shard, overflow), shard, 0, pdf.sort_values("o", kind="stable"), destructive)

        return cls(params, rows.groupBy("shard").applyInPandas(replay, _STATE), overflow)

    @classmethod
    def _log(cls, df: DataFrame, column: str, order: str, params: CuckooParams, op: str | None) -> DataFrame:
        """(shard, fp, i, plus, o) of the rows of a changelog; null elements are passed over."""
        shard, fp, first, _ = cls(params, df).locations(element(column, dict(df.dtypes)[column]))
        sign = F.lit(True) if op is None else F.coalesce(F.col(op) != "-", F.lit(True))
        return df.where(F.col(column).isNotNull()).select(shard.alias("shard"), fp.alias("fp"), first.alias("i"), sign.alias("plus"), F.col(order).alias("o"))

    @staticmethod
    def _replayed(table: Table, shard: int, rejected: int, log: pd.DataFrame, destructive: bool) -> pd.DataFrame:
        for fp, i, plus in zip(log["fp"].tolist(), log["i"].tolist(), log["plus"].tolist(), strict=True):
            if plus:
                rejected += not table.add(fp, i, destructive)
            else:
                table.remove(fp, i)
        return pd.DataFrame(table.rows(shard) + [(shard, -1, -1, rejected)], columns=["shard", "bucket", "slot", "fp"])

    def _then(self, log: DataFrame, destructive: bool = False) -> CuckooFilter:
        """The filter after a log (shard, fp, i, plus, o). Each shard's table and log meet in one task."""
        params, replayed, overflow = self.params, self._replayed, self.overflow

        def go_on(held: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
            shard = int((held if len(held) else log).iloc[0, 0])
            table, rejected = Table(params, shard, overflow), 0
            for _, b, s, fp in held.itertuples(index=False, name=None):
                if s < 0:
                    rejected += fp
                else:
                    table.put(b, s, fp)
            log = pd.DataFrame(log.to_numpy(), columns=names) if len(log) else pd.DataFrame(columns=names)
            return replayed(table, shard, rejected, log.sort_values("o", kind="stable"), destructive)

        # other names: a filter can be merged with itself, and then both sides come from one state
        names = ["shard", "fp", "i", "plus", "o"]
        renamed = log.select(*names).toDF(*(f"log_{c}" for c in names))
        return CuckooFilter(params, self.state.groupBy("shard").cogroup(renamed.groupBy("log_shard")).applyInPandas(go_on, _STATE), overflow)

    def add(self, df: DataFrame, column: str, order: str, op: str | None = None, destructive: bool = False) -> CuckooFilter:
        """With more elements in the given order; with op, '-' rows are removed. The number of shards stays."""
        return self._then(self._log(df, column, order, self.params, op), destructive)

    def remove(self, df: DataFrame, column: str) -> CuckooFilter:
        """Without one copy of each row's element. Elements that were never added may take others with them."""
        return self._then(self._log(df.withColumn("__q_o", F.lit(0)), column, "__q_o", self.params, None).withColumn("plus", F.lit(False)))

    def merge(self, other: CuckooFilter) -> CuckooFilter:
        """With the fingerprints of a filter of the same parameters; what finds no place counts as rejected."""
        if self.params != other.params:
            raise ValueError("filters of other parameters can't be merged")
        more = other.state.where("slot >= 0").select("shard", "fp", F.col("bucket").alias("i"), F.lit(True).alias("plus"), F.struct("bucket", "slot").alias("o"))
        more = more.withColumn("o", F.col("o.bucket") * self.params.bucket_size + F.col("o.slot"))
        lost = other.state.where("slot < 0")
        both = self._then(more)
        state = both.state.where("slot >= 0").unionAll(both.state.where("slot < 0").unionAll(lost).groupBy("shard", "bucket", "slot").agg(F.sum("fp").alias("fp")))
        return CuckooFilter(self.params, state, self.overflow and other.overflow)

    @classmethod
    def from_items(cls, df: DataFrame, column: str, order: str, rate: float, n: int | None = None, overflow: bool = True, **more) -> CuckooFilter:
        return cls.build(df, column, order, CuckooParams.create(max(1, n if n is not None else df.count()), rate, **more), overflow=overflow)

    def probe(self, df: DataFrame, column: str, out: str = "has") -> DataFrame:
        """Perhaps in the filter, or certainly not: elements of a shard that rejected some may all be in it."""
        shard, fp, first, second = self.locations(element(column, dict(df.dtypes)[column]))
        c = element(column, dict(df.dtypes)[column])
        keys = df.where(F.col(column).isNotNull()).select(c.alias("__q_e"), shard.alias("shard"), fp.alias("fp"), F.explode(F.array(first, second)).alias("bucket"))
        hits = keys.distinct().join(self.state.where("slot >= 0"), ["shard", "bucket", "fp"], "left_semi").select("__q_e").distinct().withColumn(out, F.lit(True))
        found = df.drop(out).withColumn("__q_e", c).join(hits, "__q_e", "left").drop("__q_e").withColumn(out, F.coalesce(out, F.lit(False)))
        if self.overflow:
            return found
        lossy = self.state.where("slot < 0 AND fp > 0").select(F.col("shard").alias("__q_shard"), F.lit(True).alias("__q_lossy")).distinct()
        rows = found.withColumn("__q_shard", shard).join(F.broadcast(lossy), "__q_shard", "left")
        return rows.withColumn(out, F.col(out) | (c.isNotNull() & F.coalesce("__q_lossy", F.lit(False)))).drop("__q_shard", "__q_lossy")

    def semi_join(self, df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
        """Exact: what probe() lets through is joined with the keys."""
        return self.probe(df, column, "__q_has").where("__q_has").drop("__q_has").join(keys.select(F.col(key).alias(column)), column, "left_semi")

    def load(self) -> DataFrame:
        """(used, free, size, load, n_rejected). With overflow more may be used than the size, and free is below 0 then."""
        size = self.params.buckets * self.params.bucket_size * self.params.shards
        used = F.count_if(F.col("slot") >= 0)
        return self.state.agg(used.alias("used"), (size - used).alias("free"), F.lit(size).cast("long").alias("size"), (used / size).alias("load"), F.coalesce(F.sum(F.when(F.col("slot") < 0, F.col("fp"))), F.lit(0)).alias("n_rejected"))

    def rate(self) -> float:
        """Expected false positive rate; 0 for an empty filter."""
        return self.params.rate() if self.length() else 0.0

    def length(self) -> int:
        return self.state.where("slot >= 0").count()

    def full_size(self) -> int:
        return self.params.buckets * self.params.bucket_size * self.params.shards

    def equals(self, other: CuckooFilter) -> bool:
        live = lambda f: f.state.where("slot >= 0")
        return self.params == other.params and same_rows(live(self), live(other))

    def to_json(self) -> str:
        p = self.params
        tables = [[[None] * p.bucket_size for _ in range(p.buckets)] for _ in range(p.shards)]
        for r in self.state.where("slot >= 0").toLocalIterator():
            bucket = tables[r.shard][r.bucket]
            bucket.extend([None] * (r.slot + 1 - len(bucket)))
            bucket[r.slot] = r.fp
        body = {"_size": p.buckets, "_fingerprintLength": p.fp_bits, "_bucketSize": p.bucket_size, "_maxKicks": p.max_kicks, "_shards": p.shards, "_length": self.length()}
        lost = [[r.shard, r.fp] for r in self.state.where("slot < 0 AND fp > 0").toLocalIterator()]
        body |= {"_rejected": lost} if lost else {}
        body |= {"_overflow": True} if self.overflow else {}
        filters = [[{"_size": p.bucket_size, "_elements": b, "_length": sum(x is not None for x in b)} for b in t] for t in tables]
        return json.dumps({"type": "CuckooFilter", **body, "_filter": filters, "_seed": seed_out(p.seed), "_hash": p.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> CuckooFilter:
        x = json.loads(text)
        p = CuckooParams(x["_size"], x["_fingerprintLength"], x["_bucketSize"], x["_maxKicks"], x["_shards"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")])
        rows = [(s, b, i, fp) for s, t in enumerate(x["_filter"]) for b, bucket in enumerate(t) for i, fp in enumerate(bucket["_elements"]) if fp is not None]
        rows += [(s, -1, -1, n) for s, n in x.get("_rejected", [])]
        return cls(p, spark.createDataFrame(rows, "shard int, bucket long, slot int, fp long"), x.get("_overflow", False))


def hex_prefix_location(c: Column, size: int, length: int, seed: int = DEFAULT_SEED, spec: HashSpec = XXH64) -> tuple[Column, Column, Column]:
    """The reference's geometry for any number of buckets: a fingerprint of hex digits and two buckets, the second from the whole hash."""
    h = spec.of(c, seed)
    fp = F.substring(F.lower(F.hex(h)), 1, length)
    return fp, spec.mod(h, size), spec.mod(h.bitwiseXOR(spec.of(fp, seed)), size)
