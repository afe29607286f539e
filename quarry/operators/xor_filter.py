"""XOR filters: built a shard at a time by peeling, probed by three lookups."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import SPECS, XXH64, HashSpec, element, xxh64_long
from quarry.functions.params import DEFAULT_SEED, xor_slots
from quarry.operators.bits import same_rows
from quarry.operators.bloom import seed_in, seed_out

#: Bits of a fingerprint and the type that holds it.
WIDTHS = {8: "tinyint", 16: "smallint", 32: "int", 64: "bigint"}
RETRIES = 100
_U = np.uint64
_P = [_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)]
_P5 = 0x27D4EB2F165667C5


def _hash_longs(x: np.ndarray, seed: int) -> np.ndarray:
    """xxhash64(seed, x) of a column of longs, as Spark computes it."""
    h = _U((xxh64_long(seed) + _P5 + 8) % (1 << 64))
    rot = lambda v, r: (v << _U(r)) | (v >> _U(64 - r))
    h = h ^ (rot(x * _P[1], 31) * _P[0])
    h = rot(h, 27) * _P[0] + _P[3]
    h = (h ^ (h >> _U(33))) * _P[1]
    h = (h ^ (h >> _U(29))) * _P[2]
    return h ^ (h >> _U(32))


@dataclass(frozen=True)
class XorParams:
    width: int = 8
    shard_keys: int = 1 << 18
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    def __post_init__(self):
        if self.width not in WIDTHS:
            raise ValueError(f"the width must be one of {[*WIDTHS]}")

    @property
    def schema(self) -> str:
        return f"shard int, seed long, block long, prints array<{WIDTHS[self.width]}>"


def peel(keys: np.ndarray, width: int) -> tuple[int, int, np.ndarray]:
    """Seed, block length and fingerprints for distinct 64-bit keys. Reseeds until the slots peel, RETRIES times at most."""
    block = xor_slots(len(keys)) // 3
    mask = _U((1 << width) - 1)
    for seed in range(RETRIES):
        h = _hash_longs(keys, seed)
        at = np.stack([((h >> _U(21 * i)) % _U(block)).astype(np.int64) + i * block for i in range(3)])
        count = np.bincount(at.ravel(), minlength=3 * block)
        who = np.zeros(3 * block, np.int64)
        for row in at:
            np.bitwise_xor.at(who, row, np.arange(len(keys)))
        order: list[tuple[np.ndarray, np.ndarray]] = []
        gone = np.zeros(len(keys), bool)
        single = np.flatnonzero(count == 1)
        while len(single):
            key, first = np.unique(who[single], return_index=True)
            slot = single[first]
            fresh = ~gone[key]
            key, slot = key[fresh], slot[fresh]
            gone[key] = True
            order.append((key, slot))
            for row in at:
                np.subtract.at(count, row[key], 1)
                np.bitwise_xor.at(who, row[key], key)
            touched = np.unique(at[:, key])
            single = touched[count[touched] == 1]
        if gone.all():
            prints = (h ^ (h >> _U(32))) & mask
            table = np.zeros(3 * block, _U)
            for key, slot in reversed(order):
                table[slot] = _U(0)
                table[slot] = prints[key] ^ table[at[0][key]] ^ table[at[1][key]] ^ table[at[2][key]]
            return seed, block, table
    raise RuntimeError(f"no seed of {RETRIES} let the keys be peeled")


class XorFilter:
    """State: (shard, seed, block, prints). Keys are dealt to shards by hash so that a shard fits a task; the seed is found by the build."""

    def __init__(self, params: XorParams, shards: int, state: DataFrame):
        self.params, self.shards, self.state = params, shards, state

    def _key(self, c: Column) -> Column:
        return self.params.spec.of(c, self.params.seed)

    def _shard(self, c: Column) -> Column:
        return self.params.spec.mod(self.params.spec.of(c, self.params.seed + 1), self.shards).cast("int")

    @classmethod
    def build(cls, df: DataFrame, column: str, params: XorParams = XorParams(), n: int | None = None, shards: int | None = None) -> XorFilter:
        """Of the distinct elements; nulls are passed over, an empty set raises. shards: their number, else as many as hold shard_keys each; a shard is built by one task."""
        keys = df.where(F.col(column).isNotNull()).select(element(column, dict(df.dtypes)[column]).alias("e")).distinct()
        n = keys.count() if n is None else n
        if n < 1:
            raise ValueError("an XOR filter needs one element at least")
        made = cls(params, shards or -(-n // params.shard_keys), keys)

        width = params.width // 8  # bytes

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            seed, block, table = peel(np.unique(pdf["k"].to_numpy().astype(np.int64).view(_U)), params.width)
            return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [seed], "block": [block], "prints": [table.astype(f"u{width}").view(f"i{width}").tolist()]})

        rows = keys.select(made._shard(F.col("e")).alias("shard"), made._key(F.col("e")).alias("k"))
        made.state = rows.groupBy("shard").applyInPandas(one, params.schema)
        return made

    def probe(self, df: DataFrame, column: str, out: str = "has") -> DataFrame:
        """Perhaps in the set, or certainly not. Rows are joined to their shard's fingerprints; Spark broadcasts them while they are small."""
        c = element(column, dict(df.dtypes)[column])
        mod = lambda h, m: F.pmod(F.pmod(h, m) + F.when(h < 0, F.pmod(F.pmod(F.lit(2**63 - 1), m) * 2 + 2, m)).otherwise(0), m)
        tables = self.state.select(F.col("shard").alias("__q_shard"), F.col("seed").alias("__q_seed"), F.col("block").alias("__q_block"), F.col("prints").alias("__q_prints"))
        got = df.drop(out).withColumns({"__q_shard": self._shard(c), "__q_key": self._key(c)}).join(tables, "__q_shard", "left")
        got = got.withColumn("__q_h", F.xxhash64("__q_seed", "__q_key"))
        h, block = F.col("__q_h"), F.col("__q_block")
        slot = [F.get("__q_prints", (mod(F.shiftrightunsigned(h, 21 * i), block) + i * block).cast("int")).cast("long") for i in range(3)]
        want = h.bitwiseXOR(F.shiftrightunsigned(h, 32))
        mask = F.lit(-1 if self.params.width == 64 else (1 << self.params.width) - 1).cast("long")
        hit = want.bitwiseXOR(slot[0]).bitwiseXOR(slot[1]).bitwiseXOR(slot[2]).bitwiseAND(mask) == 0
        return got.withColumn(out, c.isNotNull() & F.coalesce(hit, F.lit(False))).drop("__q_shard", "__q_seed", "__q_block", "__q_prints", "__q_key", "__q_h")

    def semi_join(self, df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
        return self.probe(df, column, "__q_has").where("__q_has").drop("__q_has").join(keys.select(F.col(key).alias(column)), column, "left_semi")

    def equals(self, other: XorFilter) -> bool:
        return (self.params, self.shards) == (other.params, other.shards) and same_rows(self.state, other.state)

    def to_json(self) -> str:
        rows = [{"shard": r.shard, "_seed": r.seed, "_blockLength": r.block, "_filter": [seed_out(v % (1 << self.params.width)) for v in r.prints]} for r in self.state.orderBy("shard").toLocalIterator()]
        p = self.params
        return json.dumps({"type": "XorFilter", "_bits": p.width, "_shards": self.shards, "_filters": rows, "_seed": seed_out(p.seed), "_hash": p.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> XorFilter:
        x = json.loads(text)
        signed = lambda v: v - (1 << x["_bits"]) if v >> (x["_bits"] - 1) else v
        rows = [(r["shard"], r["_seed"], r["_blockLength"], [signed(seed_in(v)) for v in r["_filter"]]) for r in x["_filters"]]
        p = XorParams(x["_bits"], seed=seed_in(x["_seed"]), spec=SPECS[x.get("_hash", "xxh64")])
        return cls(p, x["_shards"], spark.createDataFrame(rows, p.schema))
