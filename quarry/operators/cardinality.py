"""Distinct counts: explicit HyperLogLog registers, and Spark's own sketches."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import SPECS, XXH64, HashSpec, element
from quarry.functions.params import DEFAULT_SEED, hll_alpha
from quarry.operators.bits import same_rows, single
from quarry.operators.bloom import seed_in, seed_out


@dataclass(frozen=True)
class HLLParams:
    m: int
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    def __post_init__(self):
        if self.m & (self.m - 1) or not 16 <= self.m <= 1 << 16:
            raise ValueError("registers must be a power of two from 16 to 65536")

    @property
    def b(self) -> int:
        return self.m.bit_length() - 1

    @property
    def width(self) -> int:
        """Bits of a hash value."""
        return 64 if self.spec.signed else 60

    @property
    def relative_error(self) -> float:
        return 1.04 / math.sqrt(self.m)


class HyperLogLog:
    """State: (by, register, rank): the largest 1-based place of the first 1 bit above the register bits."""

    def __init__(self, params: HLLParams, state: DataFrame, by: tuple[str, ...] = ()):
        self.params, self.state, self.by = params, state, tuple(by)

    @staticmethod
    def cell(c: Column, p: HLLParams) -> tuple[Column, Column]:
        h = p.spec.of(c, p.seed)
        rest, free = F.shiftrightunsigned(h, p.b), p.width - p.b
        rank = F.when(rest == 0, free + 1).otherwise(free + 1 - F.length(F.bin(rest)))
        return h.bitwiseAND(F.lit(p.m - 1).cast("long")).cast("int"), rank.cast("int")

    @classmethod
    def build(cls, df: DataFrame, column: str, params: HLLParams, by: tuple[str, ...] = ()) -> HyperLogLog:
        register, rank = cls.cell(element(column, dict(df.dtypes)[column]), params)
        rows = df.where(F.col(column).isNotNull()).select(*by, register.alias("register"), rank.alias("rank"))
        return cls(params, rows.groupBy(*by, "register").agg(F.max("rank").alias("rank")), by)

    def update(self, df: DataFrame, column: str) -> HyperLogLog:
        return self.merge(self.build(df, column, self.params, self.by))

    def merge(self, other: HyperLogLog) -> HyperLogLog:
        if self.params != other.params:
            raise ValueError("sketches of other parameters can't be merged")
        return HyperLogLog(self.params, self.state.unionByName(other.state).groupBy(*self.by, "register").agg(F.max("rank").alias("rank")), self.by)

    def rollup(self, by: tuple[str, ...] = ()) -> HyperLogLog:
        """The sketch of coarser groups."""
        return HyperLogLog(self.params, self.state.groupBy(*by, "register").agg(F.max("rank").alias("rank")), by)

    def estimate(self, reference: bool = False) -> DataFrame:
        """(by, estimate). Linear counting below 2.5 m while registers are empty.

        With reference, ranks count from 0 and the raw estimate is doubled, as the reference has it;
        its registers of rank 0 look empty, so small counts come out about half.
        """
        m, big = self.params.m, 2.0**32
        # a register without a row has rank 0
        z = F.sum(F.pow(F.lit(2.0), -(F.col("rank") - (1 if reference else 0)))) + (m - F.count(F.lit(1)))
        empty = m - F.sum(F.when(F.col("rank") > (1 if reference else 0), 1).otherwise(0))
        found = self.state.groupBy(*self.by).agg(z.alias("z"), empty.alias("v"))
        raw = (2 if reference else 1) * hll_alpha(m) * m * m / F.col("z")
        small = F.when(F.col("v") > 0, m * F.log(m / F.col("v"))).otherwise(raw)
        return found.select(*self.by, F.when(raw <= 2.5 * m, small).when(raw <= big / 30, raw).otherwise(-big * F.log1p(-raw / big)).alias("estimate"))

    def count(self) -> float:
        """The estimate of an ungrouped sketch; 0 for an empty one."""
        return self.estimate().first()[0] or 0.0

    def equals(self, other: HyperLogLog) -> bool:
        return self.params == other.params and same_rows(self.state, other.state)

    def to_json(self) -> str:
        """Of an ungrouped sketch."""
        single(self.by)
        registers = [0] * self.params.m
        for r in self.state.collect():  # m rows at most
            registers[r.register] = r["rank"]
        p = self.params
        return json.dumps({"type": "HyperLogLog", "_m": p.m, "_b": p.b, "_correctionBias": hll_alpha(p.m), "_registers": registers, "_seed": seed_out(p.seed), "_hash": p.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> HyperLogLog:
        x = json.loads(text)
        rows = [(i, r) for i, r in enumerate(x["_registers"]) if r]
        return cls(HLLParams(x["_m"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")]), spark.createDataFrame(rows, "register int, rank int"))


def native_hll(df: DataFrame, column: str, by: tuple[str, ...] = (), lg_k: int = 12) -> DataFrame:
    """(by, sketch): Spark's mergeable binary sketch, the path for plain distinct counts."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(F.col(column), F.lit(lg_k)).alias("sketch"))


def native_hll_estimate(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, estimate) of the union of sketches in each group."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
