"""MinHash signatures of integer sets, their comparison and banded candidate pairs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.params import DEFAULT_SEED, hash_family
from quarry.operators.bits import same_rows, single


class MinHash:
    """State: (by, sig): for each function (a, b, c) the least (a x + b) mod c of a set's elements. A set without elements has no row."""

    def __init__(self, family: list[tuple[int, int, int]], state: DataFrame, by: tuple[str, ...] = ()):
        self.family, self.state, self.by = [tuple(f) for f in family], state, tuple(by)

    @staticmethod
    def make_family(count: int, max_value: int, seed: int = DEFAULT_SEED) -> list[tuple[int, int, int]]:
        return hash_family(count, max_value, seed)

    @classmethod
    def build(cls, df: DataFrame, column: str, family: list[tuple[int, int, int]], by: tuple[str, ...] = ()) -> MinHash:
        """All functions in one pass over the elements; null elements are passed over."""
        x = F.col(column).cast("long")
        least = [F.min((F.lit(a).cast("long") * x + F.lit(b).cast("long")) % F.lit(c).cast("long")) for a, b, c in family]
        return cls(family, df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.array(*least).alias("sig")).where(F.get("sig", F.lit(0)).isNotNull()), by)

    def merge(self, other: MinHash) -> MinHash:
        """The signatures of the unions of sets."""
        self._alike(other)
        least = [F.min(F.get("sig", F.lit(i))) for i in range(len(self.family))]
        return MinHash(self.family, self.state.unionByName(other.state).groupBy(*self.by).agg(F.array(*least).alias("sig")), self.by)

    def equals(self, other: MinHash) -> bool:
        return self.family == other.family and same_rows(self.state, other.state)

    def is_empty(self) -> bool:
        return self.state.isEmpty()

    def _alike(self, other: MinHash) -> None:
        if self.family != other.family:
            raise ValueError("signatures of other hash families can't be compared")

    def compare(self, other: MinHash) -> float:
        """Estimated Jaccard similarity of two ungrouped sets; raises if one is empty."""
        self._alike(other)
        a, b = self.state.first(), other.state.first()
        if a is None or b is None:
            raise ValueError("an empty set can't be compared")
        return sum(x == y for x, y in zip(a.sig, b.sig, strict=True)) / len(self.family)

    def long(self) -> DataFrame:
        """(by, fn, min_hash)."""
        return self.state.select(*self.by, F.posexplode("sig").alias("fn", "min_hash"))

    def candidates(self, rows: int) -> DataFrame:
        """(a, b, matches): pairs of sets whose signatures agree in a whole band of `rows` functions, compared in full.

        Sets with equal signatures are one class: only the class's least set is paired, and each other
        member comes as a pair with it, so that copies don't multiply.
        """
        (key,) = self.by
        named = self.state.groupBy("sig").agg(F.min(key).alias("__q_k"))
        bands = len(self.family) // rows
        band = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.slice("sig", i * rows + 1, rows).alias("part")) for i in range(bands)]))
        keyed = named.select("__q_k", band.alias("band"))
        left, right = keyed.select(F.col("__q_k").alias("a"), "band"), keyed.select(F.col("__q_k").alias("b"), "band")
        pairs = left.join(right, "band").where("a < b").select("a", "b").distinct()
        members = self.state.join(named, "sig").where(F.col(key) != F.col("__q_k")).select(F.col("__q_k").alias("a"), F.col(key).alias("b"))
        return self.verify(pairs.unionAll(members), key)

    def verify(self, pairs: DataFrame, key: str) -> DataFrame:
        """(a, b, matches) for given pairs."""
        s = self.state
        both = pairs.join(s.select(F.col(key).alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col(key).alias("b"), F.col("sig").alias("sb")), "b")
        return both.select("a", "b", agreement(F.col("sa"), F.col("sb")).alias("matches"))

    def to_json(self) -> str:
        """Of one set's signature."""
        single(self.by)
        first = self.state.first()
        return json.dumps({"type": "MinHash", "_nbHashes": len(self.family), "_hashFunctions": [dict(zip("abc", f, strict=True)) for f in self.family], "_signature": None if first is None else first.sig})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> MinHash:
        x = json.loads(text)
        sig = x["_signature"]
        rows = [] if sig is None or any(v is None for v in sig) else [(sig,)]
        return cls([(f["a"], f["b"], f["c"]) for f in x["_hashFunctions"]], spark.createDataFrame(rows, "sig array<long>"))


def agreement(a: Column, b: Column) -> Column:
    """Number of places where two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
