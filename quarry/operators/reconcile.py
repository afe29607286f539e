"""Set reconciliation with invertible Bloom lookup tables."""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.hashing import SPECS, XXH64, HashSpec
from quarry.functions.params import DEFAULT_SEED, iblt_cells
from quarry.operators.bits import same_rows, single
from quarry.operators.bloom import seed_in, seed_out

LIMB = 7


@dataclass(frozen=True)
class IBLTParams:
    """Cells for so many differences. An element is at most max_bytes of UTF-8; fitting() takes that from the elements."""

    differences: int
    alpha: float = 2.0
    hashes: int = 6
    max_bytes: int = 28
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    @classmethod
    def fitting(cls, differences: int, *items: DataFrame, **more) -> IBLTParams:
        """With room for the longest element of the given one-column frames, whatever its length."""
        longest = max((df.agg(F.max(F.octet_length(F.col(df.columns[0]).cast("string")))).first()[0] or 0 for df in items), default=0)
        return cls(differences, max_bytes=max(1, longest), **more)

    @property
    def size(self) -> int:
        return iblt_cells(self.differences, self.alpha, self.hashes)

    @property
    def block(self) -> int:
        return self.size // self.hashes

    @property
    def limbs(self) -> int:
        return -(-self.max_bytes // LIMB)

    def cells(self, value: bytes) -> list[int]:
        """The cells of a value: one in each of `hashes` blocks, so no cell comes twice."""
        return [i * self.block + self.spec.py(value, self.seed + 10 + i) % self.block for i in range(self.hashes)]

    def check(self, value: bytes) -> int:
        return self.spec.py(value, self.seed + 5) & 0xFFFFFFFF


class IBLT:
    """State: (by, cell, limb0 ..., len_x, hash_x, cnt).

    An element's bytes stand right-aligned in limbs of seven bytes, so that bit_xor folds them; its
    length is folded too, so that leading zero bytes survive. Folding is a sum and some XORs: a
    monoid that Spark aggregates before it shuffles.
    """

    def __init__(self, params: IBLTParams, state: DataFrame, by: tuple[str, ...] = ()):
        self.params, self.state, self.by = params, state, tuple(by)

    def _fold(self, rows: DataFrame) -> DataFrame:
        names = [*(f"limb{i}" for i in range(self.params.limbs)), "len_x", "hash_x"]
        return rows.groupBy(*self.by, "cell").agg(*[F.bit_xor(n).alias(n) for n in names], F.sum("cnt").alias("cnt"))

    @classmethod
    def build(cls, df: DataFrame, column: str, params: IBLTParams, by: tuple[str, ...] = (), op: str | None = None) -> IBLT:
        """Of a string column; with op, '-' rows are taken away. Null elements are passed over, longer ones than max_bytes raise."""
        p = params
        raw = F.encode(F.col("e"), "UTF-8")
        fits = F.when(F.octet_length("e") <= p.max_bytes, F.hex(raw)).otherwise(F.raise_error(F.lit(f"an element has over {p.max_bytes} bytes")))
        padded = F.lpad(fits, p.limbs * LIMB * 2, "0")
        limbs = [F.conv(F.substring(padded, i * LIMB * 2 + 1, LIMB * 2), 16, 10).cast("long").alias(f"limb{i}") for i in range(p.limbs)]
        cells = [p.spec.mod(p.spec.of(F.col("e"), p.seed + 10 + i), p.block) + i * p.block for i in range(p.hashes)]
        check = p.spec.of(F.col("e"), p.seed + 5).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        sign = F.lit(1) if op is None else F.when(F.col(op) == "-", -1).otherwise(1)
        rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("string").alias("e"), sign.cast("long").alias("cnt"))
        rows = rows.select(*by, F.explode(F.array(*cells)).alias("cell"), *limbs, F.octet_length("e").cast("long").alias("len_x"), check.alias("hash_x"), "cnt")
        return cls(p, cls(p, df, by)._fold(rows), by)

    def _with(self, other: IBLT, sign: int) -> IBLT:
        if self.params != other.params:
            raise ValueError("tables of other parameters can't be combined")
        return IBLT(self.params, self._fold(self.state.unionByName(other.state.withColumn("cnt", F.col("cnt") * sign))), self.by)

    def add(self, df: DataFrame, column: str) -> IBLT:
        return self._with(self.build(df, column, self.params, self.by), 1)

    def remove(self, df: DataFrame, column: str) -> IBLT:
        return self._with(self.build(df, column, self.params, self.by), -1)

    def merge(self, other: IBLT) -> IBLT:
        return self._with(other, 1)

    def subtract(self, other: IBLT) -> IBLT:
        return self._with(other, -1)

    def length(self) -> int:
        """Net number of elements."""
        return (self.state.agg(F.sum("cnt")).first()[0] or 0) // self.params.hashes

    def probe(self, df: DataFrame, column: str, out: str = "has") -> DataFrame:
        """Perhaps in the table (none of its cells counts zero), or certainly not."""
        p = self.params
        e = F.col(column).cast("string")
        cells = F.array(*[p.spec.mod(p.spec.of(e, p.seed + 10 + i), p.block) + i * p.block for i in range(p.hashes)])
        keys = df.where(F.col(column).isNotNull()).select(e.alias("__q_e"), F.explode(cells).alias("cell")).distinct()
        hits = keys.join(self.state.where("cnt <> 0"), "cell", "left_semi").groupBy("__q_e").count().where(F.col("count") == p.hashes).select("__q_e", F.lit(True).alias(out))
        joined = df.drop(out).withColumn("__q_e", e).join(hits, "__q_e", "left").drop("__q_e")
        return joined.withColumn(out, F.coalesce(out, F.lit(False)))

    def decode(self) -> DataFrame:
        """(side, value): 'additional' elements of the left set, 'missing' ones of the right; for what can't be peeled (side 'residue', value null) one row a cell.

        The state has one row a cell at most, whatever the sets' sizes, so one task peels it.
        """
        p, n = self.params, self.params.limbs

        def peel(pdf: pd.DataFrame) -> pd.DataFrame:
            cells = {r[0]: [sum(int(v) << (8 * LIMB * (n - 1 - i)) for i, v in enumerate(r[1 : n + 1])), int(r[n + 1]), int(r[n + 2]), int(r[n + 3])] for r in pdf.itertuples(index=False, name=None)}

            def pure(c: int) -> bytes | None:
                number, length, check, count = cells[c]
                if abs(count) != 1 or not 0 <= length <= p.max_bytes or number >> (8 * length):
                    return None
                value = number.to_bytes(length, "big")
                return value if p.check(value) == check else None

            out, queue = [], deque(c for c in sorted(cells) if pure(c) is not None)
            while queue:
                c = queue.popleft()
                if (value := pure(c)) is None:
                    continue
                sign = cells[c][3]
                out.append(("additional" if sign > 0 else "missing", value.decode("utf-8", "replace")))
                for other in p.cells(value):
                    cell = cells.setdefault(other, [0, 0, 0, 0])
                    cell[0] ^= int.from_bytes(value, "big")
                    cell[1] ^= len(value)
                    cell[2] ^= p.check(value)
                    cell[3] -= sign
                    if pure(other) is not None:
                        queue.append(other)
            out += [("residue", None)] * sum(any(v) for v in cells.values())
            return pd.DataFrame(out, columns=["side", "value"])

        names = ["cell", *(f"limb{i}" for i in range(n)), "len_x", "hash_x", "cnt"]
        return self.state.select(*names).groupBy(F.lit(0).alias("all")).applyInPandas(lambda pdf: peel(pdf[names]), "side string, value string")

    def decode_status(self) -> dict:
        counts = {r.side: r["count"] for r in self.decode().groupBy("side").count().collect()}
        return {"success": "residue" not in counts, "additional": counts.get("additional", 0), "missing": counts.get("missing", 0)}

    def list_entries(self) -> DataFrame:
        """All elements that can be peeled, whichever side they are on."""
        return self.decode().where("side <> 'residue'").select("value")

    def equals(self, other: IBLT) -> bool:
        live = lambda t: t.state.where("cnt <> 0 or hash_x <> 0 or len_x <> 0")
        return self.params == other.params and same_rows(live(self), live(other))

    def to_json(self) -> str:
        """Of an ungrouped sketch."""
        single(self.by)
        p = self.params
        rows = [r.asDict() for r in self.state.orderBy("cell").collect()]  # size rows at most
        return json.dumps({"type": "InvertibleBloomFilter", "_size": p.size, "_hashCount": p.hashes, "_differences": p.differences, "_alpha": p.alpha, "_maxBytes": p.max_bytes, "_elements": rows, "_seed": seed_out(p.seed), "_hash": p.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> IBLT:
        x = json.loads(text)
        p = IBLTParams(x["_differences"], x["_alpha"], x["_hashCount"], x["_maxBytes"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")])
        names = ["cell", *(f"limb{i}" for i in range(p.limbs)), "len_x", "hash_x", "cnt"]
        return cls(p, spark.createDataFrame([tuple(r[n] for n in names) for r in x["_elements"]], ", ".join(f"{n} long" for n in names)))


def exact_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(side, value): the two-sided difference of the distinct elements by anti joins."""
    a, b = (x.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct() for x in (a, b))
    return a.join(b, "value", "left_anti").select(F.lit("additional").alias("side"), "value").unionAll(b.join(a, "value", "left_anti").select(F.lit("missing").alias("side"), "value"))


