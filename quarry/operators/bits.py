"""Bit sets as relations of set positions, and what the membership filters share.

A filter's state is a DataFrame (group columns, bit): one row a set bit. Building is explode and
distinct, merging is union and distinct; Spark aggregates before it shuffles. A probe takes the
packed words as a scalar subquery while the filter is small enough, and joins by bit otherwise.
"""

from __future__ import annotations

import base64
import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits up to which a filter is packed into one value that all tasks get: two megabytes.
PACKED_BITS = 1 << 24
#: Bits up to which the words of a scalable filter are handed to all tasks: 32 megabytes.
HANDED_BITS = 1 << 28


def capacity(size: int) -> int:
    """A bit set holds whole bytes."""
    return -(-size // 8) * 8


def positions(df: DataFrame, pair: tuple[Column, Column], spread, by: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """(by, more, i, bit) of all positions that the rows of df set, with repeats. Both hashes are computed once a row."""
    hashed = df.select(*by, *more, pair[0].alias("__q_a"), pair[1].alias("__q_b"))
    names = [c for c in hashed.columns if c not in ("__q_a", "__q_b")]
    return hashed.select(*names, F.posexplode(F.array(*spread(F.col("__q_a"), F.col("__q_b")))).alias("i", "bit"))


def gather(rows: DataFrame, by: tuple[str, ...] = (), size: int | None = None) -> DataFrame:
    """(by, w, x) of rows (by, bit) with repeats: words of 64 bits, so that aggregation holds a group a word, not a bit. With size, words without a bit come as zeros."""
    cells = rows.select(*by, F.shiftright("bit", 6).alias("w"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("x"))
    if size is not None:
        cells = cells.unionAll(rows.sparkSession.range(0, -(-size // 64), 1, 1).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x")))
    return cells.groupBy(*by, "w").agg(F.bit_or("x").alias("x"))


def from_words(packed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bit) of the words (by, w, x)."""
    some = packed.select(*by, "w", "x", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
    return some.where(F.getbit("x", F.col("j")) == 1).select(*by, (F.col("w") * 64 + F.col("j")).alias("bit"))


def bit_count(state: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return state.groupBy(*by).agg(F.count(F.lit(1)).alias("set_bits"))


def highest(state: DataFrame) -> DataFrame:
    """The highest set bit; 0 for an empty set as for the set of bit 0."""
    return state.agg(F.coalesce(F.max("bit"), F.lit(0).cast("long")).alias("max_bit"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two states hold the same rows."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def words(packed: DataFrame) -> DataFrame:
    """One row, one column: the words of 64 bits in order, from gather() with a size of PACKED_BITS at most."""
    return packed.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("words"))


def held_words(state: DataFrame, size: int) -> np.ndarray:
    """The words of 64 bits of a state (bit) of HANDED_BITS at most, on the driver."""
    got = gather(state).toArrow()
    out = np.zeros(-(-size // 64), np.uint64)
    out[got.column("w").to_numpy()] = got.column("x").to_numpy().view(np.uint64)
    return out


def all_set(packed: Column, positions: list[Column]) -> Column:
    """Whether all positions of a row are set in the packed words; asks no further than the first that isn't."""
    hit = F.lit(True)
    for e in positions:
        hit = hit & (F.getbit(F.get(packed, F.shiftright(e, 6).cast("int")), e.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1)
    return hit


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, which a filter on what is made of them doesn't compute again for each use.

    As a generator's output they stay where they are, while filters on df's own columns pass below.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def probe(df: DataFrame, c: Column, pair: tuple[Column, Column], spread, state: DataFrame, size: int, by: tuple[str, ...], out: str, packed_bits: int = PACKED_BITS, packed: DataFrame | None = None) -> DataFrame:
    """df with a boolean column out: all positions of the row are set (in the filter of its group). Null elements are in no filter.

    Beyond packed_bits, or with groups, the distinct elements are exploded and joined by bit, and
    those that meet all their positions come back in one more join. packed: the words, where they
    are at hand. Nothing here depends on a row's place, so filters on df still reach its scan.
    """
    df = df.drop(out)
    if not by and size <= min(packed_bits, PACKED_BITS):
        hashed = computed_once(df, {"__q_a": pair[0], "__q_b": pair[1]})
        hit = all_set(words(gather(state, (), size) if packed is None else packed).scalar(), spread(F.col("__q_a"), F.col("__q_b")))
        return hashed.withColumn(out, c.isNotNull() & F.coalesce(hit, F.lit(False))).drop("__q_a", "__q_b")
    keys = df.where(c.isNotNull()).select(*by, c.alias("__q_e"), pair[0].alias("__q_x"), pair[1].alias("__q_y")).distinct()
    cells = positions(keys, (F.col("__q_x"), F.col("__q_y")), spread, by, F.col("__q_e"))
    k = len(spread(F.lit(0), F.lit(0)))
    hits = cells.join(state, [*by, "bit"], "left_semi").groupBy(*by, "__q_e").count().where(F.col("count") == k).select(*by, "__q_e", F.lit(True).alias(out))
    found = df.withColumn("__q_e", c).join(hits, [*by, "__q_e"], "left")
    return found.select(*[F.col(f"`{x}`") for x in df.columns], F.coalesce(F.col(out), F.lit(False)).alias(out))


# ------------------------------------------------------------------ interchange

def single(by: tuple[str, ...]) -> None:
    """JSON holds one sketch: groups would fall together."""
    if by:
        raise ValueError("grouped sketches have no JSON; export one group at a time, or use save()")


def to_bytes(state: DataFrame, size: int) -> bytes:
    """Bytes of the set, least significant bit first. The words come one after another; the driver holds the result."""
    out = bytearray(-(-size // 64) * 8)
    for r in gather(state).toLocalIterator():
        out[8 * r.w : 8 * r.w + 8] = (r.x % (1 << 64)).to_bytes(8, "little")
    return bytes(out[: capacity(size) // 8])


def export(state: DataFrame, size: int) -> dict:
    return {"size": capacity(size), "content": base64.b64encode(to_bytes(state, size)).decode()}


def exports(state: DataFrame, part: str, count: int, size: int) -> list[dict]:
    """As export(), of parts 0 to count - 1 of a state (part, bit) at once."""
    out = [bytearray(-(-size // 64) * 8) for _ in range(count)]
    for r in gather(state.select(part, "bit"), (part,)).toLocalIterator():
        out[r[part]][8 * r.w : 8 * r.w + 8] = (r.x % (1 << 64)).to_bytes(8, "little")
    return [{"size": capacity(size), "content": base64.b64encode(bytes(x[: capacity(size) // 8])).decode()} for x in out]


def set_positions(data: dict | list) -> list[int]:
    """The positions in {size, content}, or in a list of 0 and 1 as older exports have it."""
    if isinstance(data, list):
        return [i for i, x in enumerate(data) if x]
    if not isinstance(data.get("size"), int) or not isinstance(data.get("content"), str):
        raise ValueError("a bit set needs a numeric size and a string content")
    raw = base64.b64decode(data["content"])
    return [8 * i + j for i, byte in enumerate(raw) for j in range(8) if byte >> j & 1]


def load(spark: SparkSession, data: dict | list) -> DataFrame:
    """The state of what set_positions() reads."""
    return spark.createDataFrame([(i,) for i in set_positions(data)], "bit long")


class BitSet:
    """A set of positions below a size that is rounded up to whole bytes. Positions outside are passed over."""

    def __init__(self, size: int, state: DataFrame):
        self.size, self.state = capacity(size), state.select("bit").where((F.col("bit") >= 0) & (F.col("bit") < capacity(size))).distinct()

    @classmethod
    def of(cls, df: DataFrame, column: str, size: int) -> BitSet:
        return cls(size, df.select(F.col(column).cast("long").alias("bit")).where("bit is not null"))

    def add(self, df: DataFrame, column: str) -> BitSet:
        return BitSet(self.size, self.state.unionAll(df.select(F.col(column).cast("long").alias("bit"))))

    def has(self, df: DataFrame, column: str, out: str = "has") -> DataFrame:
        marks = self.state.select(F.col("bit").alias("__q_b"), F.lit(True).alias(out))
        return df.drop(out).join(marks, F.col(column) == F.col("__q_b"), "left").drop("__q_b").withColumn(out, F.coalesce(out, F.lit(False)))

    def max(self) -> int:
        return highest(self.state).first()[0]

    def bit_count(self) -> int:
        return self.state.count()

    def equals(self, other: BitSet) -> bool:
        return self.size == other.size and same_rows(self.state, other.state)

    def packed(self) -> DataFrame:
        """(bucket, bitmap): Spark's own bitmap layout, 32,768 bits a bucket, for storage at any size."""
        at = F.col("bit") + 1
        return self.state.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))

    def to_json(self) -> str:
        return json.dumps(export(self.state, self.size))

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> BitSet:
        data = json.loads(text)
        return cls(data["size"], load(spark, data))


def high_bit(c: Column) -> Column:
    """The highest set bit of a byte, -1 for zero."""
    return F.length(F.bin(c)) - F.when(c == 0, 2).otherwise(1)


def xor_bytes(a: bytes, b: bytes) -> bytes:
    """XOR of two byte strings aligned at their ends, without leading zero bytes."""
    n = max(len(a), len(b))
    return bytes(x ^ y for x, y in zip(a.rjust(n, b"\0"), b.rjust(n, b"\0"), strict=True)).lstrip(b"\0")
