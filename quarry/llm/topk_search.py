"""Exact top-k inner products by a vector-approximation file.

The vectors are stored once, and beside them their approximation: blocks of cells of one byte a
component, on a grid of each block's own. The scan reads cells alone and gets a lower and an upper
bound of every score; what can't be among a query's k best by the bounds ends there. Exact vectors
are then read in the order of their upper bounds, until the kth best exact score lies above the
next bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import settle, tidy

#: Levels of a component's grid (256 at most), vectors of a stored block, queries that are bounded together, candidates that a task holds before it prunes them.
LEVELS, BLOCK, TOGETHER, HELD = 64, 2048, 256, 1 << 20
#: |scale * x| must lie below this: then differences of components fit 64 bits.
LARGEST = 2.0**61


def quantised(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): v holds floor(scale * x) of every component x. Vectors that are null or hold null or non-finite components are left out; a component of 2^61 or more after scaling raises."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def level(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < LARGEST, F.floor(y)).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("long"))

    fine = df.where(F.col(vec_col).isNotNull() & ~F.exists(F.col(vec_col), lambda x: bad(x.cast("double"))))
    return fine.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), level).alias("v"))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def approximate(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least values and widths of a grid over integer vectors, and their cells."""
    low = v.min(0)
    width = -(-(v.max(0) - low + 1) // LEVELS)
    return low, width, ((v - low) // width).astype(np.uint8)


def bounds(q: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of queries and cells: the scores of the cells' middles, and how far the exact ones may be off at most (a column, one row a query)."""
    middle = low + cells * width.astype(np.float64) + (width - 1) / 2
    size = np.abs(q)
    off = size @ ((width - 1) / 2) + 1e-9 * (1 + size @ np.abs(middle).max(0, initial=0))
    return q @ middle.T, off[:, None]


_BLOCKS = "m int, rows binary, ids binary, low binary, width binary, cells binary"


def _pack(stored: DataFrame, cells: bool) -> DataFrame:
    """Blocks of up to BLOCK vectors (row, id, v) of one length m: their approximation, or (cells false) themselves in cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = np.diff(b.column(2).offsets.to_numpy())
            for m in np.unique(lengths).tolist():
                some = b.filter(pa.array(lengths == m))
                for at in range(0, some.num_rows, BLOCK):
                    part = some.slice(at, BLOCK)
                    v = _matrix(part.column(2), m) if m else np.zeros((part.num_rows, 0), np.int64)
                    low, width, data = approximate(v) if cells else (v[:0], v[:0], v)
                    yield pa.RecordBatch.from_pylist([{"m": m, "rows": part.column(0).to_numpy().tobytes(), "ids": part.column(1).to_numpy().tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": data.tobytes()}], pa.schema([("m", pa.int32()), *((n, pa.binary()) for n in ("rows", "ids", "low", "width", "cells"))]))

    return stored.select("row", "id", "v").mapInArrow(tidy(run), _BLOCKS)


class _Asked:
    """Queries of one length in a task, and for each what may be among its k best."""

    def __init__(self, k: int):
        self.k, self.parts, self.q = k, [], None

    def take(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.parts.append((rows, ids, v))

    def close(self) -> None:
        self.rows, self.ids, q = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.q = q.astype(np.float64)
        self.best = np.full((len(self.q), self.k), -np.inf)  # the k best lower bounds
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def scan(self, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> None:
        if self.q is None:
            self.close()
        for at in range(0, len(self.q), TOGETHER):
            part = slice(at, at + TOGETHER)
            score, off = bounds(self.q[part], low, width, cells)
            score[self.ids[part, None] == ids[None, :]] = -np.inf  # a query's own rows are no candidates
            both = np.concatenate([self.best[part], score - off], 1)
            self.best[part] = np.partition(both, both.shape[1] - self.k, 1)[:, -self.k :]
            j, c = np.nonzero((score + off >= self.best[part].min(1, keepdims=True)) & (score > -np.inf))
            self.held.append((j + at, rows[c], (score - off)[j, c], (score + off)[j, c]))
            self.n += len(j)
        if self.n > HELD:
            self.prune()

    def prune(self) -> None:
        j, rows, low, high = (np.concatenate(c) for c in zip(*self.held, strict=True))
        ok = high >= self.best.min(1)[j]
        self.held = [(j[ok], rows[ok], low[ok], high[ok])]
        self.n = int(ok.sum())

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.q is not None and self.n:
            self.prune()
            j, rows, low, high = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.rows[j]), pa.array(rows), pa.array(low), pa.array(high)], names=["query", "row", "low", "high"])


def _scan(dealt: DataFrame, k: int) -> DataFrame:
    """(query, row, low, high): what may be among a query's k best by the cells of one part of the table. dealt: blocks by task, the queries of each first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, asked = None, {}
        whole = lambda x: np.frombuffer(x, np.int64)
        for b in batches:
            for r in b.to_pylist():
                if r["task"] != task:
                    for a in asked.values():
                        yield from a.out()
                    task, asked = r["task"], {}
                if r["kind"] == 0:
                    asked.setdefault(r["m"], _Asked(k)).take(whole(r["rows"]), whole(r["ids"]), whole(r["cells"]).reshape(-1, r["m"]) if r["m"] else np.zeros((len(r["rows"]) // 8, 0), np.int64))
                elif r["m"] in asked:
                    rows = whole(r["rows"])
                    asked[r["m"]].scan(rows, whole(r["ids"]), whole(r["low"]), whole(r["width"]), np.frombuffer(r["cells"], np.uint8).reshape(len(rows), r["m"]))
        for a in asked.values():
            yield from a.out()

    return dealt.mapInArrow(tidy(run), "query long, row long, low double, high double")


def _exact(pairs: DataFrame, stored: DataFrame) -> DataFrame:
    """(query, row, query_id, id, score) by the exact vectors. A score that 64 bits don't hold raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(k) for k in (4, 5))
            flat = [x.flatten().to_numpy() for x in (a, c)]
            at = a.offsets.to_numpy() - a.offsets.to_numpy()[0]
            if sum(np.abs(x).max(initial=0).astype(float).item() ** 2 for x in flat) * max(1, int(np.diff(at).max(initial=0))) < 2.0**62:
                sums = np.concatenate([[0], np.cumsum(flat[0] * flat[1])])  # wraps, and the differences wrap back
                score = sums[at[1:]] - sums[at[:-1]]
            else:
                found = [sum(x * y for x, y in zip(flat[0][i:j].tolist(), flat[1][i:j].tolist(), strict=True)) for i, j in zip(at, at[1:], strict=False)]
                if any(abs(x) >= 1 << 63 for x in found):
                    raise ArithmeticError("a score is beyond 64 bits")
                score = np.array(found, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(score)], names=["query", "row", "query_id", "id", "score"])

    # the queries' vectors first: one of them goes to many candidates, so sorted joins that Spark can split
    both = pairs.join(stored.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q")).hint("merge"), "query").join(stored.hint("merge"), "row")
    return both.select("query", "row", "query_id", "id", "q", "v").mapInArrow(tidy(run), "query long, row long, query_id long, id long, score long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block_bytes: int = 16 << 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id_col>, score): the k highest scores of every query against all other rows.

    Queries are the rows whose id is divisible by every. A vector is floor(scale * x) of its
    components; vectors that are null or hold null or non-finite components take no part, and
    neither do rows with a null id. Vectors meet only vectors of their own length. Ties go to the
    smaller id. Rows that bear the query's id are its own; a repeated query row is answered as
    often as it occurs, and of other repeated rows each counts. Components of 2^61 or more after
    scaling, and scores among those read that 64 bits don't hold, raise an error.

    Queries are dealt to tasks in groups of block_bytes at most, the cells of all vectors to every
    group in as many parts as keep the tasks busy; nothing passes the driver or is broadcast.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, scale, id_col, vec_col).where(F.col("id").isNotNull()).withColumn("id", F.col("id").cast("long"))
    stored = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    asking = stored.where(F.col("id") % every == 0)
    cells, queries = settle(_pack(stored, True)), settle(_pack(asking, False))
    (held,), (scanned,) = (t.agg(F.coalesce(F.sum(F.octet_length("cells") + F.octet_length("rows")), F.lit(0))).first() for t in (queries, cells))
    groups = max(1, -(-held // block_bytes))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-scanned // (4 * block_bytes)), min(-(-parts // groups), -(-scanned // 65_536)))
    every_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("rows"), F.lit(n)).cast("int")
    names = ["m", "rows", "ids", "low", "width", "cells"]
    asked = queries.withColumn("group", own(groups)).withColumn("share", every_of(shares)).select((F.col("group") * shares + F.col("share")).alias("task"), F.lit(0).alias("kind"), *names)
    given = cells.withColumn("share", own(shares)).withColumn("group", every_of(groups)).select((F.col("group") * shares + F.col("share")).alias("task"), F.lit(1).alias("kind"), *names)
    dealt = asked.unionAll(given).repartition(max(parts, groups * shares), "task").sortWithinPartitions("task", "kind")
    maybe = settle(_scan(dealt, k))

    by_low = Window.partitionBy("query").orderBy(F.desc("low"))
    floor = maybe.withColumn("no", F.row_number().over(by_low)).where(F.col("no") == k).select("query", F.col("low").alias("floor"))
    by_high = Window.partitionBy("query").orderBy(F.desc("high"), "row")
    left = maybe.join(floor, "query", "left").where(F.col("floor").isNull() | (F.col("high") >= F.col("floor")))
    left = settle(left.withColumn("no", F.row_number().over(by_high)).select("query", "row", "high", "no"))
    best, upto = None, 2 * k
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"), F.asc("row"))
    while True:  # the exact vectors in the order of their bounds, twice as many each time
        found = _exact(left.where(F.col("no") <= upto).select("query", "row"), stored)
        best = found if best is None else best.unionAll(found)
        best = settle(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)).drop("rank")
        kth = best.groupBy("query").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
        left = settle(left.where(F.col("no") > upto).join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("query", "row", "high", "no"))
        if left.isEmpty():
            break
        upto *= 2
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
