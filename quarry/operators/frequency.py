"""Frequencies: count-min sketches and top-k."""

from __future__ import annotations

import json
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.hashing import SPECS, XXH64, HashSpec, element, from_pair, pair
from quarry.functions.params import DEFAULT_SEED, check_rate
from quarry.operators.bits import computed_once, positions, same_rows, single
from quarry.operators.bloom import seed_in, seed_out

#: Totals that an exact top-k exports as one JSON text at most; to_json_lines() and save() of sources/store.py have no such bound.
EXPORTED = 1 << 20
#: Cells up to which a sketch is packed into one value that all tasks get: two megabytes.
PACKED_CELLS = 1 << 18


@dataclass(frozen=True)
class CMSParams:
    columns: int
    rows: int
    seed: int = DEFAULT_SEED
    spec: HashSpec = XXH64

    def __post_init__(self):
        if self.columns < 1 or self.rows < 1:
            raise ValueError("a sketch needs one row and one column at least")

    @classmethod
    def create(cls, error: float, accuracy: float = 0.999, reference: bool = False, **more) -> CMSParams:
        """ceil(e / error) columns; rows for a failure probability of 1 - accuracy, or of accuracy in the reference's geometry."""
        failure = accuracy if reference else 1 - accuracy
        return cls(math.ceil(math.e / check_rate(error)), max(1, math.ceil(math.log(1 / failure))), **more)


class CountMinSketch:
    """State: (by, row, col, cnt). Estimates never lie below the true weight while weights are positive."""

    def __init__(self, params: CMSParams, state: DataFrame, by: tuple[str, ...] = ()):
        self.params, self.state, self.by = params, state, tuple(by)

    def _cells(self, df: DataFrame, c: Column, *more: Column) -> DataFrame:
        """(by, more, row, col) of the elements."""
        p = self.params
        rows = positions(df, pair(c, p.columns, p.seed, p.spec), lambda a, b: from_pair(a, b, p.columns, p.rows), self.by, *more)
        return rows.withColumnsRenamed({"i": "row", "bit": "col"})

    @classmethod
    def build(cls, df: DataFrame, column: str, params: CMSParams, weight: str | None = None, by: tuple[str, ...] = (), turnstile: bool = False) -> CountMinSketch:
        """Null elements are passed over; a weight that is null or not positive raises, unless turnstile."""
        w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
        if weight is not None and not turnstile:
            w = F.when(w > 0, w).otherwise(F.raise_error(F.lit("weights must be positive")).cast("long"))
        c = element(column, dict(df.dtypes)[column])
        rows = cls(params, df, by)._cells(df.where(F.col(column).isNotNull()), c, w.alias("w"))
        return cls(params, rows.groupBy(*by, "row", "col").agg(F.sum("w").alias("cnt")), by)

    def update(self, df: DataFrame, column: str, weight: str | None = None) -> CountMinSketch:
        return self.merge(self.build(df, column, self.params, weight, self.by))

    def merge(self, other: CountMinSketch) -> CountMinSketch:
        if self.params != other.params:
            raise ValueError("sketches of other parameters can't be merged")
        both = self.state.unionByName(other.state)
        return CountMinSketch(self.params, both.groupBy(*self.by, "row", "col").agg(F.sum("cnt").alias("cnt")), self.by)

    def cells(self) -> DataFrame:
        """One row, one column: all counts, row after row."""
        n = self.params.rows * self.params.columns
        none = self.state.sparkSession.range(0, n, 1, 1).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("x"))
        held = self.state.select((F.col("row").cast("long") * self.params.columns + F.col("col")).alias("w"), F.col("cnt").alias("x"))
        rows = held.unionAll(none).groupBy("w").agg(F.sum("x").alias("x"))
        return rows.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]).alias("cells"))

    def estimate(self, keys: DataFrame, column: str, out: str = "estimate", packed_cells: int = PACKED_CELLS) -> DataFrame:
        """keys with the estimated weight of each element; null elements have 0.

        A sketch of up to packed_cells cells comes as one value to all tasks; a larger one, or one
        with groups, is joined by cell.
        """
        c = element(column, dict(keys.dtypes)[column])
        p, keys = self.params, keys.drop(out)
        if not self.by and p.rows * p.columns <= min(packed_cells, PACKED_CELLS):
            a, b = pair(c, p.columns, p.seed, p.spec)
            packed = self.cells().scalar()
            found = [F.get(packed, (e + i * p.columns).cast("int")) for i, e in enumerate(from_pair(F.col("__q_a"), F.col("__q_b"), p.columns, p.rows))]
            least = F.least(*found) if p.rows > 1 else found[0]
            return computed_once(keys, {"__q_a": a, "__q_b": b}).withColumn(out, F.coalesce(F.when(c.isNotNull(), least), F.lit(0).cast("long"))).drop("__q_a", "__q_b")
        keys = keys.withColumn("__q_e", c)
        cells = self._cells(keys.where("__q_e is not null").select(*self.by, "__q_e").distinct(), F.col("__q_e"), F.col("__q_e"))
        found = cells.join(self.state, [*self.by, "row", "col"], "left").groupBy(*self.by, "__q_e").agg(F.min(F.coalesce("cnt", F.lit(0))).alias(out))
        joined = keys.join(found, [*self.by, "__q_e"], "left")
        return joined.select(*[F.col(f"`{x}`") for x in keys.columns if x != "__q_e"], F.coalesce(out, F.lit(0)).cast("long").alias(out))

    def total(self) -> DataFrame:
        """(by, total): the sum of all weights."""
        return self.state.where("row = 0").groupBy(*self.by).agg(F.sum("cnt").alias("total"))

    def equals(self, other: CountMinSketch) -> bool:
        live = lambda s: s.where("cnt <> 0")
        return self.params == other.params and same_rows(live(self.state), live(other.state))

    def to_json(self) -> str:
        """Of an ungrouped sketch."""
        single(self.by)
        p = self.params
        matrix = [[0] * p.columns for _ in range(p.rows)]
        for r in self.state.toLocalIterator():
            matrix[r.row][r.col] = r.cnt
        return json.dumps({"type": "CountMinSketch", "_columns": p.columns, "_rows": p.rows, "_matrix": matrix, "_allSums": sum(matrix[0]), "_seed": seed_out(p.seed), "_hash": p.spec.name})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> CountMinSketch:
        x = json.loads(text)
        rows = [(i, j, c) for i, r in enumerate(x["_matrix"]) for j, c in enumerate(r) if c]
        return cls(CMSParams(x["_columns"], x["_rows"], seed_in(x["_seed"]), SPECS[x.get("_hash", "xxh64")]), spark.createDataFrame(rows, "row int, col long, cnt long"))


def native_cms(df: DataFrame, column: str, error: float, confidence: float, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sketch): Spark's own count-min aggregate, a compact binary for storage; it has no point query."""
    return df.groupBy(*by).agg(F.count_min_sketch(F.col(column), F.lit(error), F.lit(confidence), F.lit(seed)).alias("sketch"))


class TopK:
    """The k elements of most weight: value, frequency, rank. Ties go to the element whose last occurrence came first.

    State: (by, value, frequency, last): exact totals, a monoid; so adding, merging and streaming are
    union and sum. SketchedTopK keeps k rows and a sketch instead.
    """

    def __init__(self, k: int, state: DataFrame, by: tuple[str, ...] = ()):
        if k < 1:
            raise ValueError("k must be 1 at least")
        self.k, self.state, self.by = k, state, tuple(by)

    @classmethod
    def build(cls, df: DataFrame, column: str, order: str, k: int, weight: str | None = None, by: tuple[str, ...] = ()) -> TopK:
        w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
        w = w if weight is None else F.when(w > 0, w).otherwise(F.raise_error(F.lit("weights must be positive")).cast("long"))
        rows = df.where(F.col(column).isNotNull()).select(*by, element(column, dict(df.dtypes)[column]).alias("value"), w.alias("w"), F.col(order).alias("o"))
        return cls(k, rows.groupBy(*by, "value").agg(F.sum("w").alias("frequency"), F.max("o").alias("last")), by)

    @classmethod
    def from_sketch(cls, df: DataFrame, column: str, order: str, k: int, params: CMSParams, weight: str | None = None) -> SketchedTopK:
        """Ranked by the estimates of a count-min sketch."""
        return SketchedTopK.build(df, column, order, k, params, weight)

    def add(self, df: DataFrame, column: str, order: str, weight: str | None = None) -> TopK:
        return self.merge(TopK.build(df, column, order, self.k, weight, self.by))

    def merge(self, other: TopK) -> TopK:
        both = self.state.unionByName(other.state)
        return TopK(self.k, both.groupBy(*self.by, "value").agg(F.sum("frequency").alias("frequency"), F.max("last").alias("last")), self.by)

    def values(self) -> DataFrame:
        """(by, value, frequency, rank), ranks from 1. Only k rows a group are sorted together."""
        order = (F.desc("frequency"), F.asc("last"), F.asc("value"))
        rows = self.state if self.by else self.state.orderBy(*order).limit(self.k)
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*self.by).orderBy(*order)))
        return ranked.where(F.col("rank") <= self.k).select(*self.by, "value", "frequency", "rank")

    def iterator(self):
        return self.values().orderBy(*self.by, "rank").toLocalIterator()

    def clear(self) -> TopK:
        return TopK(self.k, self.state.limit(0), self.by)

    def equals(self, other: TopK) -> bool:
        return type(self) is type(other) and self.k == other.k and same_rows(self.state, other.state)

    def to_json(self) -> str:
        """All totals, so that what is read back can be added to; refuses groups, and more than EXPORTED elements."""
        single(self.by)
        rows = self.state.select("value", "frequency", F.col("last").cast("string").alias("last")).limit(EXPORTED + 1).collect()
        if len(rows) > EXPORTED:
            raise ValueError(f"over {EXPORTED} totals; use to_json_lines() or save()")
        return json.dumps({"type": "TopK", "_k": self.k, "_lastType": dict(self.state.dtypes)["last"], "_totals": [list(r) for r in rows]})

    def to_json_lines(self) -> DataFrame:
        """(value): all totals as JSON texts, each what to_json() gives of some of them; the first may be of none. Nothing is collected, so any number goes."""
        single(self.by)
        head = {"type": "TopK", "_k": self.k, "_lastType": dict(self.state.dtypes)["last"]}

        def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                last = (None if x is None or x != x else x for x in f["last"].tolist())
                totals = [list(r) for r in zip(f["value"].tolist(), f["frequency"].tolist(), last, strict=True)]
                yield pd.DataFrame({"value": [json.dumps(head | {"_totals": totals})]})

        rows = self.state.select("value", "frequency", F.col("last").cast("string").alias("last"))
        return self.state.sparkSession.createDataFrame([(json.dumps(head | {"_totals": []}),)], "value string").unionAll(rows.mapInPandas(lines, "value string"))

    @classmethod
    def from_json_lines(cls, texts: DataFrame) -> TopK:
        """What to_json_lines() of one top-k wrote, in any order."""

        def totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for text in f["value"]:
                    yield pd.DataFrame(json.loads(text)["_totals"], columns=["value", "frequency", "last"])

        head = json.loads(texts.first()[0])
        if head.get("type") != "TopK" or "_totals" not in head:
            raise ValueError("these are no lines of an exact top-k")
        held = texts.mapInPandas(totals, "value string, frequency long, last string")
        return TopK(head["_k"], held.withColumn("last", F.col("last").cast(head["_lastType"])))

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> TopK:
        """What to_json() of an exact or a sketched top-k wrote."""
        x = json.loads(text)
        held = lambda rows: spark.createDataFrame(rows, "value string, frequency long, last string").withColumn("last", F.col("last").cast(x["_lastType"]))
        if "_sketch" not in x:
            return TopK(x["_k"], held([tuple(r) for r in x["_totals"]]))
        sketch = CountMinSketch.from_json(spark, json.dumps(x["_sketch"]))
        return SketchedTopK(x["_k"], sketch, held([(e["value"], e["frequency"], e["last"]) for e in x["_heap"]["_content"]]))


class SketchedTopK(TopK):
    """Top-k of bounded state: a count-min sketch and the k elements of highest estimate, whatever the number of elements.

    Adding estimates the k elements and those of the batch anew; an element that was once pushed out
    comes back when it occurs again. State: (value, frequency, last), k rows at most.
    """

    def __init__(self, k: int, sketch: CountMinSketch, state: DataFrame):
        super().__init__(k, state)
        self.sketch = sketch

    @classmethod
    def build(cls, df: DataFrame, column: str, order: str, k: int, params: CMSParams, weight: str | None = None) -> SketchedTopK:
        """Ranked by the estimates of a count-min sketch. Null elements are passed over."""
        return cls._of(k, CountMinSketch.build(df, column, params, weight), cls._seen(df, column, order))

    @staticmethod
    def _seen(df: DataFrame, column: str, order: str) -> DataFrame:
        rows = df.where(F.col(column).isNotNull()).select(element(column, dict(df.dtypes)[column]).alias("value"), F.col(order).alias("o"))
        return rows.groupBy("value").agg(F.max("o").alias("last"))

    @classmethod
    def _of(cls, k: int, sketch: CountMinSketch, seen: DataFrame) -> SketchedTopK:
        best = sketch.estimate(seen, "value", "frequency").orderBy(F.desc("frequency"), F.asc("last"), F.asc("value")).limit(k)
        return cls(k, sketch, best.select("value", "frequency", "last"))

    def _with(self, sketch: CountMinSketch, seen: DataFrame) -> SketchedTopK:
        both = self.state.select("value", "last").unionByName(seen).groupBy("value").agg(F.max("last").alias("last"))
        return self._of(self.k, self.sketch.merge(sketch), both)

    def offer(self, df: DataFrame, column: str, order: str) -> SketchedTopK:
        """With the elements of df as candidates beside the k held, without adding any weight."""
        return self._with(CountMinSketch(self.sketch.params, self.sketch.state.limit(0)), self._seen(df, column, order))

    def add(self, df: DataFrame, column: str, order: str, weight: str | None = None) -> SketchedTopK:
        return self._with(CountMinSketch.build(df, column, self.sketch.params, weight), self._seen(df, column, order))

    def merge(self, other: SketchedTopK) -> SketchedTopK:
        return self._with(other.sketch, other.state.select("value", "last"))

    def clear(self) -> SketchedTopK:
        empty = CountMinSketch(self.sketch.params, self.sketch.state.limit(0))
        return SketchedTopK(self.k, empty, self.state.limit(0))

    def equals(self, other: TopK) -> bool:
        return super().equals(other) and self.sketch.equals(other.sketch)

    def heap(self) -> MinHeap:
        """The k elements in a heap on the driver."""
        heap = MinHeap()
        for r in self.values().orderBy(F.desc("rank")).collect():  # k rows at most
            heap.add({"value": r.value, "frequency": r.frequency})
        return heap

    def to_json(self) -> str:
        """Sketch and heap, lowest first."""
        p, last = self.sketch.params, {r.value: r.last for r in self.state.select("value", F.col("last").cast("string").alias("last")).collect()}
        content = [e | {"last": last[e["value"]]} for e in self.heap().content]
        body = {"_sketch": json.loads(self.sketch.to_json()), "_heap": {"_content": content}, "_lastType": dict(self.state.dtypes)["last"]}
        return json.dumps({"type": "TopK", "_k": self.k, "_columns": p.columns, "_rows": p.rows, "_seed": seed_out(p.seed), **body})


class MinHeap:
    """Elements {value, frequency} by rising frequency; a new one stands before those of its frequency."""

    def __init__(self, content: list[dict] | None = None):
        self.content = list(content or [])

    @property
    def length(self) -> int:
        return len(self.content)

    def get(self, i: int) -> dict | None:
        return self.content[i] if 0 <= i < len(self.content) else None

    def add(self, x: dict) -> None:
        self.content.insert(bisect_left(self.content, x["frequency"], key=lambda e: e["frequency"]), x)

    def remove(self, i: int) -> None:
        del self.content[i : i + 1]

    def pop_min(self) -> dict | None:
        return self.content.pop(0) if self.content else None

    def index_of(self, value: str) -> int:
        return next((i for i, e in enumerate(self.content) if e["value"] == value), -1)

    def clear(self) -> None:
        self.content = []

    def to_json(self) -> str:
        return json.dumps({"_content": self.content})

    @classmethod
    def from_json(cls, text: str) -> MinHeap:
        return cls(json.loads(text)["_content"])


def native_top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """(value, frequency) by Spark's approximate aggregate; ties come in no certain order."""
    return df.agg(F.expr(f"approx_top_k(`{column}`, {int(k)})").alias("t")).select(F.explode("t").alias("t")).select(F.col("t.item").alias("value"), F.col("t.count").alias("frequency"))
