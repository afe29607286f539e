"""Groups of documents whose shingle sets have a Jaccard similarity of 0.8 or more, found completely.

Candidates come from SimHash fingerprints first, then from prefix filtering, which completes them:
with the shingles of every set in one global order, two sets of similarity t share one of the first
n - ceil(t n) + 1 shingles of each. Any order will do; here shingles that a sample of the documents
holds often come last, so that common passages seldom make candidates. Each candidate is decided by
its two whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import settle, tidy
from quarry.llm.components import components
from quarry.llm.shingles import U64, shingle_set

#: One in SAMPLED documents tells which shingles are common, of which COMMON at most are put last, and which are held by many (over OFTEN of the sample); this changes the work, never the result.
SAMPLED, COMMON, OFTEN = 16, 1 << 17, 8
#: Sets of a shingle that are paired in full at once; sets of a longer run that are compared in one cell; rows that a task gathers.
ALL, CELL, GATHER = 32, 1024, 1 << 17


def alike(shared, n, m):
    """Whether sets of n and m shingles, so many shared, have a similarity of 0.8 or more."""
    return 9 * shared >= 4 * (n + m)


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1 if n else 0


def _may(n: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether two sets can be alike if this shingle, at place `at` and `to` of each, is the first that they share."""
    return alike(np.minimum(n - at, m - to), n, m)


def common_shingles(docs: DataFrame, words: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, how often the sample holds them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(x.as_py(), words) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U64), *found]).view(np.int64))], names=["x"])

    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLED)) == 0).select(text_col)
    got = some.mapInArrow(tidy(run), "x long").groupBy("x").count().where("count > 2").orderBy(F.desc("count"), "x").limit(COMMON).toArrow()
    x, count = got.column("x").to_numpy().view(U64), got.column("count").to_numpy()
    order = np.argsort(x)
    return x[order], count[order]


def prefixes(docs: DataFrame, fingerprint: Callable[[np.ndarray], np.uint64], words: int, keys: list[str], text_col: str) -> DataFrame:
    """(keys, name, n, f0, first, often), one row a document: 128 bits of hash that name the set, its size, fingerprint and prefix, and which of it many sets hold."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words, text_col))  # COMMON pairs of longs at most
    fields = [*(docs.schema[k] for k in keys), T.StructField("name", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("f0", T.LongType())]
    fields += [T.StructField("first", T.ArrayType(T.LongType())), T.StructField("often", T.ArrayType(T.BooleanType()))]

    def one(text: str | None) -> tuple:
        common, count = sent.value
        s = shingle_set(text, words)
        known = np.zeros(len(s), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            known = np.where(common[at] == s, count[at], 0)
        first = np.argsort(known, kind="stable")[: prefix(len(s))]
        return xxhash.xxh3_128_digest(s.tobytes()), len(s), fingerprint(s).astype(np.int64), s[first].view(np.int64), known[first] > OFTEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(x.as_py()) for x in b.column(len(keys))]
            new = (pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()))))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *new], names=[f.name for f in fields])

    return docs.select(*keys, text_col).mapInArrow(tidy(run), T.StructType(fields))


def _held_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs that agree in the first n_keys columns, from sorted batches, GATHER rows or more at a time."""
    gathered, n = [], 0
    for b in batches:
        gathered.append([c.to_numpy() for c in b.columns])
        n += b.num_rows
        if n >= GATHER:
            cols = [np.concatenate(c) for c in zip(*gathered, strict=True)]
            same = np.logical_and.reduce([c == c[-1] for c in cols[:n_keys]])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last run may go on
            if last:
                yield [c[:last] for c in cols]
            gathered = [[c[last:] for c in cols]]
            n = 0 if last < n // 2 else len(gathered[0][0])
    if n or gathered:
        yield [np.concatenate(c) for c in zip(*gathered, strict=True)]


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    new = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(np.concatenate([[True], new, [True]])) if len(keys[0]) else np.zeros(1, np.int64)


PAIR, LONG = 0, 1


def _short_runs(rows: DataFrame, most: int = ALL) -> DataFrame:
    """(kind, u, v, n, at): the candidate pairs (u, v) of runs of up to `most` rows (x, node, n, at) of one x, and the rows (x, node) of longer ones."""

    def batch(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(c) for c in cols)], names=["kind", "u", "v", "n", "at"])

    def pairs(x: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = _edges(x)
        length = np.repeat(np.diff(edge), np.diff(edge))
        if (length > most).any():
            k = length > most
            yield batch(LONG, x[k], node[k], n[k], at[k])
            x, node, n, at = (c[~k] for c in (x, node, n, at))
        for d in range(1, min(most, int(length.max(initial=0)))):
            a = np.flatnonzero(x[d:] == x[:-d])
            a = a[_may(n[a], at[a], n[a + d], at[a + d])]
            if len(a):
                zero = np.zeros(len(a), np.int64)
                yield batch(PAIR, np.maximum(node[a], node[a + d]), np.minimum(node[a], node[a + d]), zero, zero)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, gathered, n = None, [], 0
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if passing is not None:  # the rest of a long run goes through without being held
                same = cols[0] == passing
                if same.any():
                    yield batch(LONG, *(c[same] for c in cols))
                    cols = [c[~same] for c in cols]
                passing = passing if not len(cols[0]) else None
            gathered.append(cols)
            n += len(cols[0])
            if n >= GATHER:
                cols = [np.concatenate(c) for c in zip(*gathered, strict=True)]
                last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on
                yield from pairs(*(c[:last] for c in cols))
                cols = [c[last:] for c in cols]
                if len(cols[0]) > most:
                    passing = cols[0][0]
                    yield batch(LONG, *cols)
                    cols = [c[:0] for c in cols]
                gathered, n = [cols], len(cols[0])
        if gathered:
            yield from pairs(*(np.concatenate(c) for c in zip(*gathered, strict=True)))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "x").sortWithinPartitions("x").mapInArrow(tidy(run), "kind int, u long, v long, n long, at long")


def _with_pivots(rows: DataFrame) -> DataFrame:
    """(u, v): each set of a long run with two of its sets, the one with fewest rare shingles and one at random. Joined by x, so that Spark can split a hot one."""
    one = F.min(F.struct("at", "n", "node"))
    other = F.min(F.struct(F.xxhash64("node").alias("h"), "at", "n", "node"))
    pivots = settle(rows.groupBy("x").agg(one.alias("p"), other.alias("q")).select("x", F.explode(F.array("p", F.struct("q.at", "q.n", "q.node"))).alias("p")))
    both = rows.join(pivots.hint("merge"), "x").where(F.col("node") != F.col("p.node"))
    may = alike(F.least(F.col("n") - F.col("at"), F.col("p.n") - F.col("p.at")), F.col("n"), F.col("p.n"))
    return both.where(may).select(F.greatest("node", "p.node").alias("u"), F.least("node", "p.node").alias("v"))


def _across_labels(rows: DataFrame) -> DataFrame:
    """(u, v): the candidate pairs of different labels in runs of one x, from rows (x, node, n, at, label).

    All that is not in a run's largest label is compared with the run's other labels. A run is cut
    into blocks of some CELL sets and these into cells of two blocks, so a task holds a cell at a time.
    """
    sizes = settle(rows.groupBy("x", "label").agg(F.count(F.lit(1)).alias("c")))
    runs = sizes.groupBy("x").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    blocks = lambda c: F.ceil(c / CELL).cast("int")
    runs = runs.select("x", F.col("main.label").alias("main"), blocks(F.col("total")).alias("all"), blocks(F.col("total") - F.col("main.c")).alias("few"))
    rows = rows.join(settle(runs).hint("merge"), "x").withColumn("minor", F.col("label") != F.col("main"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    at = lambda salt, n: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    asked = rows.where("minor").withColumn("j", at(1, F.col("few"))).withColumn("i", F.explode(every(F.col("all")))).withColumn("asks", F.lit(1))
    given = rows.withColumn("i", at(2, F.col("all"))).withColumn("j", F.explode(every(F.col("few")))).withColumn("asks", F.lit(0))
    names = ["x", "i", "j", "asks", "node", "n", "at", "label", "minor"]
    cells = asked.select(*names).unionAll(given.select(*names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, i, j, asks, node, n, to, label, minor in _held_runs((b.set_column(8, "minor", b.column(8).cast(pa.int8())) for b in batches), 3):
            edge = _edges(x, i, j)
            for s, e in zip(edge, edge[1:], strict=False):
                a, b = (np.flatnonzero(asks[s:e] == k) + s for k in (1, 0))
                for lo in range(0, len(a), CELL):
                    p, q = np.broadcast_arrays(a[lo : lo + CELL, None], b[None, :])
                    ok = (label[p] != label[q]) & ((minor[q] == 0) | (node[q] < node[p]))
                    p, q = p[ok], q[ok]
                    ok = _may(n[p], to[p], n[q], to[q])
                    if ok.any():
                        p, q = node[p[ok]], node[q[ok]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.maximum(p, q)), pa.array(np.minimum(p, q))], names=["u", "v"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "x", "i", "j").sortWithinPartitions("x", "i", "j").mapInArrow(tidy(run), "u long, v long")


def _alike_pairs(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose sets are alike, decided by the whole texts (node, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[int, np.ndarray] = {}
            ok = []
            for u, v, a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                for k, t in ((u, a), (v, c)):
                    if k not in sets:
                        sets[k] = shingle_set(t.as_py(), words)
                p, q = sets[u], sets[v]
                ok.append(bool(alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    first, second = texts.select(F.col("node").alias("u"), F.col("t").alias("tu")), texts.select(F.col("node").alias("v"), F.col("t").alias("tv"))
    return pairs.join(first.hint("merge"), "u").join(second.hint("merge"), "v").select("u", "v", "tu", "tv").mapInArrow(tidy(run), "u long, v long")


def near_sets(docs: DataFrame, fingerprint: Callable[[np.ndarray], np.uint64], close: Callable[[DataFrame], DataFrame], words: int, keys: list[str], text_col: str) -> DataFrame:
    """(keys, component), one row a document: component names its group. keys tell documents of different texts apart.

    Documents are linked if the sets of their shingles have a Jaccard similarity of 0.8 or more,
    and a group is what links connect. Whole texts are taken as in shingle_hashes(); texts without
    words are one group, equal sets are one node, so that copies make no pairs.

    close() gives pairs (u, v) of near fingerprints f0, the first candidates. No other pair is
    passed over: short runs of a shingle give all their pairs; of long ones, dealt by join, every
    set is compared with two pivots, and then what links don't connect yet with the rest.
    """
    prints = settle(prefixes(docs, fingerprint, words, keys, text_col))
    some = lambda c: F.first(c).alias(c)  # noqa: E731  (equal for equal names)
    nodes = settle(prints.groupBy("name").agg(some("n"), some("f0"), some("first"), some("often"), F.min(F.struct(*keys)).alias("least")).withColumn("node", F.monotonically_increasing_id()))
    rows = nodes.select("node", "n", F.posexplode(F.arrays_zip("first", "often")).alias("at", "e")).select(F.col("e.first").alias("x"), "node", "n", F.col("at").cast("long").alias("at"), F.col("e.often").alias("often"))
    found = settle(_short_runs(rows.where("not often").drop("often")))
    long_runs = settle(rows.where("often").select("x", "node", "n", "at").unionAll(found.where(F.col("kind") == LONG).select(F.col("u").alias("x"), F.col("v").alias("node"), "n", "at")))
    by_print = settle(nodes.groupBy("f0").agg(F.min("node").alias("node")))
    same = nodes.join(by_print.withColumnRenamed("node", "v"), "f0").where("node <> v").select(F.col("node").alias("u"), "v")
    ends = [by_print.select(F.col("f0").alias(c), F.col("node").alias(f"n{c}")) for c in "uv"]
    near = settle(close(by_print.select("f0")).join(ends[0], "u").join(ends[1], "v").select(F.greatest("nu", "nv").alias("u"), F.least("nu", "nv").alias("v")))

    def decide(pairs: DataFrame) -> DataFrame:
        pairs = settle(pairs.distinct())
        need = settle(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "least.*"), "node"))
        texts = settle(docs.select(*keys, F.col(text_col).alias("t")).join(need.hint("merge"), keys).select("node", "t").dropDuplicates(["node"]))
        return settle(_alike_pairs(pairs, texts, words))

    first = found.where(F.col("kind") == PAIR).select("u", "v")
    links = decide(near.unionAll(same).unionAll(first).unionAll(_with_pivots(long_runs)))
    reach = settle(components(links))
    if not long_runs.isEmpty():
        labelled = settle(long_runs.join(reach, "node", "left").select("x", "node", "n", "at", F.coalesce("least", "node").alias("label")))
        links = links.unionAll(decide(_across_labels(labelled)))
        reach = settle(components(links))
    named = settle(nodes.select("name", "node").join(reach, "node", "left").select("name", F.coalesce("least", "node").alias("component")))
    return prints.select(*keys, "name").join(named, "name").select(*keys, "component")
