"""Classes of documents of equal shingle sets, and how many other classes each is alike: all pairs of similarity 0.8 or more.

Candidates come from prefix filtering alone (see jaccard.py), which loses no pair: short runs of a
shingle give all their pairs, long ones are compared in cells of two blocks, and counts of shingles by
hash leave what can be alike. What these pairs connect is decided by the texts, in such cells too.
Only prefixes and the texts of candidates are dealt out, so no table of all shingles is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import settle, tidy
from quarry.llm.components import components
from quarry.llm.jaccard import LONG, OFTEN, PAIR, _short_runs, alike, common_shingles, prefix
from quarry.llm.shingles import U64, shingle_hashes

#: Sets of a shingle that are paired at once; sets of a block; shingles that a cell takes as columns at once. They change the work, never the result.
SHORT, BLOCK, COLUMNS = 8, 1024, 2048
#: Sets of a block of a long run.
RUN = 8192
#: Counts of shingles by hash that a set has in its profile.
COUNTS = 128
#: Counts that decide, in a cell, what COUNTS leave: long texts of one size are near equal in 128 counts.
FINE = 1 << 13
#: Cells of a matrix that are made in the time of one shingle compared pair by pair. It changes the work, never the result.
STEP = 500
#: What a text without words has for its one shingle.
NO_WORDS = np.array([xxhash.xxh64_intdigest(b"", 42)], U64)


def set_of(texts: list[str], words: int) -> np.ndarray:
    """The different shingles of the rows of one document, in order."""
    found = [shingle_hashes(t, words) for t in texts]
    return np.unique(np.concatenate([x if len(x) else NO_WORDS for x in found]))


def profile(s: np.ndarray) -> bytes:
    """How many of its shingles fall to each of COUNTS hash values, in as few bytes a count as hold them."""
    c = np.bincount((s % U64(COUNTS)).astype(np.int64), minlength=COUNTS)
    return c.astype("<u1" if c.max() < 1 << 8 else "<u4").tobytes()


def most_shared(p: bytes, q: bytes) -> int:
    """The most shingles that sets of two profiles can share."""
    a, b = (np.frombuffer(x, f"<u{len(x) // COUNTS}") for x in (p, q))
    return int(np.minimum(a, b).sum(dtype=np.int64))


def whole_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, t), t being the texts of all rows of an id."""
    text = F.coalesce("text", F.lit(""))
    many = settle(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    one = docs.select("doc_id", F.array(text).alias("t"))
    if many.isEmpty():
        return one
    more = docs.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(text).alias("t"))
    return one.join(many, "doc_id", "left_anti").unionAll(more)


def set_prefixes(docs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(doc_id, name, n, profile, first, often): 128 bits of hash that name the set, its size, profile and prefix, and which of it many sets hold."""
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words, "text"))  # a bounded number of longs

    def one(t: list[str]) -> tuple:
        common, count = sent.value
        s = set_of(t, words)
        known = np.zeros(len(s), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, s), len(common) - 1)
            known = np.where(common[at] == s, count[at], 0)
        first = np.argsort(known, kind="stable")[: prefix(len(s))]
        return xxhash.xxh3_128_digest(s.tobytes()), len(s), profile(s), s[first].view(np.int64), known[first] > OFTEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [one(x.as_py()) for x in b.column(1)]
            new = (pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()))))
            yield pa.RecordBatch.from_arrays([b.column(0), *new], names=["doc_id", "name", "n", "profile", "first", "often"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(tidy(run), f"doc_id {kind}, name binary, n long, profile binary, first array<long>, often array<boolean>")


def _linked(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """Which sets of p are alike which of q, as a matrix."""
    x, y = np.concatenate(p), np.concatenate(q)
    both = np.intersect1d(x, y)
    shared = np.zeros((len(p), len(q)), np.float32)  # exact below 2^24

    def places(x: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, x), max(0, len(both) - 1))
        ok = both[at] == x if len(both) else np.zeros(len(x), bool)
        at, row = at[ok], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok]
        order = np.argsort(at, kind="stable")
        return at[order], row[order]

    sides = [(*places(x, p), len(p)), (*places(y, q), len(q))]
    for lo in range(0, len(both), COLUMNS):
        m = []
        for at, row, k in sides:
            a, b = np.searchsorted(at, [lo, lo + COLUMNS])
            one = np.zeros((k, min(COLUMNS, len(both) - lo)), np.float32)
            one[row[a:b], at[a:b] - lo] = 1
            m.append(one)
        shared += m[0] @ m[1].T
    sizes = [np.array([len(s) for s in side], np.int64) for side in (p, q)]
    return alike(shared.astype(np.int64), sizes[0][:, None], sizes[1][None, :])


def _may_link(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """Which sets of p can be alike which of q by sizes and counts of shingles by hash, as a matrix."""
    counts = lambda side, k: np.stack([np.bincount((s % U64(k)).astype(np.int64), minlength=k).astype(np.int32) for s in side])
    n, m = (np.array([len(s) for s in side], np.int64) for side in (p, q))
    a, b = (counts(side, COUNTS) for side in (p, q))
    yes = np.stack([alike(np.minimum(x, b).sum(1, dtype=np.int64), k, m) for x, k in zip(a, n, strict=True)])
    i, j = np.flatnonzero(yes.any(1)), np.flatnonzero(yes.any(0))
    if len(i):
        a, b = (counts([side[k] for k in some], FINE) for side, some in ((p, i), (q, j)))
        for x, k in zip(a, i, strict=True):
            at = np.flatnonzero(yes[k, j])
            yes[k, j[at]] = alike(np.minimum(x, b[at]).sum(1, dtype=np.int64), n[k], m[j[at]])
    return yes


def links_between(p: list[np.ndarray], q: list[np.ndarray]) -> np.ndarray:
    """Which sets of p are alike which of q, as a matrix. What sizes and counts allow is decided pair by pair, or by a matrix where that is less work."""
    yes = _may_link(p, q)
    u, v = np.nonzero(yes)
    if not len(u):
        return yes
    i, j = np.unique(u), np.unique(v)
    some = [p[k] for k in i], [q[k] for k in j]
    sizes = [np.array([len(s) for s in side], np.int64) for side in (p, q)]
    if STEP * int((sizes[0][u] + sizes[1][v]).sum()) < len(i) * len(j) * len(np.intersect1d(*map(np.concatenate, some))):
        shared = np.array([len(np.intersect1d(p[k], q[o], assume_unique=True)) for k, o in zip(u, v, strict=True)], np.int64)
        yes[u, v] = alike(shared, sizes[0][u], sizes[1][v])
    else:
        yes[np.ix_(i, j)] = _linked(*some)
    return yes


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose sizes and profiles allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, p, q = (b.column(i).to_pylist() for i in range(2, 6))
            ok = [alike(most_shared(p[i], q[i]), n[i], m[i]) for i in range(len(n))]
            yield b.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    ends = [nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("profile").alias(f"p{c}")) for c in "uv"]
    both = pairs.join(ends[0].hint("merge"), "u").join(ends[1].hint("merge"), "v")
    return both.select("u", "v", "nu", "nv", "pu", "pv").mapInArrow(tidy(run), "u long, v long")


def _cells(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(node, key, b, i, j): the nodes of each key in blocks b of some `size`, and the cells (i, j) of two blocks that they belong to."""
    sizes = settle(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rows.join(sizes, key).withColumns({"b": mine, "o": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    return placed.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o", "blocks")


def _possible_in_runs(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): the pairs of nodes of one long run (x, node) whose sizes and profiles allow a link."""

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        i, j = (k.as_py() for k in key[1:])
        node, n, b = (table.column(c).to_numpy() for c in ("node", "n", "b"))
        m = np.stack([np.frombuffer(x, f"<u{len(x) // COUNTS}").astype(np.int32) for x in table.column("profile").to_pylist()])
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, end in enumerate(np.searchsorted(n, 5 * n // 4, "right").tolist()):  # larger sets can't be alike
            q = np.arange(a + 1, end)
            if i != j:
                q = q[b[q] != b[a]]
            q = q[alike(np.minimum(m[a], m[q]).sum(1), n[a], n[q])]
            u.append(np.maximum(node[a], node[q]))
            v.append(np.minimum(node[a], node[q]))
        return pa.table({"u": np.concatenate(u), "v": np.concatenate(v)})

    rows = runs.join(nodes.select("node", "n", "profile").hint("merge"), "node")
    return _cells(rows, "x", RUN).groupBy("x", "i", "j").applyInArrow(cell, "u long, v long")


def _links_of_labels(labels: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, k): links of each node (node, label) with the others of its label. A label is cut into blocks of some BLOCK sets; a task holds a cell of two."""
    cells = _cells(labels, "label", BLOCK)

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        _, i, j = (k.as_py() for k in key)
        node, b = table.column("node").to_numpy(), table.column("b").to_numpy()
        sets = [set_of(t.as_py(), words) for t in table.column("t")]
        p, q = (np.flatnonzero(b == k) for k in (i, j))
        count = np.zeros(len(node), np.int64)
        if len(p) and len(q):
            yes = links_between([sets[k] for k in p], [sets[k] for k in q])
            if i == j:
                np.fill_diagonal(yes, False)
                count[p] = yes.sum(1)
            else:
                count[p], count[q] = yes.sum(1), yes.sum(0)
        return pa.table({"node": node, "k": count})

    parts = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # Spark would join cells of few bytes, but much work, into few tasks
    return cells.join(texts.hint("merge"), "node").repartition(parts, "label", "i", "j").groupBy("label", "i", "j").applyInArrow(cell, "node long, k long")


def near_links(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, class_id, n_links), one row an id. A class is the documents of one set, named by its least id; links are the other classes
    whose sets have a Jaccard similarity of 0.8 or more.

    The rows of an id are one document; a text without words has the empty shingle.
    """
    texts = whole_texts(docs.select("doc_id", "text"))
    prints = settle(set_prefixes(docs, texts, words))
    some = lambda c: F.first(c).alias(c)  # noqa: E731  (equal for equal names)
    nodes = settle(prints.groupBy("name").agg(F.min("doc_id").alias("class_id"), some("n"), some("profile"), some("first"), some("often")).withColumn("node", F.col("class_id").cast("long")))
    rows = nodes.select("node", "n", F.posexplode(F.arrays_zip("first", "often")).alias("at", "e")).select(F.col("e.first").alias("x"), "node", "n", F.col("at").cast("long").alias("at"), F.col("e.often").alias("often"))
    found = settle(_short_runs(rows.where("not often").drop("often"), SHORT))
    long_runs = settle(rows.where("often").select("x", "node").unionAll(found.where(F.col("kind") == LONG).select(F.col("u").alias("x"), F.col("v").alias("node"))))
    pairs = settle(_possible(settle(found.where(F.col("kind") == PAIR).select("u", "v").distinct()), nodes))
    pairs = settle(pairs.unionAll(_possible_in_runs(long_runs, nodes)).distinct())
    labels = settle(components(pairs).select("node", F.col("least").alias("label")))
    held = settle(texts.withColumn("node", F.col("doc_id").cast("long")).join(labels.select("node"), "node", "left_semi").select("node", "t"))
    counts = settle(_links_of_labels(labels, held, words).groupBy("node").agg(F.sum("k").alias("k")))
    members = prints.select("doc_id", "name").join(nodes.select("name", "class_id", "node"), "name").join(counts, "node", "left")
    return members.select("doc_id", "class_id", F.coalesce("k", F.lit(0)).cast("long").alias("n_links"))
