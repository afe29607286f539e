"""Near-duplicate documents by SimHash, with pigeonring filtering of candidates.

A fingerprint of 64 bits is a ring of radius + 1 segments. If two fingerprints differ in at most
radius bits, then some segment starts a chain of consecutive segments whose first l segments
differ in at most l * radius / (radius + 1) bits together, for every l. So the first segment is
equal, the next has one difference at most (and one equal half), the next two have two at most
(and two equal quarters of their bits), and so on. Fingerprints are gathered by these equal parts,
candidates checked along the chain, and only what is left by the full Hamming distance. How many
segments make a key follows from the number of fingerprints, so that runs of a key stay short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import settle, tidy
from quarry.llm.components import components
from quarry.llm.jaccard import near_sets
from quarry.llm.shingles import U64, shingle_hashes

#: Shingles whose bits are counted at a time; runs up to SHIFTS fingerprints are compared by shifting.
BLOCK, SHIFTS, GATHER = 1 << 16, 32, 1 << 17
#: Fingerprints under one key above which they are dealt again by longer chains.
LONG_RUN = 4096
LINK, LONG = 0, 1


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """A bit is set if it is in over half the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for lo in range(0, len(bits), 255):
            count += np.add.reduce(bits[lo : lo + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes), bitorder="little").view(U64)[0]


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, f0), one row a document."""
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("f0", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(shingle_hashes(x.as_py(), words)) for x in b.column(1)], U64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], names=["id", "f0"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(tidy(run), T.StructType(fields))


class Ring:
    """Segments, keys and chain budgets for words of 64 bits and a radius."""

    def __init__(self, radius: int, chain: int):
        self.radius, self.m = radius, radius + 1
        at = [j * 64 // self.m for j in range(self.m + 1)]
        self.turn = np.array(at[:-1], U64)
        widths = [b - a for a, b in zip(at, at[1:], strict=False)]
        top = lambda n: U64((((1 << n) - 1) << (64 - n)) & (2**64 - 1))
        #: masks[i][l - 1]: the first l segments of the chain from segment i, turned to the top
        self.masks = np.array([[top(sum(widths[(i + j) % self.m] for j in range(n + 1))) for n in range(self.m)] for i in range(self.m)], U64)
        #: per start: masks of the parts that make a key
        self.keys: list[tuple[int, np.uint64]] = []
        for i in range(self.m):
            w = [widths[(i + j) % self.m] for j in range(chain)]
            parts, bits, begin = 2 * (chain - 1), sum(w[1:]), w[0]
            edges = [begin + bits * j // parts for j in range(parts + 1)] if parts else []
            span = [U64(int(top(b)) ^ int(top(a))) for a, b in zip(edges, edges[1:], strict=False)]
            # chain - 1 differences at most in these parts: as many parts at least are equal
            for equal in combinations(range(parts), parts - (chain - 1)):
                self.keys.append((i, U64(int(top(w[0])) | sum(int(span[j]) for j in equal))))

    @property
    def key_bits(self) -> int:
        """Bits of the shortest key."""
        return min(int(mask).bit_count() for _, mask in self.keys)

    def turned(self, x: np.ndarray, i: np.ndarray | int) -> np.ndarray:
        t = self.turn[i]
        return (x << t) | np.where(t > 0, x >> ((U64(64) - t) & U64(63)), U64(0)) if np.ndim(t) or t else x

    def holds(self, x: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the differences x keep the chain's budgets from segment i on; the whole ring is the Hamming check."""
        ok = np.arange(len(x))
        y = self.turned(x, i)
        for n in range(self.m):
            ok = ok[np.bitwise_count(y[ok] & self.masks[i[ok], n]) <= (n + 1) * self.radius // self.m]
        return ok


def chain_for(n: int, radius: int) -> int:
    """The least number of segments whose keys have about as many bits as n fingerprints need to lie apart; keys of two segments at least."""
    chain = min(2, radius + 1)
    while chain < radius + 1 and n > 4 << Ring(radius, chain).key_bits:
        chain += 1
    return chain


def _join_runs(key: np.ndarray, f: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) inside runs of equal keys; key's top 16 bits name the key's number.

    In each run enough links are found to connect all that are linked in it. A link between two that
    share an earlier key's run is left to that run: as all its links are connected there, by
    induction nothing falls apart, and a link comes out once instead of once a key.
    """
    tag = (key >> U64(48)).astype(np.int64)
    start = np.array([i for i, _ in ring.keys])[tag]
    links = []

    def check(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ring.holds(f[a] ^ f[b], start[a])

    def once(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without the pairs that an earlier key finds too: its run connects them."""
        for t in range(int(tag[a].max(initial=0))):
            i, mask = ring.keys[t]
            x = f[a] ^ f[b]
            met = np.zeros(len(a), bool)
            maybe = np.flatnonzero((ring.turned(x, i) & mask == 0) & (tag[a] > t))
            met[maybe[ring.holds(x[maybe], np.full(len(maybe), i))]] = True
            a, b = a[~met], b[~met]
            if not len(a):
                break
        return a, b

    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    length = np.diff(edge)
    small = np.repeat(length <= SHIFTS, length)
    for d in range(1, min(SHIFTS, int(length.max(initial=0)))):
        a = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if len(a):
            ok = check(a, a + d)
            links.append((a[ok], a[ok] + d))
    for r in np.flatnonzero(length > SHIFTS):  # search from one to the next: what is reached isn't compared again
        left = np.arange(edge[r], edge[r + 1])
        while len(left):
            todo, left = [left[0]], left[1:]
            while todo and len(left):
                a = todo.pop()
                ok = check(np.full(len(left), a), left)
                if len(ok):
                    links.append((np.full(len(ok), a), left[ok]))
                    todo += left[ok].tolist()
                    left = np.delete(left, ok)
    none = np.zeros(0, np.int64)
    return once(*(np.concatenate(x) for x in zip(*links, strict=True))) if links else (none, none)


def _in_runs(distinct: DataFrame, radius: int, chain: int, most: int) -> DataFrame:
    """(kind, u, v): links of the fingerprints f0 that share a key, and as LONG rows (f0, f0) those of runs of over `most`."""
    ring = Ring(radius, chain)
    keyed = T.StructType([T.StructField("key", T.LongType()), T.StructField("f0", T.LongType())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = b.column(0).to_numpy().view(U64)
            for k, (i, mask) in enumerate(ring.keys):
                # the mixed parts fit 48 bits with a negligible chance of meeting; a meeting only adds a candidate
                key = (_mix(ring.turned(f, i) & mask) >> U64(16)) | (U64(k) << U64(48))
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (key, f)], names=keyed.names)

    def batch(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["kind", "u", "v"])

    def out(key: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
        length = np.repeat(np.diff(edge), np.diff(edge))
        if (length > most).any():
            yield batch(LONG, f[length > most], f[length > most])
            key, f = key[length <= most], f[length <= most]
        a, b = _join_runs(key, f, ring)
        if len(a):
            yield batch(LINK, np.maximum(f[a], f[b]), np.minimum(f[a], f[b]))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n, passing = [], 0, None
        for b in batches:
            key, f = (c.to_numpy().view(U64) for c in b.columns)
            if passing is not None:  # the rest of a long run goes through without being held
                same = key == passing
                if same.any():
                    yield batch(LONG, f[same], f[same])
                    key, f = key[~same], f[~same]
                passing = passing if not len(key) else None
            gathered.append((key, f))
            n += len(key)
            if n >= GATHER:
                key, f = (np.concatenate(x) for x in zip(*gathered, strict=True))
                last = int(np.searchsorted(key.view(np.int64), key.view(np.int64)[-1]))  # the last run may go on
                yield from out(key[:last], f[:last])
                key, f = key[last:], f[last:]
                if len(key) > most:
                    passing = key[0]
                    yield batch(LONG, f, f)
                    key, f = key[:0], f[:0]
                gathered, n = [(key, f)], len(key)
        if gathered:
            yield from out(*(np.concatenate(x) for x in zip(*gathered, strict=True)))

    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.select("f0").mapInArrow(tidy(spread), keyed).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(links), "kind int, u long, v long").distinct()


def link_fingerprints(distinct: DataFrame, radius: int, chain: int | None = None, most: int = LONG_RUN) -> DataFrame:
    """Edges (u, v) between different fingerprints f0, enough to connect all that differ in radius bits or fewer.

    What lies in runs of over `most` is dealt again by the keys of one more segment, until the chain
    goes round the ring; only there a longer run is searched as it is, in one task.
    """
    chain = chain or chain_for(distinct.count(), radius)
    links = None
    while True:
        last = chain == radius + 1
        found = settle(_in_runs(distinct, radius, chain, 2**62 if last else most))
        now = found.where(F.col("kind") == LINK).select("u", "v")
        links = now if links is None else links.unionAll(now)
        distinct = found.where(F.col("kind") == LONG).select(F.col("u").alias("f0")).distinct()
        if last or distinct.isEmpty():
            return links
        chain += 1


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, chain: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, component, component_id), one row a document.

    component names the group, component_id is the least id that links reach.

    Whole texts are taken, A-Z lower-cased and split at ASCII white space; a text of fewer words
    than a shingle is one shingle, a null, empty or blank text has fingerprint zero. Two documents
    are linked if their fingerprints differ in radius bits or fewer. Equal fingerprints are one
    node, so copies make no pairs. A group whose ids are all null has a null component_id.
    """
    prints = settle(fingerprints(docs, words, id_col, text_col))
    distinct = settle(prints.groupBy("f0").agg(F.min("id").alias("least_id")))
    reach = settle(components(link_fingerprints(distinct, radius, chain)))
    linked = settle(distinct.join(reach.withColumnRenamed("node", "f0"), "f0", "left").select("f0", "least_id", F.coalesce("least", "f0").alias("least")))
    ids = settle(linked.groupBy("least").agg(F.min("least_id").alias("component_id")))
    named = settle(linked.join(ids, "least").select("f0", F.col("least").alias("component"), "component_id"))
    return prints.join(named, "f0").select("id", "f0", "component", "component_id")


def keep_one(docs: DataFrame, words: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of near duplicates, the one of the smallest id.

    Near duplicates share 0.8 or more of their sets of shingles (exact Jaccard similarity): SimHash
    fingerprints within radius bits are candidates, near_sets() adds those that fingerprints miss
    and decides every one by the sets. No other pair links.
    Rows that repeat both id and text are one document, of which one row stays; of a group whose
    smallest id is borne by several texts the one of the smallest digest stays, null ids come first
    (a null id and the least long are one id).
    """
    key, digest = "__q_id", "__q_text"
    low = F.lit(-(2**63))
    named = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), low), digest: F.coalesce(F.unhex(F.sha2(text_col, 256)), F.lit(b""))})
    found = settle(near_sets(named.select(key, digest, text_col), fingerprint, lambda prints: link_fingerprints(prints, radius), words, [key, digest], text_col))
    stay = settle(found.groupBy("component").agg(F.min(F.struct(key, digest)).alias("s")).select(f"s.{key}", f"s.{digest}"))
    out = named.join(stay.hint("merge"), [key, digest])
    if not found.groupBy(key, digest).count().where("count > 1").isEmpty():
        out = out.dropDuplicates([key, digest])
    return out.select(*[f"`{c}`" for c in docs.columns])
