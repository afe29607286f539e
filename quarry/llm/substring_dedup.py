"""Exact substring deduplication: remove bytes inside windows that stand earlier in the corpus.

All byte positions whose next `window` bytes stay in their document are suffixes to be ordered, but
only through their first `window` bytes. A most-significant-digit radix sort does this in passes:

1. Of every window one anchor, the 32-byte string of least hash in it, is the first digit. Anchors
   depend on the window's bytes alone, so equal windows share theirs. The distributed pass deals the
   anchors by digit; digits that occur once end here, with all their windows.
2. For the digits left, the windows around each anchor come as one context of bytes, dealt by the
   digit. Equal contexts are told at once. The windows of the contexts that differ go through the
   remaining passes: groups are split by the next quarter of the window's bytes, and groups of one
   are dropped after each pass.

The passes tell digits by their hashes; the last one compares all bytes of the windows that are still
grouped. What is left are exactly the repeated windows; all but the earliest of a group are covered
by what is removed. Documents bear numbers in their order, so that earlier means smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import settle, tidy

U64 = np.uint64
GRAM = 32
#: Bytes of context that a task sorts at a time (whole digits; one digit's contexts always together), texts' bytes combined before they are sent.
SORTED, COMBINED = 4 << 20, 8 << 20
#: Occurrences of one digit above which its windows are dealt one by one.
HOT = 1024
#: One text in SAMPLED tells which digits are held by many: those of over OFTEN of its texts, KNOWN at most. This changes the work, never the result.
SAMPLED, OFTEN, KNOWN = 64, 16, 1 << 16
#: Bytes that are hashed at a time.
HASHED = 1 << 20
FIRST_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(2 * HASHED, U64(base))
        p[0] = U64(1)
        out.append(np.cumprod(p))
    return out[0], out[1]


def rolling(b: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n bytes from each place on."""
    power, inverse = _powers()
    out = np.zeros(max(0, len(b) - n + 1), U64)
    for at in range(0, len(out), HASHED):
        part = b[at : at + HASHED + n - 1]
        sums = np.concatenate([[U64(0)], np.cumsum((part.astype(U64) + U64(1)) * power[: len(part)])])
        out[at : at + HASHED] = _mix((sums[n:] - sums[:-n]) * inverse[: len(part) - n + 1])
    return out


def _slide(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (minimum or maximum) over the n values from each place on."""
    k, y = 1, x
    while 2 * k <= n:
        y = least(y[:-k], y[k:])
        k *= 2
    size = len(x) - n + 1
    return least(y[:size], y[n - k : n - k + size])


def anchors(text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash and place, the first and the last window start."""
    none = np.zeros(0, np.int64)
    if len(text) < window:
        return none.view(U64), none, none, none
    h = rolling(np.frombuffer(text, np.uint8), GRAM)
    reach = window - GRAM + 1
    least = _slide(h, reach, np.minimum)
    edge = np.zeros(reach - 1, U64)
    chosen = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), reach, np.maximum) == h)
    starts = np.flatnonzero(least[1:] != least[:-1]) + 1
    # after an anchor the next window has another one, even where an equal string comes next
    starts = np.unique(np.concatenate([[0], starts, chosen[chosen < len(least) - 1] + 1]))
    at = np.searchsorted(chosen, starts)
    wrong = np.flatnonzero(h[chosen[at]] != least[starts])
    while len(wrong):
        at[wrong] += 1
        wrong = wrong[h[chosen[at[wrong]]] != least[starts[wrong]]]
    place = chosen[at]
    new = np.concatenate([[True], place[1:] != place[:-1]])
    place, starts = place[new], starts[new]
    return h[place], place, starts, np.append(starts[1:] - 1, len(least) - 1)


def _spread(b: pa.RecordBatch, k: int) -> Iterator[tuple[int, bytes]]:
    for i, x in enumerate(b.column(k)):
        yield i, (x.as_py() or "").encode()


_PLACES = T.StructType([T.StructField("digit", T.LongType()), T.StructField("cid", T.LongType()), T.StructField("place", T.IntegerType())])


def _first_digits(docs: DataFrame, window: int) -> DataFrame:
    """(digit, cid, place) of every anchor of (cid, sha, text), cid being a hash of sha; a text that a task meets again is passed over.

    Of a digit that one text holds more often two places go on: they say that it repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for b in batches:
            cid, sha = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[], [], []]
            for i, text in _spread(b, 2):
                if len(text) >= window and sha[i] not in met:
                    met.add(sha[i])
                    h, place, _, _ = anchors(text, window)
                    by = np.argsort(h, kind="stable")
                    third = np.zeros(len(h), bool)
                    third[2:] = h[by[2:]] == h[by[:-2]]
                    h, place = h[by[~third]], place[by[~third]]
                    for o, x in zip(out, (h.view(np.int64), np.full(len(h), cid[i]), place.astype(np.int32)), strict=True):
                        o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=_PLACES.names)

    return docs.select("cid", "sha", "text").mapInArrow(tidy(run), _PLACES)


def _known_digits(docs: DataFrame, window: int) -> np.ndarray:
    """Digits, in order, that over OFTEN of the sampled texts hold."""
    some = _first_digits(docs.where(F.pmod(F.col("cid"), F.lit(SAMPLED)) == 0), window)
    found = some.groupBy("digit").agg(F.count_distinct("cid").alias("n")).where(F.col("n") > OFTEN).orderBy(F.desc("n"), "digit").limit(KNOWN)
    return np.sort(found.toArrow().column("digit").to_numpy())


def _apart(digits: DataFrame, known: np.ndarray) -> DataFrame:
    """digits with a column known: whether the digit is among those."""
    sent = digits.sparkSession.sparkContext.broadcast(known)  # KNOWN longs at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.isin(b.column(0).to_numpy(), sent.value))], names=[*b.schema.names, "known"])

    return digits.mapInArrow(tidy(run), T.StructType([*_PLACES.fields, T.StructField("known", T.BooleanType())]))


def _runs(batches: Iterator[pa.RecordBatch], key: str, most: int, size) -> Iterator[pa.Table]:
    """Tables of whole runs of key from sorted batches, of about most by size(batch) at a time."""
    held: list[pa.RecordBatch] = []
    room = 0
    for b in batches:
        if not b.num_rows:
            continue
        if room >= most:
            # give out all but the last digit, which may go on
            t = pa.Table.from_batches(held)
            keys = t.column(key).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield t.slice(0, last)
            rest = t.slice(last).combine_chunks()
            held = rest.to_batches()
            room = sum(map(size, held)) // 2  # one long digit: wait until as much again has come
        held.append(b)
        room += size(b)
    if held:
        yield pa.Table.from_batches(held)


def _repeated(digits: DataFrame, most: int) -> DataFrame:
    """(cid, place, hot) of the anchors whose digit occurs at two places at least; hot: at over `most`.

    No more than a digit's first rows are held: a longer one is hot, and its rows pass through.
    Rows of digits known to be held by many texts are dealt over all tasks and pass through as well.
    """

    def out(digit: np.ndarray, cid: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((place, cid, digit))
        digit, cid, place = digit[order], cid[order], place[order]
        new = np.ones(len(digit), bool)
        new[1:] = (digit[1:] != digit[:-1]) | (cid[1:] != cid[:-1]) | (place[1:] != place[:-1])
        digit, cid, place = digit[new], cid[new], place[new]
        _, which, count = np.unique(digit, return_inverse=True, return_counts=True)
        count = count[which]
        many = count > 1
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(cid[many]), pa.array(place[many]), pa.array(count[many] > most)], names=["cid", "place", "hot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        passing = None
        for b in batches:
            known = b.column(3).to_numpy(zero_copy_only=False)
            cols = tuple(c.to_numpy() for c in b.columns[:3])
            if known.any():
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][known]), pa.array(cols[2][known]), pa.array(np.ones(int(known.sum()), bool))], names=["cid", "place", "hot"])
                cols = tuple(c[~known] for c in cols)
            if passing is not None and len(cols[0]):
                n = int(np.searchsorted(cols[0], passing, "right"))
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[1][:n]), pa.array(cols[2][:n]), pa.array(np.ones(n, bool))], names=["cid", "place", "hot"])
                cols = tuple(c[n:] for c in cols)
            if not len(cols[0]):
                continue
            passing = None
            held.append(cols)
            if sum(len(c[0]) for c in held) < 1 << 17:
                continue
            cols = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from out(*(c[:last] for c in cols))
            held = [tuple(c[last:] for c in cols)]
            if len(held[0][0]) > most:
                (digit, cid, place), held = held[0], []
                passing = digit[0]
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(place), pa.array(np.ones(len(cid), bool))], names=["cid", "place", "hot"])
        if held:
            yield from out(*(np.concatenate(c) for c in zip(*held, strict=True)))

    parts = int(digits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(F.col("known"), F.xxhash64("cid", "place")).otherwise(0)
    return digits.repartition(parts, "digit", salt).sortWithinPartitions("digit").mapInArrow(tidy(run), "cid long, place int, hot boolean")


CONTEXT = T.StructType([T.StructField(n, k) for n, k in (("digit", T.LongType()), ("doc", T.LongType()), ("start", T.IntegerType()), ("before", T.IntegerType()), ("windows", T.IntegerType()), ("context", T.BinaryType()))])
RANGES = T.StructType([T.StructField(n, k) for n, k in (("doc", T.LongType()), ("start", T.IntegerType()), ("stop", T.IntegerType()))])


def _earliest(group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its group in the given order."""
    by = np.lexsort((*order[::-1], group))
    g = group[by]
    out = np.zeros(len(group), bool)
    out[by] = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    return out


def _ids_of(*columns: np.ndarray) -> np.ndarray:
    """Group numbers of rows that agree in all columns."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def _join_ranges(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges of one document that touch their neighbour become one."""
    by = np.lexsort((start, doc))
    doc, start, stop = doc[by], start[by], stop[by]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], np.maximum.reduceat(stop, head) if len(head) else stop


def _contexts(found: DataFrame, window: int) -> DataFrame:
    """CONTEXT rows of the repeated anchors of each document (doc, places, text).

    Where a task meets equal contexts of one digit, only the earliest is sent on; the others hold
    nothing but repeated windows, and rows of their joined ranges (windows = 0, before = the length)
    say so. A digit is repeated if one of its places is listed. The windows of hot digits come one
    by one, each under its own hash: no group of different contexts is then larger than that.
    """

    def out(rows: list[tuple]) -> pa.RecordBatch:
        rows = list({r[1:3]: r for r in rows}.values())  # repeated rows are one document
        digit, doc, start, before, windows = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:5])
        context = pa.array([r[5] for r in rows], pa.binary())
        same = context.dictionary_encode().indices.to_numpy()
        first = _earliest(_ids_of(digit, before, same), doc, start)
        doc2, start2, stop2 = _join_ranges(doc[~first], start[~first], (start + windows + window - 1)[~first])
        cols = [
            np.concatenate([digit[first], _mix(doc2.view(U64) ^ _mix(start2.view(U64))).view(np.int64)]),
            np.concatenate([doc[first], doc2]),
            np.concatenate([start[first], start2]).astype(np.int32),
            np.concatenate([before[first], stop2 - start2]).astype(np.int32),
            np.concatenate([windows[first], np.zeros(len(doc2), np.int64)]).astype(np.int32),
        ]
        sent = pa.concat_arrays([context.filter(pa.array(first)), pa.array([b""] * len(doc2), pa.binary())])
        return pa.RecordBatch.from_arrays([*map(pa.array, cols), sent], names=CONTEXT.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            docs = b.column(0).to_pylist()
            for k, text in _spread(b, 2):
                h, place, lo, hi = anchors(text, window)
                listed = b.column(1)[k].values
                at, hot = listed.field(0).to_numpy(), listed.field(1).to_numpy(zero_copy_only=False)
                keep = np.isin(h, h[np.isin(place, at)])
                single = keep & np.isin(h, h[np.isin(place, at[hot])])
                for j in np.flatnonzero(keep & ~single).tolist():
                    s, e = int(lo[j]), int(hi[j])
                    rows.append((int(h[j].view(np.int64)), docs[k], s, int(place[j]) - s, e - s + 1, text[s : e + window]))
                    size += e - s + window
                if single.any():
                    own = rolling(np.frombuffer(text, np.uint8), window).view(np.int64)
                    for j in np.flatnonzero(single).tolist():
                        for s in range(int(lo[j]), int(hi[j]) + 1):
                            rows.append((int(own[s]), docs[k], s, 0, 1, text[s : s + window]))
                            size += window
                        if size > COMBINED:
                            yield out(rows)
                            rows, size = [], 0
                if size > COMBINED:
                    yield out(rows)
                    rows, size = [], 0
        if rows:
            yield out(rows)

    return found.mapInArrow(tidy(run), CONTEXT)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer."""
    return np.lib.stride_tricks.as_strided(data, (max(0, len(data) - 7), 8), (1, 1)).copy().view(U64).ravel() if len(data) > 7 else np.zeros(0, U64)


def _split_by_bytes(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Groups of the windows at these places that agree in every byte, from groups that agree in their hashes."""
    word = _words(data)
    offsets = [*range(0, window - 7, 8), window - 8]
    out, rest, n = np.empty(len(at), np.int64), np.arange(len(at)), 0
    while len(rest):
        _, head, g = np.unique(group[rest], return_index=True, return_inverse=True)
        model = at[rest[head]][g]
        same = np.ones(len(rest), bool)
        for k in offsets:
            same &= word[at[rest] + k] == word[model + k]
        out[rest[same]] = g[same] + n
        n += len(head)
        rest = rest[~same]  # hashes that met: another group
    return out


def _sort_windows(t: pa.Table, window: int) -> list[tuple[np.ndarray, ...]]:
    """Ranges (doc, start, stop) of repeated windows that are not the earliest, from the contexts of whole digits."""
    digit, doc, start, before, windows = (t.column(k).to_numpy().astype(np.int64) for k in range(5))
    done = windows == 0
    out = [(doc[done], start[done], start[done] + before[done])]
    rest = np.flatnonzero(~done)
    rest = rest[_earliest(_ids_of(doc[rest], start[rest]))]  # repeated rows are one document
    context = t.column(5).take(pa.array(rest)).combine_chunks()
    digit, doc, start, before, windows = (x[rest] for x in (digit, doc, start, before, windows))
    if not len(rest):
        return out
    # equal contexts: all windows of the later ones repeat
    same = (context.chunk(0) if isinstance(context, pa.ChunkedArray) else context).dictionary_encode()
    first = _earliest(_ids_of(digit, before, same.indices.to_numpy()), doc, start)
    out.append((doc[~first], start[~first], (start + windows + window - 1)[~first]))
    # different contexts of one digit: their windows, by anchor offset and then by the next bytes
    names, where, count = np.unique(digit[first], return_inverse=True, return_counts=True)
    rows = np.flatnonzero(first)[count[where] > 1]
    if not len(rows):
        return out
    n = windows[rows]
    begin = np.cumsum(n) - n
    row = np.repeat(np.arange(len(rows)), n)
    shift = np.arange(len(row)) - begin[row]
    some = context.take(pa.array(rows))
    some = some.combine_chunks() if isinstance(some, pa.ChunkedArray) else some
    some = some.chunk(0) if isinstance(some, pa.ChunkedArray) else some
    ends = np.frombuffer(some.buffers()[1], np.int32)[some.offset : some.offset + len(some) + 1].astype(np.int64)
    data = np.frombuffer(some.buffers()[2], np.uint8)[: ends[-1]]
    at = ends[:-1][row] + shift
    cuts = [window * k // 4 for k in range(5)]
    live = np.arange(len(row))
    group = _ids_of(digit[rows][row], before[rows][row] - shift)
    hashes: dict[int, np.ndarray] = {}
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a not in hashes:
            hashes[b - a] = rolling(data, b - a)
        group = _ids_of(group, hashes[b - a][at[live] + a])
        many = np.bincount(group)[group] > 1
        live, group = live[many], group[many]
        if not len(live):
            return out
    group = _split_by_bytes(data, at[live], group, window)
    r = rows[row[live]]
    later = ~_earliest(group, doc[r], start[r] + shift[live])
    again = np.zeros(len(row), bool)
    again[live[later]] = True
    # neighbouring windows of one context make one range
    joined = again & np.concatenate([[False], again[:-1]]) & (shift > 0)
    heads = np.flatnonzero(again & ~joined)
    tails = np.flatnonzero(again & ~np.concatenate([joined[1:], [False]]))
    r = rows[row[heads]]
    out.append((doc[r], start[r] + shift[heads], start[r] + shift[tails] + window))
    return out


def _ranges(contexts: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "digit", SORTED, lambda b: b.column(5).nbytes):
            doc, start, stop = _join_ranges(*(np.concatenate(x) for x in zip(*_sort_windows(t, window), strict=True)))
            if len(doc):
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], names=RANGES.names)

    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return contexts.repartition(parts, "digit").sortWithinPartitions("digit").mapInArrow(tidy(run), RANGES)


def union_of(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of what (start, stop) ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), stops.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept", counts: tuple[str, str, str] = ("n_bytes", "n_removed", "n_spans"), digest_col: str | None = None, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """docs with the bytes that stay (binary), and the numbers of bytes, removed bytes and maximal removed runs.

    A byte is removed if a string of window bytes covers it that also starts earlier: in a document
    of smaller id, or at a smaller place in the same document. Documents are their whole UTF-8
    texts; strings never cross documents and are judged on the input. Null and short texts lose
    nothing. A null id is smaller than any other; documents that share an id come in the order of
    their texts' SHA-256, and of repeated rows (same id and text) one counts as the earlier one.
    With digest_col the SHA-256 of the bytes that stay (lower-case hex) comes instead of kept_col.
    With as_text kept_col is a string: what is left of a character that was cut goes, null stays null.
    Digits with more than hot occurrences have their windows dealt one by one; the result is the same.
    Columns of docs that bear one of these names are replaced. window is at least 64.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be {2 * GRAM} at least")
    new = [digest_col or kept_col, *counts]
    docs = docs.drop(*new)
    sha = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST_ID))
    seen = settle(docs.select(key.alias("id"), sha.alias("sha")).groupBy("id", "sha").agg(F.count(F.lit(1)).alias("n")))
    # the earliest of each text; sorted over all partitions, so that the numbers keep the order
    firsts = settle(seen.groupBy("sha").agg(F.min("id").alias("id")).orderBy("id", "sha").withColumn("doc", F.monotonically_increasing_id()))
    long_texts = docs.where(F.octet_length(text_col) >= window).select(key.alias("id"), sha.alias("sha"), F.col(text_col).alias("text"))
    named = long_texts.withColumn("cid", F.xxhash64("sha"))
    places = _repeated(_apart(_first_digits(named, window), _known_digits(named, window)), hot)
    places = settle(places.groupBy("cid").agg(F.collect_set(F.struct("place", "hot")).alias("places")))
    wanted = settle(places.join(firsts.withColumn("cid", F.xxhash64("sha")).hint("merge"), "cid").select("id", "sha", "doc", "places"))
    found = long_texts.join(wanted.hint("merge"), ["id", "sha"]).select("doc", "places", "text")
    ranges = settle(_ranges(_contexts(found, window), window))
    spans = settle(ranges.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    # every distinct (id, text): the earliest of its text has its spans, a later copy is a copy
    marks = seen.join(firsts.join(spans, "doc", "left"), ["id", "sha"], "left")
    marks = settle(marks.select(F.col("id").alias("__q_id"), F.col("sha").alias("__q_sha"), F.col("n").alias("__q_n"), F.col("doc").isNotNull().alias("__q_first"), F.col("spans").alias("__q_spans")))
    columns, own = [F.col(f"`{f.name}`") for f in docs.schema], ["__q_first", "__q_spans"]
    keyed = docs.withColumns({"__q_id": key, "__q_sha": sha})
    rows = keyed.join(marks.where("__q_n = 1").hint("merge"), ["__q_id", "__q_sha"]).select(*columns, *own)
    if not (several := marks.where("__q_n > 1")).isEmpty():
        # repeated rows: stored and numbered, the one of the least number counts as the earlier one
        again = settle(keyed.join(several.hint("merge"), ["__q_id", "__q_sha"]).withColumn("__q_no", F.monotonically_increasing_id()))
        least = settle(again.groupBy("__q_id", "__q_sha").agg(F.min("__q_no").alias("__q_no")).select("__q_no", F.lit(True).alias("__q_one")))
        again = again.join(least, "__q_no", "left").withColumn("__q_first", F.col("__q_first") & F.col("__q_one").isNotNull())
        rows = rows.unionAll(again.select(*columns, *own))
    fields = [*docs.schema.fields, T.StructField(new[0], T.StringType() if digest_col or as_text else T.BinaryType()), *(T.StructField(c, T.LongType()) for c in counts)]
    at = docs.columns.index(text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, first, spans = b.column(at), b.column(len(fields) - 4).to_pylist(), b.column(len(fields) - 3)
            kept, numbers = [], [[], [], []]
            for k, data in _spread(b, at):
                cut_out: list[tuple[int, int]] = []
                if not first[k]:
                    cut_out = [(0, len(data))] if len(data) >= window else []
                elif spans[k].is_valid:
                    both = spans[k].values
                    cut_out = union_of(both.field(0).to_numpy(), both.field(1).to_numpy())
                stay, done = [], 0
                for a, e in cut_out:
                    stay.append(data[done:a])
                    done = e
                left = b"".join([*stay, data[done:]])
                if digest_col:
                    kept.append(hashlib.sha256(left).hexdigest())
                elif as_text:
                    kept.append(left.decode("utf-8", "ignore") if texts[k].is_valid else None)
                else:
                    kept.append(left)
                for o, x in zip(numbers, (len(data), len(data) - len(left), len(cut_out)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(fields) - 4], pa.array(kept, pa.string() if digest_col or as_text else pa.binary()), *(pa.array(o, pa.int64()) for o in numbers)], names=[f.name for f in fields])

    return rows.mapInArrow(tidy(cut), T.StructType(fields))
