"""Pack token pieces into sequences: best fit, then a local search by moves and swaps.

Pieces are dealt at random to groups that a task can hold. In a group, best fit by decreasing
length opens the bins; then the emptiest bins are taken apart: their pieces move to other bins, or
change places with one or two smaller ones, whenever that increases the sum of squared fills,
until no step helps or the bins are as few as the tokens need.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bpe import IDS, TOGETHER, Encoder, small_batches
from quarry.llm.common import settle, tidy

BIN = np.int64(1) << 32


def cut(docs: DataFrame, capacity: int = 2048, name: str = "byte_bpe_50k.json", end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: the id column, piece, start, length, ids_crc32 (and ids, if asked for).

    A document is its text's ids (none for a null or empty text) and end_id. One of at most
    capacity tokens is one piece; a longer one is cut so that all pieces but the first are full.
    """
    fields = [T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(n, k) for n, k in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))]
    fields += with_ids * [T.StructField("ids", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(name)
        for b in small_batches(batches, TOGETHER):
            rows, piece, start, length, crc, out = [], [], [], [], [], []
            for r, whole in enumerate(encoder([x.as_py() or "" for x in b.column(1)])):
                ids = np.append(np.frombuffer(whole, IDS), IDS.type(end_id)).astype(IDS)
                ends = list(range(len(ids), 0, -capacity))[::-1]
                for k, e in enumerate(ends):
                    s = ends[k - 1] if k else 0
                    part = ids[s:e].tobytes()
                    rows.append(r), piece.append(k), start.append(s), length.append(e - s), crc.append(zlib.crc32(part))
                    if with_ids:
                        out.append(part)
            arrays = [b.column(0).take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*arrays, *with_ids * [pa.array(out, pa.binary())]], names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), T.StructType(fields))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: each piece, longest first, goes to the fullest bin that has room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if at := open_rooms >> n:
            room = n + (at & -at).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins


class _Bins:
    """Bins in search: pieces by length, and of each room the sums of up to two pieces that bins with that room can give.

    Sums are bits of an integer. Those of a room may be out of date: bits only join, until a look
    in vain puts them right.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        self.capacity, self.own = capacity, [{} for _ in bins]
        for own, b in zip(self.own, bins, strict=True):
            for i in b:
                own.setdefault(lengths[i], []).append(i)
        self.room = [capacity - sum(n * len(p) for n, p in own.items()) for own in self.own]
        self.sums = [0] * len(bins)
        self.at: dict[int, set[int]] = {}
        self.united: dict[int, int] = {}
        for b in range(len(bins)):
            self.put(b)

    def put(self, b: int) -> None:
        """Enter a bin under its room; full and empty ones take no part."""
        if (own := self.own[b]) and self.room[b]:
            singles, out = sum(1 << n for n in own), 1
            for n, pieces in own.items():
                out |= singles >> (n + 1) << (2 * n + 1)  # with a longer one
                if len(pieces) > 1:
                    out |= 1 << 2 * n
            self.sums[b] = out | singles
            self.at.setdefault(self.room[b], set()).add(b)
            self.united[self.room[b]] = self.united.get(self.room[b], 0) | self.sums[b]

    def take_out(self, b: int) -> None:
        members = self.at.get(self.room[b], set())
        members.discard(b)
        if not members:
            self.at.pop(self.room[b], None)
            self.united.pop(self.room[b], None)

    def best(self, size: int, target: int) -> tuple[int, int, int] | None:
        """(room left, bin, sum): the other bin that a piece of this size fills most, in exchange for a smaller sum of its pieces."""
        found = None
        for r, members in self.at.items():
            low = max(0, size - r)
            if found and r - size + low >= found[0]:
                continue
            x = self.united[r] >> low
            for fresh in (False, True):
                n = low + (x & -x).bit_length() - 1
                if not x or n >= size or (found and r - size + n >= found[0]):
                    break
                b = next((b for b in members if b != target and self.sums[b] >> n & 1), None)
                if b is not None:
                    found = r - size + n, b, n
                    break
                if not fresh:
                    others = 0
                    for b in members:
                        others |= self.sums[b] if b != target else 0
                    self.united[r] = others | (self.sums[target] if target in members else 0)
                    x = others >> low
            if found and found[0] == 0:
                break
        return found

    def give(self, b: int, n: int) -> list[int]:
        """Take pieces of n tokens together out of a bin: none, one or two."""
        own = self.own[b]
        which = [] if n == 0 else [n] if n in own else next([m, n - m] for m in own if n - m in own and (2 * m != n or len(own[m]) > 1))
        out = []
        for m in which:
            out.append(own[m].pop())
            if not own[m]:
                del own[m]
        self.room[b] += n
        return out

    def add(self, b: int, size: int, piece: int) -> None:
        self.own[b].setdefault(size, []).append(piece)
        self.room[b] -= size


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """bins after moves and one-for-one and two-for-one swaps between underfull bins.

    The emptiest bin gives pieces away, the longest first: a piece moves to another bin, or changes
    places with one or two smaller pieces of another bin, whatever leaves that bin fullest. Every
    step makes a bin fuller than the emptiest was and so increases the sum of squared fills, so the
    search ends: when no step helps, or at the least possible number of bins.
    """
    least, live = -(-sum(lengths) // capacity), len(bins)
    s = _Bins(bins, lengths, capacity)

    def step(target: int) -> bool:
        for size in sorted(s.own[target], reverse=True):
            got = s.best(size, target)
            if got and got[0] < s.room[target]:
                _, other, n = got
                s.take_out(target), s.take_out(other)
                back = s.give(other, n)
                s.add(other, size, s.give(target, size)[0])
                for i in back:
                    s.add(target, lengths[i], i)
                s.put(target), s.put(other)
                return True
        return False

    moved = True
    while moved and live > least:
        moved = False
        for target in sorted((b for members in s.at.values() for b in members), key=lambda b: (-s.room[b], b)):
            while live > least and s.own[target] and s.room[target] and step(target):
                moved = True
                live -= not s.own[target]
    return [[i for pieces in own.values() for i in pieces] for own in s.own if own]


def pack(pieces: DataFrame, capacity: int = 2048, group_pieces: int = 16_384, seed: int = 7) -> DataFrame:
    """pieces (of cut()) with sequence_id and offset, the place in the sequence, gapless from 0.

    An empty table gives an empty one. Repeated rows are packed as often as they occur. Pieces are
    packed in random groups of about group_pieces, so that a task can hold one; a group leaves one
    sequence at most that the whole would not, beside what the search can't help.
    """
    pieces = settle(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    names = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(got: pa.Table) -> pa.Table:
        got = got.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("start", "ascending")])
        lengths = got.column("length").to_pylist()
        group = got.column("__q_group")[0].as_py()
        seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i in b:
                seq[i], offset[i] = group * BIN + k, at
                at += lengths[i]
        return got.select(names).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups))  # of a stored table: repeated rows are spread
    return pieces.withColumn("__q_group", group).groupBy("__q_group").applyInArrow(run, schema)
