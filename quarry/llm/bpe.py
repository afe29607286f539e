"""Byte-level BPE: encoding with offsets, and decoding, over Arrow batches with the tokenizers library.

A rank file (base64 token and rank a line) becomes a tokenizers model: bytes stand as characters by
the byte table, every way to cut a token into two tokens becomes a merge of the token's rank.
Pre-tokens never cross a lone space between two other characters, so texts are cut there, words are
told apart by Arrow, and each distinct one goes through the tokenizer; a bounded memo keeps its ids.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from quarry.llm.common import tidy

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already

#: Ids are kept as little-endian unsigned 32-bit integers.
IDS = np.dtype("<u4")
#: Words that the memo holds, characters of the longest of them; texts and characters that are encoded together; words that the tokenizer gets as one text.
MEMO, LONGEST, TOGETHER, CHARS, JOINED = 200_000, 48, 2048, 1 << 22, 512
_CUT = re.compile(r"(?<=\S)(?= \S)")


@cache
def byte_to_char() -> list[str]:
    """The byte table: printable bytes of Latin-1 stand for themselves, the others for 256, 257 and so on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@cache
def char_to_byte() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_to_char())}


def read_ranks(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def load(name: str) -> Tokenizer:
    """The tokenizer of a .json or a .tiktoken file. Strings of special tokens in a text are ordinary text."""
    if name.endswith(".json"):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.encode_special_tokens = True
        return t
    ranks, chars = read_ranks(name), byte_to_char()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = [(shown[token[:i]], shown[token[i:]]) for token in sorted(ranks, key=ranks.get) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    t = Tokenizer(models.BPE(vocab={shown[k]: v for k, v in ranks.items()}, merges=merges, ignore_merges=True))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return t


@cache
def token_bytes(name: str) -> list[bytes]:
    """The bytes of each id, by the byte table read backwards."""
    vocab = load(name).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for shown, i in vocab.items():
        out[i] = bytes(char_to_byte()[c] for c in shown) if all(c in char_to_byte() for c in shown) else shown.encode()
    return out


class Encoder:
    """Ids of whole texts as bytes of IDS."""

    def __init__(self, name: str):
        self.tokenizer = load(name)
        self.opens = np.array([x.startswith(b" ") for x in token_bytes(name)])
        self.memo: dict[str, bytes] = {}  # ids of " " + key

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of " " + w for each w. Words without spaces in them or at their ends go through the tokenizer together: a token opens with a space only where a word begins."""
        odd = [w for w in words if " " in w or w != w.strip()]
        if odd:
            got = dict(zip(odd, self._ids([" " + w for w in odd]), strict=True))
            plain = [w for w in words if w not in got]
            got.update(zip(plain, self._spaced(plain), strict=True))
            return [got[w] for w in words]
        out: list[bytes] = []
        for buffer in self._ids([" " + " ".join(words[k : k + JOINED]) for k in range(0, len(words), JOINED)]):
            at = (4 * np.flatnonzero(self.opens[np.frombuffer(buffer, IDS)])).tolist()
            out += [buffer[i:j] for i, j in zip(at, [*at[1:], len(buffer)], strict=True)]
        if len(out) != len(words):
            raise AssertionError("a word without a token of its own")
        return out

    def _known(self, words: list[str]) -> list[bytes]:
        """Ids of " " + w for different words, by the memo where it has them."""
        found = list(map(self.memo.get, words))
        new = [w for w, x in zip(words, found, strict=True) if x is None]
        if not new:
            return found
        made = self._spaced(new)
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        if len(new) > MEMO or max(map(len, new)) > LONGEST:
            self.memo.update([(w, x) for w, x in zip(new[:MEMO], made, strict=False) if len(w) <= LONGEST])
        else:
            self.memo.update(zip(new, made, strict=True))
        rest = iter(made)
        return [next(rest) if x is None else x for x in found]

    def _with_care(self, text: str) -> bytes:
        """Ids of a text with spaces beside white space."""
        first, *rest = _odd(text)
        different = list(dict.fromkeys(rest))
        ids = dict(zip(different, self._known(different), strict=True))
        return b"".join([self._ids([first])[0], *map(ids.__getitem__, rest)])

    def _together(self, texts: list[str]) -> list[bytes]:
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        flat, at = words.flatten().dictionary_encode(), words.offsets.to_numpy()
        different, which = flat.dictionary.to_pylist(), flat.indices.to_numpy().astype(np.int64)
        odd_word = np.array([not w or w != w.strip() for w in different], bool)
        odd = np.logical_or.reduceat(odd_word[which], at[:-1])
        heads, usual = at[:-1], np.repeat(~odd, np.diff(at))
        usual[heads] = False
        used = np.flatnonzero(np.bincount(which[usual], minlength=len(different)))
        table: list[bytes] = [b""] * len(different)
        for i, x in zip(used.tolist(), self._known([different[i] for i in used.tolist()]), strict=True):
            table[i] = x
        table += self._ids([different[i] if not o else "" for i, o in zip(which[heads].tolist(), odd.tolist(), strict=True)])
        which[heads] = len(different) + np.arange(len(texts))  # a text's first word has no space before it
        ids = pa.array(table, pa.large_binary()).take(pa.array(which))
        ends, data = np.frombuffer(ids.buffers()[1], np.int64)[at].tolist(), memoryview(ids.buffers()[2] or b"")
        return [self._with_care(t) if o and t else bytes(data[i:j]) for t, o, i, j in zip(texts, odd.tolist(), ends, ends[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > CHARS or len(some) == TOGETHER:
                out += self._together(some)
                some, size = [], 0
        return out + (self._together(some) if some else [])


def _odd(text: str) -> list[str]:
    """The pieces of a text with runs of white space; all but the first without their leading space."""
    first, *rest = _CUT.split(text)
    return [first, *(w[1:] for w in rest)]


def decode_bytes(ids: bytes, name: str) -> bytes:
    """The bytes of ids; they may end or begin inside a character."""
    return b"".join(map(token_bytes(name).__getitem__, np.frombuffer(ids, IDS).tolist()))


def offsets(text: str, ids: bytes, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Of each token the first character and the one after the last; tokens that split a character both get it."""
    lengths = np.fromiter(map(len, map(token_bytes(name).__getitem__, np.frombuffer(ids, IDS).tolist())), np.int64)
    at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)  # characters up to each byte
    end = np.cumsum(lengths)
    return at[end - lengths] - 1, at[end - 1]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode(docs: DataFrame, name: str, text_col: str = "text", ids_col: str = "ids", with_offsets: bool = False) -> DataFrame:
    """docs with the ids of each whole text (binary, little-endian unsigned 32-bit).

    A null or empty text has no ids. with_offsets adds arrays <ids_col>_from and <ids_col>_to of
    character offsets. Columns of docs with these names are replaced.
    """
    more = [T.StructField(ids_col, T.BinaryType())] + with_offsets * [T.StructField(f"{ids_col}_{k}", T.ArrayType(T.LongType())) for k in ("from", "to")]
    docs = docs.drop(*(f.name for f in more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(name)
        for b in small_batches(batches):
            texts = [x.as_py() or "" for x in b.column(b.schema.get_field_index(text_col))]
            ids = encoder(texts)
            new = [pa.array(ids, pa.binary())]
            if with_offsets:
                both = [offsets(x, i, name) for x, i in zip(texts, ids, strict=True)]
                new += [pa.array([x[k] for x in both], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, *(f.name for f in more)])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *more]))


def decode(df: DataFrame, name: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the bytes that the ids stand for; null ids give null. Cast to string for text.

    The bytes are exact even where ids begin or end inside a character. An existing out_col is replaced.
    """
    df = df.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            got = [None if x is None else decode_bytes(x, name) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], names=[*b.schema.names, out_col])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(out_col, T.BinaryType())]))
