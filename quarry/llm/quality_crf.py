"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a word is labelled good or bad from its own features, those of its neighbours and
the labels beside it. The forward-backward marginals of "good", weighted by line length, make the
score of the document. Labels of documents serve as the labels of their lines in training.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import tidy

SYMBOLS, DIGITS, ENDS = "#*$%&|<>", "0123456789", ".!?:;\"'”»"
FEATURES = ("distinct_words", "distinct_triples", "equal_neighbours", "symbols", "shouts", "upper_words", "digits", "word_length", "log_words", "ends", "repeated_line", "long_words")
#: Training documents at most (the labelled ids of least hash), and lines of one: longer documents are left out of training whole.
SAMPLE, LINES = 6_000, 256


def line_features(text: str | None) -> tuple[list[tuple[float, ...]], list[int]]:
    """Features and length in characters of every line of a text that has a word."""
    rows, lengths, seen = [], [], set()
    for line in (text or "").split("\n"):
        w = line.split()
        if not w:
            continue
        n = len(w)
        rows.append(
            (
                len(set(w)) / n,
                len(set(zip(w, w[1:], w[2:], strict=False))) / (n - 2) if n > 2 else 1.0,
                sum(map(eq, w, w[1:])) / n,
                min(2.0, sum(map(line.count, SYMBOLS)) / n),
                min(2.0, line.count("!") / n),
                sum(map(str.isupper, w)) / n,
                min(2.0, sum(map(line.count, DIGITS)) / n),
                min(20.0, (len(line) - n + 1) / n) / 5,
                math.log(n) / 3,
                float(line.rstrip()[-1] in ENDS),
                float(line in seen),
                max(map(len, w)) > 40,
            )
        )
        lengths.append(len(line))
        seen.add(line)
    return rows, lengths


@dataclass(frozen=True)
class Model:
    """Weights of a line's own, the previous and the next line's features, the bias, and what equal neighbouring labels add."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    stay: tuple[float, float]

    def odds(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of "good" of each line by its features; first marks the lines that begin a document."""
        return _wide((x - self.mean) / self.scale, first) @ self.weights + self.bias


def _wide(z: np.ndarray, first: np.ndarray) -> np.ndarray:
    before, after = np.zeros_like(z), np.zeros_like(z)
    before[1:], after[:-1] = z[:-1], z[1:]
    before[first] = 0
    after[:-1][first[1:]] = 0
    return np.concatenate([z, before, after], 1)


def marginals(odds: list[float], stay: tuple[float, float]) -> list[float]:
    """Probability of "good" for each line of one document, by forward and backward passes."""
    s0, s1 = math.exp(stay[0]), math.exp(stay[1])
    n = len(odds)
    local = [1 / (1 + math.exp(-max(-30.0, min(30.0, o)))) for o in odds]
    ahead, a = [], None
    for p in local:
        a = p if a is None else p * (a * s1 + 1 - a) / (p * (a * s1 + 1 - a) + (1 - p) * (a + (1 - a) * s0))
        ahead.append(a)
    out, b = [0.0] * n, 0.5
    for k in range(n - 1, -1, -1):
        up = ahead[k] * b
        out[k] = up / (up + (1 - ahead[k]) * (1 - b))
        good, bad = local[k] * b, (1 - local[k]) * (1 - b)
        up, down = good * s1 + bad, good + bad * s0
        b = up / (up + down)
    return out


def _expectations(odds: np.ndarray, live: list[int], stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals, and the expected numbers of equal neighbours (bad, good), of sequences given step by step: first the first lines of all, longest sequence first, then the second lines of the live[1] longest, and so on."""
    s0, s1 = np.exp(np.clip(stay, -20, 20))
    local = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    at = np.concatenate([[0], np.cumsum(live)]).tolist()
    ahead, back = local.copy(), np.full_like(local, 0.5)
    for k in range(1, len(live)):
        a, p = ahead[at[k - 1] : at[k - 1] + live[k]], local[at[k] : at[k + 1]]
        good, bad = p * (a * s1 + 1 - a), (1 - p) * (a + (1 - a) * s0)
        ahead[at[k] : at[k + 1]] = good / (good + bad)
    same = np.zeros(2)
    for k in range(len(live) - 1, 0, -1):
        a, p, b = ahead[at[k - 1] : at[k - 1] + live[k]], local[at[k] : at[k + 1]], back[at[k] : at[k + 1]]
        good, bad = p * b, (1 - p) * (1 - b)
        both = a * s1 * good, (1 - a) * s0 * bad
        total = sum(both) + a * bad + (1 - a) * good
        same += [(both[1] / total).sum(), (both[0] / total).sum()]
        up, down = good * s1 + bad, good + bad * s0
        back[at[k - 1] : at[k - 1] + live[k]] = up / (up + down)
    up = ahead * back
    return up / (up + (1 - ahead) * (1 - back)), same


def fit(docs: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.1, decay: float = 0.02) -> Model:
    """A model from (line features, label of the document) of whole documents by gradient ascent on the conditional likelihood."""
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: -len(d[0]))
    width = len(FEATURES)
    if not docs:
        return Model(np.zeros(width), np.ones(width), np.zeros(3 * width), 0.0, (0.0, 0.0))
    x = np.concatenate([np.array(f, float).reshape(-1, width) for f, _ in docs])
    n, y = np.array([len(f) for f, _ in docs]), np.array([float(y) for _, y in docs])
    begin = np.cumsum(n) - n
    first = np.zeros(len(x), bool)
    first[begin] = True
    mean, scale = x.mean(0), np.maximum(x.std(0), 0.05)
    live = np.searchsorted(-n, -np.arange(n[0]), side="left").tolist()  # documents of more than k lines
    steps = np.concatenate([begin[:m] + k for k, m in enumerate(live)])
    z = _wide((x - mean) / scale, first)[steps]
    truth = np.concatenate([y[:m] for m in live])
    pairs = np.array([((n - 1) * (1 - y)).sum(), ((n - 1) * y).sum()])
    parts = max(len(docs), int(n.sum()) // 64)
    theta = np.zeros(3 * width + 3)  # weights, bias, stay
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        good, same = _expectations(z @ theta[: 3 * width] + theta[3 * width], live, theta[-2:])
        error = truth - good
        g = np.concatenate([z.T @ error, [error.sum()], pairs - same]) / parts - decay * np.concatenate([theta[: 3 * width], [0.0], theta[-2:]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, theta[: 3 * width], float(theta[3 * width]), (float(theta[-2]), float(theta[-1])))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is divisible by 5 (a null id counts as empty)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from labelled documents outside the held-out fifth.

    At most sample of them are taken, those of least hash of their id, and of these the documents
    of at most `lines` lines, whole. Labels without an id or a quality are passed over, and the
    least quality counts where an id has several. Of an id with several texts the least one counts.
    The driver gets 48 bytes a line: sample * lines * 48 at most, 74 MB by default.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("__q_id")).agg(F.min("quality").alias("__q_y")).orderBy(F.xxhash64("__q_id"), "__q_id").limit(sample)
    picked = docs.join(F.broadcast(known), F.col(id_col) == F.col("__q_id")).groupBy("__q_id", "__q_y").agg(F.min(text_col).alias("__q_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [line_features(x.as_py())[0] for x in b.column(2)]
            rows = [np.array(f, np.float32).tobytes() if len(f) <= lines else None for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], names=["id", "y", "x"])

    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType())]
    got = picked.mapInArrow(tidy(run), T.StructType(fields)).where("length(x) > 0").collect()
    got.sort(key=lambda r: (r.id, r.x))
    return fit([(np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)), r.y) for r in got])


def score(docs: DataFrame, model: Model, out_col: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the score of each whole text, 0 to 1; an existing out_col is replaced.

    A null text, or one without words, scores 0: nothing speaks for it.
    """
    docs = docs.drop(out_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lengths, counts = [], [], []
            for x in b.column(b.schema.get_field_index(text_col)):
                r, n = line_features(x.as_py())
                rows += r
                lengths += n
                counts.append(len(r))
            first = np.zeros(len(rows), bool)
            begins = np.cumsum([0, *counts])[:-1]
            first[[a for a, n in zip(begins.tolist(), counts, strict=True) if n]] = True
            odds = model.odds(np.array(rows, float).reshape(-1, len(FEATURES)), first).tolist() if rows else []
            out, at = [], 0
            for n in counts:
                good, size = marginals(odds[at : at + n], model.stay), lengths[at : at + n]
                out.append(sum(p * s for p, s in zip(good, size, strict=True)) / sum(size) if n else 0.0)
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, out_col])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())]))
