"""Repeated rows: of a query in the top-k search, of a labelled document in training."""

import zlib

import numpy as np
import pytest

from quarry.llm import quality_crf
from quarry.llm.substring_dedup import _split_by_bytes, remove_repeats
from quarry.llm.topk_search import top_k

from . import fixtures as X


@pytest.mark.parametrize("times", [1, 2, 3, 25, 50])
def test_repeated_query_rows_do_not_prune_neighbours(spark, times):
    """Queries whose rows are repeated, among vectors close together, with ties; each row is answered."""
    rng = np.random.default_rng(times)
    v = [[float(x) for x in y] for y in rng.normal(size=(400, 6)).round(1)]
    rows = [(i, x) for i, x in enumerate(v)] + [(i, v[i]) for i in (0, 20, 40) for _ in range(times - 1)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), k=5, every=20).collect()
    whole = {i: np.floor(np.array(x) * 64).astype(int) for i, x in rows}
    want = []
    for i, _ in rows:
        if i % 20 == 0:
            best = sorted((-int(whole[i] @ whole[j]), j) for j, _ in rows if j != i)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert X.multiset(tuple(r) for r in got) == X.multiset(want)


def test_large_components(spark):
    """Scores that fit 64 bits are exact, others raise; so do components beyond 2^61."""
    ask = lambda *vs: sorted(tuple(r) for r in top_k(spark.createDataFrame(list(enumerate(vs)), "vec_id long, embedding array<double>"), scale=1).collect())
    assert ask([1e15, 3.0], [1000.0, 1.0], [1000.0, 2.0]) == [(0, 1, 2, 10**18 + 6), (0, 2, 1, 10**18 + 3)]
    for bad in ([1e15, 1.0], [1e300, 1.0]):
        with pytest.raises(Exception, match="64 bits|too large"):
            ask(bad, bad)


def test_a_wide_grid_reads_exact_vectors_further(spark):
    """Outliers make cells wide: many bounds overlap, and rounds go on until the kth is certain."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(600)] + [(601, [900.0, -900.0, 900.0, -900.0])]
    got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), k=3, every=100).collect())
    whole = {i: np.floor(np.array(x) * 64).astype(int) for i, x in rows}
    want = [(i, k + 1, j, -s) for i in range(0, 600, 100) for k, (s, j) in enumerate(sorted((-int(whole[i] @ whole[j]), j) for j in whole if j != i)[:3])]
    assert got == want


def test_training_takes_a_repeated_document_once(spark):
    a, b = [i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 5][:2]  # not held out
    rows = [(a, "a plain sentence of good words.\nAnother one follows it."), (b, "BUY!!! $$$ 1234 >>>\n### click")]
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, quality int")
    one = quality_crf.train(X.documents(spark, rows), labels, sample=2)
    many = quality_crf.train(X.documents(spark, [rows[0]] * 6 + [rows[1]]), labels, sample=2)
    assert np.allclose(one.mean, many.mean) and np.allclose(one.weights, many.weights)


def test_repeated_rows_under_skew_splitting(spark):
    """2,000 equal rows, their join split over tasks: one keeps its text, whatever task it is in."""
    forced = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}
    before = {k: spark.conf.get(k) for k in forced}
    text = "one passage of over a hundred bytes that every one of the repeated rows holds, word by word, to its end here"
    rows = [(7, text)] * 2000 + [(1, "short"), (9, text), (8, f"own start {text}")]
    try:
        for k, v in forced.items():
            spark.conf.set(k, v)
        got = remove_repeats(X.documents(spark, rows).repartition(12), digest_col="kept_sha256").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert X.multiset((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == X.multiset(X.repeats_removed(rows))
    assert sum(r.n_removed == 0 for r in got if r.doc_id == 7) == 1


def test_windows_are_told_by_bytes():
    """Groups of equal hashes whose windows differ in one byte are split."""
    data = np.frombuffer(b"a" * 64 + b"a" * 63 + b"b" + b"a" * 64 + b"b" + b"a" * 63, np.uint8)
    assert _split_by_bytes(data, np.array([0, 64, 128, 192]), np.zeros(4, np.int64), 64).tolist() == [0, 1, 0, 2]
