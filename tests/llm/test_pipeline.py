"""The corpus pipeline, stage by stage, each against its brute-force version on its own input."""

import pytest

import corpus_pipeline as C
from quarry.llm.common import settle

from . import fixtures as X
from . import test_jaccard as J


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in C.STAGES:
        after = settle(f(spark, docs, sf))
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert after.columns == before.columns or name == "packing"


def test_quality(stages, spark, sf):
    before, after = stages["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {i for i, _ in pairs(after)}
    known = [(i in kept, labels[i]) for i, _ in pairs(before) if i in labels]
    assert sum(k == bool(q) for k, q in known) / len(known) > 0.9 and set(pairs(after)) <= set(pairs(before))


def test_lines(stages):
    before, after = stages["lines"]
    want = {i: (n, d, s) for i, n, d, s in X.lines_dropped(pairs(before))}
    assert {i: X.sha(t) for i, t in pairs(after)} == {i: s for i, (_, _, s) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_duplicates(stages):
    """One document of each group that Jaccard similarity of 0.8 or more connects, by comparing all pairs."""
    before, after = stages["near_duplicates"]
    want, links = J.kept(pairs(before))
    assert links > 5 and sorted(i for i, _ in pairs(after)) == want


def cut_out(rows, window=100):
    """The texts without repeated windows, as bytes; then without what is left of cut characters."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                gone[s : s + window] = b"x" * window
            seen.add(b[s : s + window])
        out[i] = bytes(c for c, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_repeats(stages):
    before, after = stages["repeats"]
    assert dict(pairs(after)) == cut_out(pairs(before))
    assert sum(a != b for a, b in zip(sorted(pairs(before)), sorted(pairs(after)), strict=True)) > 5


def test_packing(stages):
    before, after = stages["packing"]
    rows = after.collect()
    assert {r.doc_id for r in rows} == {i for i, _ in pairs(before)}
    total = {}
    for r in rows:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 2048 and len(total) <= sum(total.values()) / 2048 + 2


def test_run_and_odd_documents(spark, sf, tmp_path):
    assert C.run(spark, sf).count() > 0
    docs = X.documents(spark)
    for name, f in C.STAGES[1:]:
        docs = settle(f(spark, docs, sf))
        assert docs.count() > 0, name
    for _, f in C.STAGES:
        assert f(spark, X.documents(spark, []), sf).count() == 0
