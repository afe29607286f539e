"""Links of near-duplicate classes against all pairs compared."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import links
from quarry.llm.links import links_between, near_links, set_of
from quarry.llm.shingles import shingle_hashes
from quarry.operators.similarity import MinHash
from quarry.plans import queries as plans


def corpus():
    """(doc_id, text): a large group of near copies, pairs about the limit, copies, a common passage, empty texts, an id of two rows."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    out, base, common = [], [word() for _ in range(120)], [word() for _ in range(40)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(120)] = word()
        out.append(" ".join(w))
    for k in range(60):
        w = [word() for _ in range(60 + k)]
        out += [" ".join(w), " ".join([*w[: len(w) - len(w) // 11], *(word() for _ in range(len(w) // 11))]), " ".join([*common, *w[:15]])]
    out += [out[0], out[60].upper(), "", None, " \n", "one two", "one  TWO", "a b c d e", "a a a a a a a"]
    rows = [(100 + i, x) for i, x in enumerate(out)]
    return [*rows, (5000, "x1 x2 x3 x4 x5 x6"), (5000, ""), (5001, "x1 x2 x3 x4 x5 x6")]


def expected(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, set()).update(shingle_hashes(t, 5).tolist() or [0])
    least = {}
    for i in sorted(sets):
        least.setdefault(frozenset(sets[i]), i)
    of = {i: sum(a != b and 9 * len(a & b) >= 4 * (len(a) + len(b)) for b in least) for a, i in least.items()}
    return sorted((i, least[frozenset(s)], of[least[frozenset(s)]]) for i, s in sets.items())


@pytest.mark.parametrize("block", [7, 1024])
def test_all_links(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "COLUMNS", 50)
    monkeypatch.setattr(links, "RUN", block)
    rows = corpus()
    want = expected(rows)
    assert max(k for *_, k in want) > links.SHORT and sum(0 < k <= 2 for *_, k in want) > 20
    assert sorted(map(tuple, near_links(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == want


def test_no_link_depends_on_bands(spark, sf, monkeypatch):
    """The query finds the same links when no MinHash signatures agree in a band."""
    want = sorted(map(tuple, plans.QUERIES["doc_near_duplicates"](spark, sf).collect()))
    none = lambda self, rows: self.state.select(*[F.col(self.by[0]).alias(c) for c in "ab"], F.lit(0).alias("matches")).limit(0)
    monkeypatch.setattr(MinHash, "candidates", none)
    assert any(k for *_, k in want) and sorted(map(tuple, plans.QUERIES["doc_near_duplicates"](spark, sf).collect())) == want


@pytest.mark.parametrize("step", [0, 10**9])
def test_pair_by_pair_and_matrix(monkeypatch, step):
    """Both ways to decide give what brute force gives."""
    monkeypatch.setattr(links, "STEP", step)
    sets = [set_of([t], 5) for _, t in corpus()]
    p, q = sets[:150], sets[90:]
    want = [[9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)) for b in q] for a in p]
    assert np.any(want) and links_between(p, q).tolist() == want


def test_few_pairs_make_no_matrix(monkeypatch):
    """Sets of a group that mostly can't be alike are decided pair by pair."""
    monkeypatch.setattr(links, "_linked", lambda p, q: pytest.fail("a matrix of all sets"))
    word = [[f"w{k} {i}" for i in range(2000)] for k in range(100)]
    sets = [set_of([" ".join(w[:n])], 5) for w in word for n in (2000, 1900)]
    assert np.array_equal(links_between(sets, sets), np.kron(np.eye(100), np.ones((2, 2))).astype(bool))
