"""Near duplicates against brute-force Jaccard similarity of five-word shingles."""

import random

from quarry.llm import simhash

from . import fixtures as X


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def kept(rows):
    """The ids that stay, by comparing all pairs, and the number of links."""
    s, group, links = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}, 0

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in s:
        for b in s:
            if a < b and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]):
                links += 1
                group[max(top(a), top(b))] = min(top(a), top(b))
    return sorted({top(i) for i in s}), links


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"e{rng.random()}"
    return out


def test_pairs_near_the_limit_are_found_and_no_others(spark):
    rng = random.Random(11)
    rows, at = [], []
    for i in range(150):
        t = rng.choices([f"w{k}" for k in range(2000)], k=300)
        rows += [(i, " ".join(t)), (1000 + i, " ".join(edited(rng, t, 4 + i % 5)))]
        at.append(similarity(shingles(rows[-2][1]), shingles(rows[-1][1])))
    assert sum(0.8 <= x < 0.85 for x in at) > 20 and sum(0.7 < x < 0.8 for x in at) > 20
    want, _ = kept(rows)
    assert sorted(r.doc_id for r in simhash.keep_one(X.documents(spark, rows)).collect()) == want


def test_large_groups(spark):
    """Long runs: near copies of one text that are alike only through some of them, beside a passage that all share."""
    rng = random.Random(12)
    base, passage = ([f"{p}{k}" for k in range(150)] for p in "ab")
    rows = [(i, " ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4])))) for i in range(150)]
    rows += [(200 + i, " ".join([*passage, *(f"u{i}-{k}" for k in range(rng.choice([10, 30, 50, 100])))])) for i in range(100)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "three short words"), (404, "Three short WORDS")]
    want, links = kept(rows)
    assert 50 < len(want) < 200 and links > 1000
    assert sorted(r.doc_id for r in simhash.keep_one(X.documents(spark, rows)).collect()) == want


def test_a_repeated_shingle_makes_no_near_duplicates(spark):
    """Shingles are sets: a shingle that makes up most of two different texts counts once."""
    rows = [(i, "same " * 200 + " ".join(f"own{i}-{k}" for k in range(100))) for i in range(4)]
    assert kept(rows) == ([0, 1, 2, 3], 0)
    assert sorted(r.doc_id for r in simhash.keep_one(X.documents(spark, rows)).collect()) == [0, 1, 2, 3]
