"""The corpus operators against brute force, on documents with nulls, blanks, copies, ties and long texts."""

import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import bpe, jaccard, quality_crf, simhash, url_filter
from quarry.llm import queries as Q
from quarry.llm.components import components
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.packing import best_fit, cut, local_search, pack
from quarry.llm.quality_rules import judge
from quarry.llm.sharding import fisher_yates, shuffle_into_shards, write_shards
from quarry.llm.substring_dedup import anchors, remove_repeats, union_of
from quarry.llm.topk_search import top_k

from . import fixtures as X
from . import test_jaccard as J


@pytest.fixture(scope="module")
def docs(spark):
    return X.documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return X.documents(spark, [])


# ------------------------------------------------------------------ 1 sharding

def test_shards(spark, docs, none, tmp_path):
    out = shuffle_into_shards(docs, shards=8, bucket_bytes=20_000)
    rows = out.collect()
    assert X.multiset((r.doc_id, r.text) for r in rows) == X.multiset(X.ROWS)
    sizes = [sorted(r.slot for r in rows if r.shard == k) for k in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    place = lambda df: X.multiset((r.doc_id, r.text, r.shard, r.slot) for r in df.collect())
    assert place(out) == place(shuffle_into_shards(docs.repartition(7), shards=8, bucket_bytes=20_000))
    assert place(out) != place(shuffle_into_shards(docs, shards=8, bucket_bytes=20_000, seed=1))
    assert shuffle_into_shards(none).count() == 0
    write_shards(X.documents(spark, extra=("shard", "slot")), str(tmp_path / "out"), shards=4)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


def test_one_bucket_of_repeated_rows(spark):
    df = X.documents(spark, [(1, "same text " * 10)] * 500 + [(2, "other")])
    rows = shuffle_into_shards(df, shards=3, bucket_bytes=2_000).collect()
    assert sorted((r.shard, r.slot) for r in rows) == sorted((i % 3, i // 3) for i in range(501))


def test_fisher_yates_is_uniform():
    first = [fisher_yates(10, s)[0] for s in range(2000)]
    assert max(abs(first.count(k) - 200) for k in range(10)) < 75 and fisher_yates(0, 1).size == 0


# ------------------------------------------------------------------ 2 quality classifier

def test_marginals_are_exact():
    import itertools
    import math

    rng = np.random.default_rng(0)
    stay = (0.7, -0.3)
    for n in (1, 2, 5):
        x = rng.normal(size=n)
        weights = {y: math.exp(sum(a * b for a, b in zip(y, x, strict=True)) + sum(stay[u] for u, v in zip(y, y[1:], strict=False) if u == v)) for y in itertools.product((0, 1), repeat=n)}
        want = [sum(w for y, w in weights.items() if y[k]) / sum(weights.values()) for k in range(n)]
        assert np.allclose(quality_crf.marginals(list(x), stay), want)


def test_expected_neighbours_are_exact():
    """Sequences of several lengths at once against the sum over all labellings."""
    import itertools
    import math

    rng, stay, lengths = np.random.default_rng(1), np.array([0.7, -0.3]), [4, 3, 3, 1]
    odds = [rng.normal(size=n) for n in lengths]
    live = [sum(n > k for n in lengths) for k in range(4)]
    good, same = quality_crf._expectations(np.concatenate([[odds[j][k] for j in range(m)] for k, m in enumerate(live)]), live, stay)
    want, pairs = {}, np.zeros(2)
    for j, x in enumerate(odds):
        weight = {y: math.exp(sum(a * b for a, b in zip(y, x, strict=True)) + sum(stay[u] for u, v in zip(y, y[1:], strict=False) if u == v)) for y in itertools.product((0, 1), repeat=len(x))}
        total = sum(weight.values())
        for k in range(len(x)):
            want[k, j] = sum(w for y, w in weight.items() if y[k]) / total
        for c in (0, 1):
            pairs[c] += sum(w * sum(u == v == c for u, v in zip(y, y[1:], strict=False)) for y, w in weight.items()) / total
    assert np.allclose(good, [want[k, j] for k, m in enumerate(live) for j in range(m)]) and np.allclose(same, pairs)


def test_classifier_on_held_out(spark):
    """Accuracy on the fifth of the labelled documents that training never saw."""
    d = "/root/testdata/sf0.01"
    out = Q.op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and sum(r.predicted == r.quality for r in out) / len(out) >= 0.97
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out)


def test_classifier_edges(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(docs, labels)
    rows = quality_crf.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == len(X.ROWS) and all(r.score == 0.0 for r in rows if not (r.text or "").split()) and all(0 <= r.score <= 1 for r in rows)
    assert quality_crf.score(none, quality_crf.train(none, labels.limit(0))).count() == 0


def test_scores_see_the_text_alone(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = quality_crf.train(X.documents(spark), labels)
    a, b = (quality_crf.score(X.documents(spark, [(i, "The same words of a text.")]), model).first().score for i in (1, 999))
    assert a == b


# ------------------------------------------------------------------ 3 URL filter

URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.NET/en/x?y", "http://example.net/EN/", "http://a.example.com/de/1#f", "http://xexample.com/de/", "http://x.org/fr/?q", "http://org/fr/", "http://x.org?/fr/", "https://casino.example.com/poker/slots/1", "https://news.example.com/en/history", "ftp://é.org/ü", "a://b://c.net/", "http://x.net", "http://" + "x" * 3000 + ".com/" + "y" * 30_000, "http://h.com#/x"]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    bias, weights = url_filter.fit(url_filter.labelled_urls())
    for r in url_filter.judge_urls(df).collect():
        host, path = url_filter.split_url(r.url)
        fits = [(len(h + p), h + p, a) for h, p, a in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        total = bias + sum(weights[k] * n for k, n in url_filter._features(r.url or "").items())
        want = (max(fits)[1], max(fits)[2]) if fits else (None, "block" if total > 0 else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *want)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_long_rule_lists_are_joined(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] * 2, "page_id long, url string")
    many = [*url_filter.RULES, *((f"host{i}.test", f"/p{i}/", "block") for i in range(url_filter.MAX_RULES))]
    rows = lambda rules: X.multiset((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, rules).collect())
    assert rows(many) == rows(url_filter.RULES) and rows(spark.createDataFrame(many, "host string, path string, action string")) == rows(url_filter.RULES)


def test_url_model_on_held_out_rows():
    """Trained without the held-out fifth of the table, measured on it alone."""
    train, rest = url_filter.labelled_urls("train"), url_filter.labelled_urls("held_out")
    assert not set(train) & set(rest) and len(rest) > 25
    bias, w = url_filter.fit(train)
    hit = lambda u: bias + sum(w[k] * n for k, n in url_filter._features(u).items()) > 0
    caught, wrong = [hit(u) for u, y in rest if y], [hit(u) for u, y in rest if not y]
    assert sum(caught) >= 0.7 * len(caught) and sum(wrong) <= 0.1 * len(wrong)
    with pytest.raises(ValueError):
        url_filter.fit([("http://a.b/", 1)] * (url_filter.MAX_LABELLED + 1))


def test_url_model_on_pages(spark):
    """Hosts of the generated pages that say what they are: words of spam against all others, where no rule decides."""
    said = re.compile("spam|casino|pills|bets|ads-|adult")
    rows = Q.op3_url_filters(spark, "/root/testdata/sf0.1").where("rule IS NULL AND host <> ''").collect()
    bad, good = ([r.verdict == "block" for r in rows if bool(said.search(r.host)) == k] for k in (True, False))
    assert len(bad) > 50 and sum(bad) >= 0.9 * len(bad) and sum(good) < 0.01 * len(good)


# ------------------------------------------------------------------ 4 exact top-k

@pytest.mark.parametrize("block", [16 << 20, 1024])
def test_top_k(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(300)]
    rows += [(300 + i, rows[40][1]) for i in range(30)]  # ties
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (480, [1.0, 2.0]), (481, [3.0, -1.0]), (500, []), (None, [1.0] * 8), (501, [1e15, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    good = [(i, np.floor(np.array(v) * 64).astype(object)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 20 == 0:
            s = sorted(((-int(sum(int(a) * int(b) for a, b in zip(v, w, strict=True))), i) for i, w in good if i != q and len(w) == len(v)))[:7]
            want += [(q, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    got = [tuple(r) for r in top_k(df, k=7, block_bytes=block).collect()]
    assert sorted(got) == sorted(want)
    assert top_k(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 5 SimHash

@pytest.mark.parametrize("chain", [None, 3, 5])
def test_simhash_components(spark, docs, none, chain):
    got = [(r.id, format(r.f0 % 2**64, "016x"), r.component_id) for r in simhash.near_duplicates(docs, chain=chain).collect()]
    want = X.simhash_components(X.ROWS)
    assert X.multiset(got) == X.multiset(want)
    assert simhash.near_duplicates(none).count() == 0


def test_runs_over_many_gathered_pieces(spark, docs, monkeypatch):
    """Tasks gather rows in pieces; runs that lie across pieces, or are longer than one, lose nothing."""
    monkeypatch.setattr(simhash, "GATHER", 16)
    monkeypatch.setattr(simhash, "LONG_RUN", 6)
    monkeypatch.setattr(jaccard, "GATHER", 16)
    monkeypatch.setattr(jaccard, "ALL", 3)
    monkeypatch.setattr(jaccard, "CELL", 4)
    got = [(r.id, format(r.f0 % 2**64, "016x"), r.component_id) for r in simhash.near_duplicates(docs, chain=1).collect()]
    assert X.multiset(got) == X.multiset(X.simhash_components(X.ROWS))
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = [(i, " ".join(J.edited(rng, base, rng.choice([0, 1, 2, 3])) + [f"own{i}-{k}" for k in range(rng.choice([0, 0, 3, 40]))])) for i in range(90)]
    assert sorted(r.doc_id for r in simhash.keep_one(X.documents(spark, rows)).collect()) == J.kept(rows)[0]


@pytest.mark.parametrize(("radius", "chain"), [(4, 1), (4, 2), (4, 3), (4, 4), (4, 5), (8, 3), (2, 2)])
def test_pigeonring_loses_nothing(radius, chain):
    """Every pair within the radius shares a key of a start from which the chain holds."""
    rng = np.random.default_rng(1)
    ring = simhash.Ring(radius, chain)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for j in range(len(a)):
        for k in rng.choice(64, rng.integers(0, radius + 1), replace=False):
            b[j] ^= np.uint64(1) << np.uint64(k)
    hit = np.zeros(len(a), bool)
    for i, mask in ring.keys:
        ok = np.zeros(len(a), bool)
        ok[ring.holds(a ^ b, np.full(len(a), i))] = True
        hit |= ok & ((ring.turned(a, i) & mask) == (ring.turned(b, i) & mask))
    assert hit.all()


def linked(f, pairs):
    """The groups of positions that pairs connect."""
    group = list(range(len(f)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        group[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(f))]


def within(f, radius):
    return [(a, b) for a in range(len(f)) for b in range(a) if (int(f[a]) ^ int(f[b])).bit_count() <= radius]


def ball(rng, n):
    """Fingerprints within a few bits of each other, whose first 13 bits are equal."""
    base = int(rng.integers(0, 2**63)) * 2
    return np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(51, rng.integers(0, 7), replace=False)) for _ in range(n)], np.uint64))


def test_long_runs_are_searched():
    """Many fingerprints under one key: links found connect exactly what all pairs connect there."""
    ring = simhash.Ring(4, 1)
    for seed in range(5):
        f = ball(np.random.default_rng(seed), 120)
        start, mask = ring.keys[0]
        assert len(np.unique(ring.turned(f, start) & mask)) == 1
        a, b = simhash._join_runs(np.zeros(len(f), np.uint64), f, ring)
        inside = [(x, y) for x, y in within(f, 4) if len(ring.holds(f[[x]] ^ f[[y]], np.array([start])))]
        assert len(f) > simhash.SHIFTS and linked(f, zip(a.tolist(), b.tolist(), strict=True)) == linked(f, inside) and len(set(linked(f, inside))) < len(f)
        assert all((int(f[x]) ^ int(f[y])).bit_count() <= 4 for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("most", [3, 20, 10_000])
def test_long_runs_are_dealt_again(spark, most):
    rng = np.random.default_rng(9)
    f = np.unique(np.concatenate([ball(rng, 150), ball(rng, 60), rng.integers(0, 2**63, 100, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "f0 long")
    at = {int(x): k for k, x in enumerate(f.view(np.int64))}
    got = [(at[r.u], at[r.v]) for r in simhash.link_fingerprints(df, 4, chain=1, most=most).collect()]
    assert linked(f, got) == linked(f, within(f, 4)) and all((int(f[a]) ^ int(f[b])).bit_count() <= 4 for a, b in got)


def test_keys_grow_with_the_table():
    bits = [simhash.Ring(4, simhash.chain_for(n, 4)).key_bits for n in (10, 10**6, 10**8, 10**10)]
    assert bits == sorted(bits) and all(n < 16 << b for n, b in zip((10**6, 10**8, 10**10), bits[1:], strict=True))


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(5, 5)]
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            group[max(x, y)] = min(x, y)
    got = {r.node: r.least for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in group}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [rng.choices(words, k=120) for _ in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:10]):
        near = list(t)
        near[60] = "changed"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(t))]
    rows += [(5, rows[5][1]), (None, "a null id"), (None, "a null id")]
    got = X.multiset((r.doc_id, r.text) for r in simhash.keep_one(X.documents(spark, rows, extra=("component",))).collect())
    assert got == X.multiset([*rows[:30], (None, "a null id")])


# ------------------------------------------------------------------ 6 quality rules

def test_rules(spark, docs, none):
    got = judge(X.documents(spark, extra=("kept", "n_words"))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert X.multiset((r.doc_id, *(r[n] for n in names)) for r in got) == X.multiset((i, *X.rule_measures(t)) for i, t in X.ROWS)
    assert not any(r.kept and r.base_failed for r in got) and judge(none).count() == 0


def test_rules_keep_clean_text(spark):
    clean = "The history of the town and of its people is told in this book, which was written by one who knew it well and for a long time."
    shout = "BUY NOW!! CHEAP!! THE BEST!! " * 1 + " ".join(f"WORD{i}!!" for i in range(30))
    got = {r.doc_id: r.kept for r in judge(X.documents(spark, [(1, clean), (2, shout), (3, clean.replace(" ", " ### "))])).collect()}
    assert got == {1: True, 2: False, 3: False}


# ------------------------------------------------------------------ 7 repeated substrings

def test_repeats(spark, docs, none):
    out = remove_repeats(X.documents(spark, extra=("n_bytes", "start")), digest_col="kept_sha256")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert X.multiset(got) == X.multiset(X.repeats_removed(X.ROWS)) and "start" in out.columns
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [1, 5])
def test_repeats_of_hot_digits(docs, hot):
    out = remove_repeats(docs, digest_col="kept_sha256", hot=hot)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()]
    assert X.multiset(got) == X.multiset(X.repeats_removed(X.ROWS))


def test_repeats_as_text(spark):
    rows = [(1, "ab" + "é" * 120), (2, "x" + "é" * 70 + "y"), (3, None)]
    got = {r.doc_id: r.kept for r in remove_repeats(X.documents(spark, rows), as_text=True).collect()}
    assert got == {1: got[1], 2: "xy", 3: None} and got[1].startswith("ab")


@given(st.lists(st.sampled_from([b"a", b"be ", b"xyz", b"longer piece of text ", b"\xc3\xa9"]), max_size=120), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_anchors_depend_on_the_window_alone(parts, skip):
    text = b"".join(parts)
    whole, moved = anchors(text, 100), anchors(b"#" * skip + text, 100)
    offset = {}
    for p, a, b in zip(whole[1], whole[2], whole[3], strict=True):
        offset.update({s: p - s for s in range(a, b + 1)})
    assert sorted(offset) == list(range(max(0, len(text) - 99))) and all(0 <= o <= 68 for o in offset.values())
    for p, a, b in zip(moved[1], moved[2], moved[3], strict=True):
        assert all(offset[s - skip] == p - s for s in range(max(a, skip), b + 1))


def test_union():
    assert union_of(np.array([5, 0, 20]), np.array([9, 6, 30])) == [(0, 9), (20, 30)]


# ------------------------------------------------------------------ 8 line dedup

def test_lines(spark, docs, none):
    out = dedup_lines(X.documents(spark, extra=("n", "line")), counts=("n_lines", "n_dropped"))
    got = [(r.doc_id, r.n_lines, r.n_dropped, X.sha(r.text or "")) for r in out.collect()]
    assert X.multiset(got) == X.multiset(X.lines_dropped(X.ROWS)) and sum(r[2] for r in got) > 12
    assert dedup_lines(none).count() == 0
    high = dedup_lines(docs, min_docs=1000)
    assert X.multiset((r.doc_id, r.text) for r in high.collect()) == X.multiset(X.ROWS)


# ------------------------------------------------------------------ 9 packing

def test_best_fit_and_search():
    rng = random.Random(8)
    for low, high in ((300, 900), (600, 1300), (1, 2048)):
        lengths = [rng.randint(low, high) for _ in range(1500)]
        first = best_fit(lengths, 2048)
        fill = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
        start = fill(first)
        bins = local_search([list(b) for b in first], lengths, 2048)
        assert sorted(i for b in bins for i in b) == list(range(1500)) and max(sum(lengths[i] for i in b) for b in bins) <= 2048
        assert len(bins) <= len(first) and fill(bins) >= start
    assert best_fit([], 10) == [] and local_search([], [], 10) == []


def test_search_empties_bins():
    """First fit left three bins where two do."""
    lengths = [6, 3, 5, 5, 1]
    assert len(local_search([[0, 1], [2], [3, 4]], lengths, 10)) == 2


def test_packing(spark, docs, none):
    name = "byte_bpe_50k.json"
    got = pack(cut(docs, capacity=64), capacity=64, group_pieces=300).collect()
    want = []
    for i, text in X.ROWS:
        ids = [*bpe.load(name).encode(text or "", add_special_tokens=False).ids, 0]
        ends = list(range(len(ids), 0, -64))[::-1]
        want += [(i, k, (s := ends[k - 1] if k else 0), e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, e in enumerate(ends)]
    assert X.multiset((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == X.multiset(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in got) / 64 + 2 and pack(cut(none)).count() == 0


ALPHABET = ["a", "aa", "e", " ", "  ", "\n", "\t", "é", "中文", "😀", "1", "23", "'s", "'ll", "!", "...", "the", "THE", "\r\n", "<|endoftext|>", "x\u0301", " a", "\u00a0", "\u2003", "ſ", "İ"]


JSON = bpe.Encoder("byte_bpe_50k.json")


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), max_size=6))
@settings(max_examples=300, deadline=None)
def test_memoised_ids_are_the_librarys(texts):
    assert [np.frombuffer(x, bpe.IDS).tolist() for x in JSON(texts)] == [bpe.load("byte_bpe_50k.json").encode(t, add_special_tokens=False).ids for t in texts]


def test_search_of_short_pieces_is_small():
    """Thousands of short pieces: no pairs are stored, and no bin can go."""
    tracemalloc.start()
    lengths = [3] * 16_384
    bins = local_search(best_fit(lengths, 2048), lengths, 2048)
    assert len(bins) == -(-16_384 // (2048 // 3)) and tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=300, deadline=None)
def test_search_ends_where_no_step_helps(lengths):
    """No move, one-for-one or two-for-one swap is left that would increase the squared fill, unless the bins are as few as can be."""
    bins = local_search(best_fit(lengths, 40), lengths, 40)
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(fill, default=0) <= 40
    if len(bins) == -(-sum(lengths) // 40):
        return
    for x, b in enumerate(bins):
        for y, c in enumerate(bins):
            if x != y and fill[x] < 40 and fill[y] < 40:
                sums = {0, *(lengths[i] for i in c), *(lengths[i] + lengths[j] for i in c for j in c if i < j)}
                for i in b:
                    for n in sums:
                        d = lengths[i] - n
                        assert not (d > 0 and fill[y] + d <= 40 and fill[y] + d > fill[x])


# ------------------------------------------------------------------ 10 byte-level BPE

MULTI = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})


def test_bpe(spark, docs, none, tik):
    out = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("old")), MULTI, with_offsets=True), MULTI)
    for r in out.collect():
        ids = np.frombuffer(r.ids, bpe.IDS).tolist()
        assert ids == tik.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        whole = bpe.load(MULTI).encode(r.text or "", add_special_tokens=False)
        assert list(zip(r.ids_from, r.ids_to, strict=True)) == whole.offsets
    assert bpe.encode(none, MULTI).count() == 0


@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join), max_size=6))
@settings(max_examples=200, deadline=None)
def test_bpe_on_odd_texts(texts):
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    got = _ENCODER(texts)
    assert [np.frombuffer(x, bpe.IDS).tolist() for x in got] == [tik.encode_ordinary(t) for t in texts]
    assert [bpe.decode_bytes(x, MULTI) for x in got] == [t.encode() for t in texts]


_ENCODER = bpe.Encoder(MULTI)


def test_byte_table():
    assert sorted(bpe.char_to_byte().values()) == list(range(256)) and bpe.byte_to_char()[ord("A")] == "A" and bpe.byte_to_char()[32] == "Ġ"


def test_split_characters_decode():
    ids = np.frombuffer(bpe.Encoder(MULTI)(["𐍈"])[0], bpe.IDS)
    assert len(ids) > 1
    assert b"".join(bpe.decode_bytes(ids[k : k + 1].tobytes(), MULTI) for k in range(len(ids))) == "𐍈".encode()


# ------------------------------------------------------------------ queries by brute force

@pytest.fixture(scope="module")
def odd(docs, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    docs.write.parquet(f"{d}/documents.parquet")
    return str(d)


def test_op1(spark, odd):
    rows = Q.op1_sharding(spark, odd).collect()
    want = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in X.ROWS]
    assert X.multiset((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == X.multiset(want)
    slots = [sorted(r.slot for r in rows if r.shard == k) for k in range(8)]
    assert sum(map(len, slots)) == len(X.ROWS) and all(x == list(range(len(x))) for x in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1


def test_op9(spark, odd):
    rows = Q.op9_best_fit_packing(spark, odd).collect()
    want, bins = [], {}
    for i, t in X.ROWS:
        ids = [*bpe.load("byte_bpe_50k.json").encode(t or "", add_special_tokens=False).ids, 0]
        ends = list(range(len(ids), 0, -2048))[::-1]
        want += [(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())) for k, (s, e) in enumerate(zip([0, *ends], ends, strict=False))]
    assert X.multiset((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == X.multiset(want)
    for r in sorted(rows, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048 and len(bins) <= sum(bins.values()) / 2048 + 2


def test_op10(spark, odd, tik):
    want = []
    for i, t in X.ROWS:
        ids = tik.encode_ordinary(t or "")
        want.append((i, len(ids), X.sha(np.array(ids, "<u4").tobytes()), X.sha((t or "").encode())))
    assert X.multiset(tuple(r) for r in Q.op10_byte_bpe(spark, odd).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == X.multiset(want)


# ------------------------------------------------------------------ queries and SQL

@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = Q.queries()[name](spark, sf).toPandas(), c.sql(Q.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    rows = lambda f: sorted(repr([None if v != v else v for v in r]) for r in f[cols].astype(object).values.tolist())
    assert cols == sorted(want.columns) and rows(got) == rows(want)
