"""Small documents with every odd case, and brute-force versions of the operators."""

import hashlib
import random
import re

import numpy as np
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=None, extra=()):
    """rows: (doc_id, text). extra: more columns, to clash with an operator's own."""
    rows = ROWS if rows is None else rows
    schema = SCHEMA + "".join(f", `{c}` string" for c in extra)
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *("kept" for _ in extra)) for i, t in rows], schema).repartition(3)


def _rows():
    rng = random.Random(5)
    words = ["the", "of", "and", "to", "été", "naïve", "word", "Longer-Word,", "BE", "中文", "x.", "42"]
    passage = " ".join(rng.choices(words, k=80))
    out = []
    for i in range(60):
        k = rng.random()
        if k < 0.35:
            t = "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(rng.randint(1, 6)))
        elif k < 0.5:
            t = rng.choice(["be ", "a", "abc", "\n", "of the "]) * rng.randint(0, 300)
        elif k < 0.65 and out:
            t = rng.choice(out)[1]
        elif k < 0.8:
            w = passage.split()
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        else:
            t = f"own {i} " + passage[rng.randint(0, 40) : rng.randint(150, 400)] + "\nShared line.\n  shared LINE. \n" + str(i)
        out.append((i, t))
    out += [(60, None), (61, ""), (62, " \t\n "), (None, passage), (None, None), (63, "long " * 20_000), out[3], out[3], (7, "another text of an id that is there")]
    out += [(100 + i, f"{i} first\nShared line.\n{i} last") for i in range(12)]
    return out


ROWS = _rows()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def lines_dropped(rows, least=10):
    key = lambda l: "".join(c.lower() if "A" <= c <= "Z" else c for c in l.strip(" \t\n\x0b\x0c\r"))
    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            where.setdefault(key(line), set()).add((i, t))
    gone = {k for k, v in where.items() if k and len(v) >= least}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if key(x) not in gone]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def simhash(text, words=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
    count = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x, 42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(s))


def simhash_components(rows, radius=4):
    f = [simhash(t) for _, t in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= radius:
                group[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, f"{f[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)]


def repeats_removed(rows, window=100):
    seen, out = set(), []
    order = lambda r: (-(2**63) if r[0] is None else r[0], sha(r[1] or ""))
    for i, t in sorted(rows, key=order):
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, np.int64)
        for s in range(len(b) - window + 1):
            if b[s : s + window] in seen:
                mark[s] += 1
                mark[s + window] -= 1
            seen.add(b[s : s + window])
        gone = np.cumsum(mark)[: len(b)] > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def rule_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for v in grams.values() if len(v) > 1 for i in v for k in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def multiset(rows):
    return sorted(map(repr, rows))
