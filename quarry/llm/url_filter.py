"""URL filter: host and path rules first, logistic regression on hashed character n-grams else.

Scoring is one projection of built-in expressions. The model is fitted on the driver from a small
labelled table of at most MAX_LABELLED rows; its weights are integers, so that a score is the same
on every engine and in every order of addition.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii

MAX_LABELLED = 10_000
BUCKETS = 1 << 14
#: Multipliers of the three code points of an n-gram, and what is added for host and path.
MIX, HOST_SALT, PATH_SALT = (961, 31, 1), 7, 2053
SCALE = 1 << 20

#: (host, path, action). A rule holds for its host and all subdomains, for paths that start with its path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Rules that are compiled into the projection; longer lists are joined by host suffix.
MAX_RULES = 1_000


def labelled_urls(part: str | None = None) -> list[tuple[str, int]]:
    """The small labelled table (url, 1 for unwanted) beside this module; part "train" or "held_out": without or only the fifth whose crc32 is divisible by 5."""
    rows = [line.split("\t") for line in files("quarry.llm").joinpath("labelled_urls.tsv").read_text().splitlines()[1:]]
    want = {None: (True, False), "held_out": (True,), "train": (False,)}[part]
    return [(url, int(y)) for y, url in rows if (zlib.crc32(url.encode()) % 5 == 0) in want]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, as the expressions below make them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:stop]


def _features(url: str) -> Counter:
    out: Counter = Counter()
    for s, salt in zip(split_url(url), (HOST_SALT, PATH_SALT), strict=True):
        c = [ord(x) for x in s]
        out.update((c[i] * MIX[0] + c[i + 1] * MIX[1] + c[i + 2] * MIX[2] + salt) % BUCKETS for i in range(len(c) - 2))
    return out


def fit(labelled: Iterable[tuple[str, int]], rounds: int = 150, rate: float = 0.05, decay: float = 1e-3) -> tuple[int, list[int]]:
    """Bias and weights of a logistic regression as integers, SCALE being 1. Rows with a null url or label are left out."""
    rows = [(_features(u), int(y)) for u, y in labelled if u is not None and y is not None]
    if len(rows) > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    w, bias = [0.0] * BUCKETS, 0.0
    for _ in range(rounds):
        for x, y in rows:
            z = bias + sum(w[k] * n for k, n in x.items())
            g = y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
            bias += rate * g
            for k, n in x.items():
                w[k] += rate * (g * n - decay * w[k])
    return round(bias * SCALE), [round(v * SCALE) for v in w]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or #, A-Z lower-cased; path: then up to ? or #. Null or without :// : both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring_index(F.substring(url, at + 3, F.length(url)), "#", 1)).otherwise(F.lit(""))
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    return lower_ascii(F.substring_index(rest, "/", 1)), F.regexp_extract(rest, r"^[^/]*([\s\S]*)$", 1)


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none fits."""
    name = action = F.lit(None).cast("string")
    for h, p, a in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0], r[1])):  # the last that fits wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(a)).otherwise(action)
    return name, action


def _join_rules(df: DataFrame, rules: DataFrame) -> DataFrame:
    """df (with __q_host and __q_path) with __q_name and __q_action of the longest rule (host, path, action) that fits.

    Each different host and path is judged once: its host's suffixes are joined with the rules'
    hosts. A rule's host meets all urls under it, for each of its paths.
    """
    labels = F.split("__q_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = df.select("__q_host", "__q_path").distinct().withColumn("__q_suffix", F.explode(suffixes))
    r = rules.select(F.col("host").alias("__q_suffix"), F.col("path").alias("__q_p"), F.col("action").alias("__q_a"))
    best = F.max(F.struct((F.length("__q_suffix") + F.length("__q_p")).alias("n"), "__q_suffix", "__q_p", "__q_a")).alias("__q_r")
    found = asked.join(r, "__q_suffix").where(F.col("__q_path").startswith(F.col("__q_p"))).groupBy("__q_host", "__q_path").agg(best)
    name = F.concat("__q_r.__q_suffix", "__q_r.__q_p")
    return df.join(found, ["__q_host", "__q_path"], "left").withColumns({"__q_name": name, "__q_action": F.col("__q_r.__q_a")}).drop("__q_r")


def _adder(table: Column, salt: int):
    return lambda acc, g: acc + F.get(table, F.pmod(g + salt, F.lit(BUCKETS)))


def score(host: Column, path: Column, model: tuple[int, list[int]]) -> Column:
    """The model's integer score; over 0: unwanted."""
    bias, weights = model
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<bigint>")  # folded to a literal
    total = F.lit(bias).cast("long")
    for s, salt in ((host, HOST_SALT), (path, PATH_SALT)):
        n = F.greatest(F.size(s) - 2, F.lit(0))
        pairs = F.zip_with(F.slice(s, 1, n), F.slice(s, 2, n), lambda a, b: a * MIX[0] + b * MIX[1])
        grams = F.zip_with(pairs, F.slice(s, 3, n), lambda ab, c: ab + c * MIX[2])
        total = total + F.aggregate(grams, F.lit(0).cast("long"), _adder(table, salt))
    return total


def judge_urls(pages: DataFrame, rules=RULES, labelled: Iterable[tuple[str, int]] | DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (allow or block).

    A null url, or one without ://, has an empty host and path; no rule fits it and the model sees
    no n-gram. rules: (host, path, action) rows or a DataFrame of these; a DataFrame, or over
    MAX_RULES of them, is joined by host suffix, fewer are compiled into the projection. labelled:
    pairs or a DataFrame (url, label 1 for unwanted), of MAX_LABELLED rows at most (more raise).
    Columns of pages that bear one of the four names are replaced.
    """
    if isinstance(labelled, DataFrame):
        labelled = [tuple(r) for r in labelled.select("url", "label").limit(MAX_LABELLED + 1).collect()]
    model = fit(labelled_urls() if labelled is None else labelled)
    host, path = host_path(F.col(url_col))
    names = ["__q_host", "__q_path", "__q_name", "__q_action", "__q_hc", "__q_pc"]
    df = pages.withColumns({"__q_host": host, "__q_path": path})
    if not isinstance(rules, DataFrame) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame(list(rules), "host string, path string, action string")
    if isinstance(rules, DataFrame):
        df = _join_rules(df, rules)
    else:
        name, action = _rule(F.col("__q_host"), F.col("__q_path"), rules)
        df = df.withColumns({"__q_name": name, "__q_action": action})
    chars = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: F.length(x) > 0), lambda x: F.ascii(x))
    df = df.withColumns({"__q_hc": chars(F.col("__q_host")), "__q_pc": chars(F.col("__q_path"))})
    method = F.when(score(F.col("__q_hc"), F.col("__q_pc"), model) > 0, "block").otherwise("allow")
    out = {"host": F.col("__q_host"), "path": F.col("__q_path"), "rule": F.col("__q_name"), "verdict": F.coalesce("__q_action", method)}
    return df.drop(*out).withColumns(out).drop(*names)


def url_sql(rules=RULES) -> str:
    """The same verdicts in SQL, over the table pages."""
    bias, weights = fit(labelled_urls())
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r[0], r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[0], r[1])} THEN '{r[2] if k else r[0] + r[1]}'" for r in longest) + " END"
    grams = lambda c, salt: f"coalesce(list_sum(list_transform(range(1, length({c}) - 1), lambda i: w[((unicode({c}[i]) * {MIX[0]} + unicode({c}[i + 1]) * {MIX[1]} + unicode({c}[i + 2]) * {MIX[2]} + {salt}) % {BUCKETS} + 1)::BIGINT])), 0)"
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
model AS (SELECT {weights} AS w)
SELECT page_id, host, path, {case(0)} AS rule,
       coalesce({case(1)}, CASE WHEN {bias} + {grams('host', HOST_SALT)} + {grams('path', PATH_SALT)} > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM parts, model
"""
