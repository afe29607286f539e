"""Rule-based quality filter: one threshold table compiled into one projection.

Everything is built-in column expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, UPPER, lower_ascii, text_of

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "the of and to in is that for it was on are with as be by this from at or an a "
    "le la les de des et en un une que du pour dans est qui sur au par "
    "el los las del y se por con para una su es lo "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine"
).split()

#: The table: measure, smallest and largest value allowed (None: open). See measures().
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 20, None),
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.1),
    ("shouts_per_word", None, 0.3),
    ("upper_share", None, 0.5),
    ("stop_words", 1, None),
    ("dup_line_share", None, 0.3),
)
#: Words of a window: three doublings.
WINDOW = 8


def _split_words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _count_of(text: Column, chars: str) -> Column:
    """How many of these characters there are; a few go by replacement, which is a search for bytes."""
    rest = text
    for c in chars if len(chars) < 10 else ():
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.length(text) - F.length(rest if len(chars) < 10 else F.translate(text, chars, ""))).cast("long")


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measures of every whole text; a null text counts as empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words inside 8-word windows that
    stand twice or more in the text, the first ones included) and n_lines (lines with a word),
    stop_words (different ones present), n_upper (A-Z) and n_shouts (exclamation marks).
    Columns of docs that bear one of these names are replaced. Intermediate arrays stand in
    columns of their own, each read more than once by what follows: the optimizer then computes
    them once a row instead of copying them into the lambdas.
    """
    t = text_of(text_col)
    df = docs.withColumn("__q_w", _split_words(t))
    df = df.withColumn("n_words", F.size("__q_w").cast("long")).withColumn("__q_h", F.transform("__q_w", lambda w: F.xxhash64(w)))
    for step, (of, to) in zip((1, 2, 4), zip(("__q_h", "__q_h2", "__q_h4"), ("__q_h2", "__q_h4", "__q_win"), strict=True), strict=True):
        # hashes of two, four and eight words, each of two neighbours of the last kind
        n = F.greatest(F.size(of) - step, F.lit(0))
        df = df.withColumn(to, F.zip_with(F.slice(of, 1, n), F.slice(of, 1 + step, n), lambda x, y: F.xxhash64(x, y)))
    win = F.col("__q_win")
    ordered = F.sort_array(F.transform(win, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    df = df.withColumn("__q_s", F.when(F.size(F.array_distinct(win)) < F.size(win), ordered))
    s = F.col("__q_s")
    twice = F.filter(s, lambda e, j: (F.get(s, j + 1)["x"] == e["x"]) | ((j > 0) & (F.get(s, j - F.least(j, F.lit(1)))["x"] == e["x"])))
    df = df.withColumn("__q_p", F.sort_array(F.transform(twice, lambda e: e["i"])))
    p = F.col("__q_p")
    reach = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long"))
    df = df.withColumn("__q_l", F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    return df.withColumns(
        {
            "word_chars": F.length(F.array_join("__q_w", "")).cast("long"),
            "n_symbols": _count_of(t, "#*$%&|<>"),
            "n_lines": F.size("__q_l").cast("long"),
            "n_dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
            "stop_words": F.size(F.array_intersect(_split_words(lower_ascii(t)), F.array(*map(F.lit, STOP_WORDS)))).cast("long"),
            "n_upper": _count_of(t, UPPER),
            "n_shouts": _count_of(t, "!"),
        }
    ).drop("__q_w", "__q_h", "__q_h2", "__q_h4", "__q_win", "__q_s", "__q_p", "__q_l")


def judge(docs: DataFrame, thresholds=THRESHOLDS, text_col: str = "text") -> DataFrame:
    """docs with measures(), base_failed and kept.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: not
    base_failed and every row of the table holds; a ratio without a denominator counts as 0.
    """
    df = measures(docs, text_col)
    n = F.greatest(F.col("n_words"), F.lit(1))
    ratio = {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "shouts_per_word": F.col("n_shouts") / n,
        "upper_share": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "stop_words": F.col("stop_words"),
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }
    holds = F.lit(True)
    for name, low, high in thresholds:
        if low is not None:
            holds = holds & (ratio[name] >= low)
        if high is not None:
            holds = holds & (ratio[name] <= high)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & holds)
