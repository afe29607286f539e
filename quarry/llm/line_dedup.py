"""Drop lines that many documents share.

Normalised lines are exploded and hashed, the distinct documents of each hash are counted, and
the lines whose hash reaches the threshold go. The texts themselves never leave their rows until
one join brings the positions of their dropped lines back; lines are then put together again by
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, lower_ascii, settle, text_of

ROW, AGAIN, POS, KEY, GONE, LINES, KEPT = "__q_row", "__q_row2", "__q_pos", "__q_key", "__q_gone", "__q_lines", "__q_kept"


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with every line dropped whose key is found in min_docs documents or more.

    Lines are what stands between newlines. Keys of fewer than min_chars code points never count.
    A document is a distinct pair of id and text: repeated rows count once, rows that share an id
    but not a text count each, null ids are ids like any other. A null text stays null and has one
    empty line; a text that loses all lines becomes empty. All columns of docs stay; counts names
    two more for the lines before dropping and the dropped lines.
    """
    text = text_of(text_col)
    # 128 bits name a row's id and text
    base = docs.withColumns({ROW: F.xxhash64(F.col(id_col), F.col(text_col)), AGAIN: F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col))})
    lines = base.select(ROW, AGAIN, F.posexplode(F.split(text, "\n", -1)).alias(POS, KEY)).withColumn(KEY, line_key(F.col(KEY))).where(F.length(KEY) >= min_chars).withColumn(KEY, F.unhex(F.md5(KEY)))
    lines = settle(lines)  # 36 bytes a line: less than normalising and hashing all of them twice
    shared = settle(lines.groupBy(KEY).agg(F.count_distinct(ROW, AGAIN).alias("n")).where(F.col("n") >= min_docs).select(KEY))
    gone = settle(lines.join(shared, KEY).groupBy(ROW, AGAIN).agg(F.collect_list(POS).alias(GONE)))
    # merged at every size: a broadcast would only hold while few lines go
    out = base.join(gone.hint("merge"), [ROW, AGAIN], "left").withColumn(LINES, F.split(text, "\n", -1))
    every = F.sequence(F.lit(0), F.size(LINES) - 1)
    # size(LINES) stands beside the lambda so that the split isn't inlined into it
    out = out.withColumn(KEPT, F.when(F.col(GONE).isNotNull(), F.array_except(every, GONE)))
    kept = F.array_join(F.transform(F.col(KEPT), lambda i: F.get(F.col(LINES), i)), "\n")
    dropped = F.coalesce(F.size(LINES) - F.size(F.when(F.col(KEPT).isNotNull(), F.col(KEPT))), F.lit(0))
    more = {} if counts is None else {counts[0]: F.size(LINES).cast("long"), counts[1]: F.when(F.col(KEPT).isNull(), 0).otherwise(dropped).cast("long")}
    return out.withColumns({text_col: F.when(F.col(KEPT).isNull(), F.col(text_col)).otherwise(kept), **more}).drop(ROW, AGAIN, GONE, LINES, KEPT)
