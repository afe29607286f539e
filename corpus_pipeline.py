"""The corpus pipeline: quality, lines, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality_crf
from quarry.llm.common import settle, table
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.packing import cut, pack
from quarry.llm.simhash import keep_one
from quarry.llm.substring_dedup import remove_repeats


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars set to the characters of the text, where the column is there."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier takes for good, score 0.3 or more; empty texts score 0 and go."""
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model, "__q_score").where(F.col("__q_score") >= 0.3).drop("__q_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the lines that ten documents or more share. A document may end up empty; it stays."""
    return _counted(dedup_lines(docs, min_docs=10, min_chars=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in 0.8 or more of its five-word shingles, that of the smallest id."""
    return keep_one(docs, words=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages of 100 bytes or more that stand earlier.

    A passage may begin or end inside a character; what is left of such a character goes as well.
    """
    out = remove_repeats(docs, window=100, kept_col="__q_kept", counts=("__q_n", "__q_removed", "__q_spans"), as_text=True)
    return _counted(out.withColumn("text", F.col("__q_kept")).drop("__q_kept", "__q_n", "__q_removed", "__q_spans"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents in sequences of at most 2048 tokens."""
    return pack(cut(docs, capacity=2048), capacity=2048)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: The stages aren't expressible in SQL (a trained model, fingerprints, a packing search); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
