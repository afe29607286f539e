"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import quality_crf
from quarry.llm.bpe import decode, encode
from quarry.llm.common import sha256_hex, table, text_of
from quarry.llm.line_dedup import dedup_lines
from quarry.llm.packing import cut, pack
from quarry.llm.quality_rules import STOP_WORDS, judge
from quarry.llm.sharding import shuffle_into_shards
from quarry.llm.simhash import near_duplicates
from quarry.llm.substring_dedup import remove_repeats
from quarry.llm.topk_search import top_k
from quarry.llm.url_filter import judge_urls, url_sql


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in eight shuffled shards; row counts differ by one at most."""
    out = shuffle_into_shards(table(spark, sf_dir, "documents"), shards=8)
    text = text_of("text")
    return out.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by the line model, learnt outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"))
    out = quality_crf.score(docs, model)
    return out.select("doc_id", quality_crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash over four-word shingles and the least doc_id that links of 4 bits reach."""
    out = near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict for every document."""
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(table(spark, sf_dir, "documents")).select(*names)


OP6_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_intersect(list_distinct(list_transform(words, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))), {[*STOP_WORDS]})) AS stop_words,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 20 AND word_chars / n BETWEEN 2.0 AND 14.0 AND n_symbols / n <= 0.1 AND n_shouts / n <= 0.3
       AND n_upper / greatest(word_chars, 1) <= 0.5 AND stop_words >= 1 AND n_dup_lines / greatest(n_lines, 1) <= 0.3 AS kept
FROM b
"""


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes in 100-byte strings that stand earlier: counts and the digest of what stays."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=100, digest_col="kept_sha256")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP7_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 200)) AS w FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS s FROM d)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS n FROM w) WHERE n > 1),
brk AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS k FROM dup),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM (SELECT doc_id, s, sum(k) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM brk) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM runs),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS stop, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup at ten documents: counts of lines and the digest of what stays."""
    out = dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256_hex(text_of("text")).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT (doc_id, md5(text))) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines,
       (count(*) FILTER (WHERE k IN (SELECT k FROM shared)))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM shared)), '')) AS kept_sha256
FROM keyed GROUP BY r, doc_id
"""


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return pack(cut(table(spark, sf_dir, "documents"), capacity=2048), capacity=2048)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again: number of tokens, digests of ids and of decoded bytes."""
    name = "byte_bpe_multi_50k.tiktoken"
    out = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), name).drop("text"), name)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), sha256_hex(F.col("ids")).alias("ids_sha256"), sha256_hex(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sharding, op2_quality_classifier, op3_url_filters, op4_topk_search, op5_simhash_near_dedup, op6_quality_rules, op7_suffix_array_dedup, op8_line_dedup, op9_best_fit_packing, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filters": url_sql(), "op4_topk_search": OP4_SQL, "op6_quality_rules": OP6_SQL, "op7_suffix_array_dedup": OP7_SQL, "op8_line_dedup": OP8_SQL}
