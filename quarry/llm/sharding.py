"""Seeded global shuffle into shards by a two-pass external shuffle.

First pass: every record goes to one of many buckets by a seeded hash of its content; a bucket is
sized to fit a task's memory. Second pass: each bucket is read whole, put into a canonical order
and permuted by a seeded Fisher-Yates shuffle. Bucket after bucket, this is one random order of
all records; its places are dealt to the shards in turn, so that row counts differ by one at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.common import settle, tidy

HASH, BUCKET, PART, START, PLACE, TO = "__q_hash", "__q_bucket", "__q_part", "__q_start", "__q_place", "__q_to"
#: A power of two above any number of parts that one bucket is split into; buckets whose sizes are added up together.
PARTS, CHUNK = 1 << 20, 4096


def _seeded(docs: DataFrame, seed: int) -> Column:
    """A hash of the seed and the whole record (columns that can't be hashed aside)."""
    cols = [f"`{f.name}`" for f in docs.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed).cast("long"), *cols)


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A seeded permutation of range(n); numpy's permutation is a Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64(seed)).permutation(n)


def _starts(sizes: DataFrame) -> DataFrame:
    """(bucket, part, start): the place where each part begins, from (bucket, part, n); added up by chunks of buckets, then in each."""
    chunk = F.floor(F.col(BUCKET) / CHUNK).alias("chunk")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chunks = sizes.groupBy(chunk).agg(F.sum("n").alias("n"))
    first = chunks.select("chunk", before(Window.orderBy("chunk")).alias("first"))
    inside = sizes.withColumn("chunk", chunk).withColumn("at", before(Window.partitionBy("chunk").orderBy(BUCKET, PART)))
    return inside.join(first, "chunk").select(BUCKET, PART, (F.col("first") + F.col("at")).alias(START))


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 42, bucket_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """docs in a seeded random order: all columns, and shard (0 to shards - 1) and slot (gapless from 0).

    The same records, seed and parameters give the same shards, whatever the partitions of docs.
    Nulls are hashed like values; an empty table gives an empty one. Repeated records fall into one
    bucket; where a bucket has more than twice bucket_bytes beside its largest record, its records
    are stored with a number each and spread over parts by these (which of them comes where then
    depends on the order in which they were stored). A single record above bucket_bytes still is
    one record. Columns of docs named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 64
    (total,) = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_bytes))
    base = docs.withColumn(HASH, _seeded(docs, seed)).withColumn(BUCKET, F.pmod(HASH, F.lit(buckets))).withColumn(PART, F.lit(0).cast("long"))
    sizes = settle(base.groupBy(BUCKET, PART).agg(F.count(F.lit(1)).alias("n"), (F.sum(size) - F.max(size)).alias("bytes")))
    hot = sizes.where(F.col("bytes") > 2 * bucket_bytes).select(BUCKET, F.least(F.ceil(F.col("bytes") / bucket_bytes), F.lit(PARTS - 1)).alias("__q_parts"))
    sizes = sizes.drop("bytes")
    if not hot.isEmpty():
        heavy = settle(base.join(hot, BUCKET).withColumn(PLACE, F.monotonically_increasing_id()))
        names = [f"`{c}`" for c in base.columns]
        heavy = heavy.withColumn(PART, F.pmod(F.xxhash64(HASH, PLACE), F.col("__q_parts"))).select(*names)
        base = base.join(hot, BUCKET, "left_anti").select(*names).unionAll(heavy)
        sizes = sizes.join(hot, BUCKET, "left_anti").select(BUCKET, PART, "n").unionAll(heavy.groupBy(BUCKET, PART).agg(F.count(F.lit(1)).alias("n")))
    heads = settle(_starts(sizes))
    tasks = int(min(buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-buckets // 4))))
    # neighbouring buckets to a task, the parts of a hot one to one task after another; each part's start comes before its records
    rows = base.withColumn(START, F.lit(None).cast("long")).unionByName(heads, allowMissingColumns=True)
    to = F.pmod(F.floor(F.col(BUCKET) * tasks / buckets) + F.col(PART), F.lit(tasks)).cast("int")
    dealt = rows.withColumn(TO, to).repartitionById(tasks, TO).drop(TO).sortWithinPartitions(BUCKET, PART, F.isnull(START))
    schema = T.StructType([*docs.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    own = len(docs.columns)

    def permute(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held)
        h = whole.column(HASH).to_numpy()[1:]
        b = whole.column(BUCKET)[0].as_py() * PARTS + whole.column(PART)[0].as_py()
        order = np.argsort(h, kind="stable")[fisher_yates(len(h), (seed * 1_000_003 + b) & (2**63 - 1))]
        place = whole.column(START)[0].as_py() + np.arange(len(h))
        out = whole.slice(1).select(range(own)).take(pa.array(order))
        out = out.append_column("shard", pa.array(place % shards, pa.int32())).append_column("slot", pa.array(place // shards, pa.int64()))
        yield from out.to_batches(max_chunksize=4096)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            cuts = [*np.flatnonzero(b.column(b.schema.get_field_index(START)).is_valid().to_numpy(zero_copy_only=False)).tolist(), b.num_rows]
            if cuts[0]:
                held.append(b.slice(0, cuts[0]))
            for at, end in zip(cuts, cuts[1:], strict=False):
                if held:
                    yield from permute(held)
                held = [b.slice(at, end - at)]
        if held:
            yield from permute(held)

    return dealt.mapInArrow(tidy(run), schema)


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write shuffle_into_shards(docs, ...) as Parquet, one folder a shard."""
    shuffle_into_shards(docs, **options).write.partitionBy("shard").parquet(path)
