"""Shuffling documents into shards: a two-pass external shuffle.

Pass one scatters every record by a seeded hash into buckets that fit in memory; pass two shuffles each bucket with
Fisher-Yates and writes it. The buckets laid end to end are one random order of all rows, which is cut into shards whose
row counts differ by one at most (law ``rows``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch_path, stored, unused

#: Offsets of the buckets are broadcast: 8 bytes each, so 8 MB at most. Beyond it (4 TB) buckets grow, to 100 MB each at 100 TB.
MOST_BUCKETS = 1 << 20


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A uniform permutation of range(n)."""
    order = np.arange(n)
    picks = np.random.default_rng(seed).integers(0, np.arange(n) + 1) if n else []
    for i in range(n - 1, 0, -1):
        j = picks[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffle_into_shards(docs: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = 17, bucket_bytes: int = 4 << 20) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    A bucket is chosen by a seeded hash of the id. One that holds over twice ``bucket_bytes`` (an id that many rows repeat)
    is scattered again by a hash of the whole row. A bucket is sorted by the rows' hashes before Fisher-Yates, so seed and
    rows alone decide: any partitioning or session, and any repeated task, gives the same shards. Only where copies of one whole row
    fill over a bucket they are dealt out by their place in the input, which is stored first. Null ids, null or empty texts
    and repeated rows are rows like any other. Columns of the input that are called shard or slot are replaced; others may
    have any name. No rows: no rows.
    """
    spark = docs.sparkSession
    rows = docs.drop("shard", "slot")
    schema, kept, whole = rows.schema, rows.columns, [F.col(f"`{f.name}`") for f in rows.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    bucket, order = unused("bucket", rows), unused("order", rows)
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8
    total = rows.agg(F.sum(size.cast("long")).alias("n")).first().n or 0
    n = int(min(MOST_BUCKETS, max(1, -(-total // bucket_bytes))))
    limit, ids = 2 * max(bucket_bytes, total // n), n
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(n)).cast("int")).withColumn(order, F.xxhash64(F.lit(seed), *whole))
    for by_row in (True, False):
        # Each of these holds over `limit` bytes, so there are fewer than n / 2.
        full = sorted((r[0], r.b) for r in rows.groupBy(bucket).agg(F.sum(size.cast("long")).alias("b")).filter(F.col("b") > limit).collect())
        if not full:
            break
        first, parts, at = unused("first", rows), unused("parts", rows), []
        for b, held in full:
            at.append((b, ids, -(-held // (limit // 2))))
            ids += at[-1][2]
        again = spark.createDataFrame(at, f"`{bucket}` int, `{first}` int, `{parts}` int")
        place = F.col(order) if by_row else F.monotonically_increasing_id()
        rows = rows.join(F.broadcast(again), bucket, "left").withColumn(bucket, F.coalesce(F.col(first) + F.pmod(F.xxhash64(F.lit(seed), place), F.col(parts)).cast("int"), F.col(bucket))).select(*[f"`{c}`" for c in kept], bucket, order)
        if not by_row:
            rows = stored(rows, "copies")
    held = rows.groupBy(F.col(bucket).alias("b")).count().toPandas()
    counts = np.zeros(ids, np.int64)
    counts[held["b"].to_numpy(dtype=np.int64)] = held["count"].to_numpy(dtype=np.int64)
    starts = spark.sparkContext.broadcast(np.r_[0, np.cumsum(counts)])
    every = int(counts.sum())
    out = T.StructType([*schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(t: pa.Table) -> pa.Table:
        b = t[bucket][0].as_py()
        sorted_ = np.argsort(t[order].to_numpy(), kind="stable")
        t = t.select(kept).take(pa.array(sorted_[fisher_yates(len(t), [seed, b])]))
        place = starts.value[b] + np.arange(len(t))
        shard = place * n_shards // every
        first = -(-shard * every // n_shards)
        return t.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(place - first))

    # Neighbouring buckets go to one task, so that a task writes to few shards.
    return rows.repartitionByRange(n, bucket).groupBy(bucket).applyInArrow(shuffled, out)


def write_shards(sharded: DataFrame, path: str) -> DataFrame:
    """Write the shards, one folder each, and return what is read back."""
    sharded.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)


def op1(spark, docs: DataFrame, n_shards: int = 24) -> DataFrame:
    """All documents put into shards on disk; the digest columns come from the files."""
    back = write_shards(shuffle_into_shards(docs.select("doc_id", "text"), n_shards), scratch_path(spark, "shards"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return back.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
