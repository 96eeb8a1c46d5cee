"""Shared pieces of the training-data operators: scratch tables, packed columns, byte-level words."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+` as a Java or Python pattern.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``); unset, as in tests, a temporary one in local mode alone. ``release`` deletes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/cohortlens-{uuid.uuid4().hex}")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The tables and files of this session in the shared folder that ``release`` has not deleted, in the order of writing."""
    return list(_written.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete such tables, all of them if ``paths`` is left out. Only when whatever reads them has been written or is no longer needed."""
    conf, kept = spark.sparkContext._jsc.hadoopConfiguration(), _written.get(spark.sparkContext.applicationId, [])
    for p in written(spark) if paths is None else paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        kept.remove(p)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Texts can be long: at most so many rows, and about so many bytes, go to a Python task at once."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key)
        if not (now.lstrip("-").isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name in taken:
        name += "_"
    return name


def text_bytes(df: DataFrame, text: str) -> int:
    return df.select(F.sum(F.octet_length(F.col(text))).alias("n")).first().n or 0


def parts_for(df: DataFrame, text: str, bytes_per_part: int, total: int | None = None) -> int:
    """How many parts of about ``bytes_per_part`` the texts make; at least the session's shuffle partitions."""
    total = text_bytes(df, text) if total is None else total
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / bytes_per_part))


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, one after the other (null: none), and the n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays([c.cast(pa.large_binary()) for c in column.chunks]) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return data, offs - offs[0]


def slices(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least: bounds the memory of what follows."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_rng = np.random.default_rng(20240229)
#: A random odd base, a random value for each byte.
BASE = int(_rng.integers(1 << 62, 1 << 63)) | 1
BYTES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64)
GRAM = _rng.integers(0, 1 << 63, 8, dtype=np.uint64) | np.uint64(1)
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 21)
        for k, b in (("up", BASE), ("down", INVERSE)):
            a = np.full(m, b, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running polynomial sums over the bytes; see ``range_hash``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * up[: len(data)], out=out[1:])
    return out


def range_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    _, down = powers(len(run))
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def word_ranges(data: np.ndarray, offs: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (byte offsets) and row of each word; ``separator``: 256 flags of the bytes between words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    gap = separator[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = gap[:-1]
    after[:-1] = gap[1:]
    start = np.flatnonzero(~gap & (before | edge[:n]))
    end = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """The columns cut by bucket, each cut as plain bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    columns = [c[order] for c in columns]
    for s, e in zip(cut, np.r_[cut[1:], len(b)], strict=True):
        yield int(b[s]), [c[s:e].tobytes() for c in columns]


def unpack(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """One array of what many packed values hold."""
    data, _ = flat(column)
    return np.frombuffer(data.tobytes(), dtype)


def might_hold(df: DataFrame, key: str):
    """A filter function for long columns: true for all values of ``df[key]`` and for few others.

    A bit for each hash, 16 bits for each distinct value and 2^28 (32 MB) at most; a fuller filter lets more through,
    nothing less.
    """
    bits = min(28, max(20, math.ceil(math.log2(16 * df.select(F.approx_count_distinct(key)).first()[0] + 1))))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))

    def filled(t: pa.Table) -> pa.Table:
        flags = np.zeros(1 << 20, bool)
        flags[t["bit"].to_numpy() & ((1 << 20) - 1)] = True
        return pa.table({"block": t["block"][:1], "data": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    held = df.select(place(F.col(key)).alias("bit")).distinct().withColumn("block", F.shiftright("bit", 20).cast("int"))
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in held.groupBy("block").applyInArrow(filled, "block int, data binary").toLocalIterator():
        out[r.block << 17 : (r.block + 1) << 17] = np.frombuffer(r.data, np.uint8)
    sent = df.sparkSession.sparkContext.broadcast(out)

    @F.arrow_udf("boolean")
    def look(bit: pa.Array) -> pa.Array:
        b = bit.to_numpy(zero_copy_only=False)
        return pa.array((sent.value[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool))

    return lambda c: look(place(c))
