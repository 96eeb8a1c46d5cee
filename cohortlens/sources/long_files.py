"""MD5 of files that are too long for a cell or a task.

An MD5 is a chain over a file's bytes. Tasks read the file by splits; then the chain goes on from task to task, each of which
takes ``step`` bytes of a file and hands on its state. Only the chain of one file is sequential; files go on side by side.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import math
import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import release, stored_at

# Bytes of a cell between the steps, and of the rows that a Parquet writer holds.
CELL, HELD = 256 << 10, 16 << 20
# Fixed value: endings that Spark's text reader unpacks.
PACKED = ["gz", "bz2", "zst", "lz4", "snappy", "deflate", "zlib"]
# Fixed value: a mark that Spark's text reader leaves out at the begin of a file.
MARK = b"\xef\xbb\xbf"
BEGIN = struct.pack("<4I", 0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def plain_blocks(words: bytes, data: bytes) -> bytes:
    """The four words of an MD5 after more blocks of 64 bytes."""
    state = struct.unpack("<4I", words)
    for x in struct.iter_unpack("<16I", data):
        a, b, c, d = state
        for i in range(64):
            if i < 16:
                f, g = (b & c) | (~b & d), i
            elif i < 32:
                f, g = (d & b) | (~d & c), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | (~d & 0xFFFFFFFF)), 7 * i % 16
            f = (f + a + _ADDED[i] + x[g]) & 0xFFFFFFFF
            r = _TURNS[i // 16][i % 4]
            a, d, c, b = d, c, b, (b + ((f << r) | (f >> (32 - r)))) & 0xFFFFFFFF
        state = tuple((s + t) & 0xFFFFFFFF for s, t in zip(state, (a, b, c, d), strict=True))
    return struct.pack("<4I", *state)


def fast_blocks() -> Callable[[bytes, bytes], bytes]:
    """``plain_blocks`` by OpenSSL, whose MD5 can be continued (``hashlib``'s can't be handed on); without OpenSSL the plain form, some hundred times slower."""
    try:
        update = ctypes.CDLL(ctypes.util.find_library("crypto")).MD5_Update
    except (OSError, AttributeError, TypeError):
        return plain_blocks
    update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]

    def blocks(words: bytes, data: bytes) -> bytes:
        # The context begins with the words; counts and bytes left over, all zero here, follow.
        context = ctypes.create_string_buffer(words, 256)
        update(context, data, len(data))
        return context.raw[:16]

    return blocks if digest(state(5), b"chain", blocks) == hashlib.md5(b"chain").hexdigest() else plain_blocks


def state(size: int) -> bytes:
    """Words, bytes so far, bytes of the whole file, and what isn't a block yet."""
    return BEGIN + struct.pack("<2Q", 0, size)


def further(held: bytes, data: bytes, blocks: Callable[[bytes, bytes], bytes]) -> bytes:
    """The state after more bytes; what is beyond the file (an added line end) is left out."""
    done, size = struct.unpack("<2Q", held[16:32])
    data = data[: size - done]
    rest = held[32:] + data
    cut = len(rest) // 64 * 64
    return (blocks(held[:16], rest[:cut]) if cut else held[:16]) + struct.pack("<2Q", done + len(data), size) + rest[cut:]


def digest(held: bytes, data: bytes, blocks: Callable[[bytes, bytes], bytes]) -> str:
    """The MD5 of the file, whose last bytes are ``data``."""
    held = further(held, data, blocks)
    done, size = struct.unpack("<2Q", held[16:32])
    if done != size:
        raise ValueError(f"{done} of {size} bytes were read")
    rest = held[32:] + b"\x80"
    return blocks(held[:16], rest + bytes(-(len(rest) + 8) % 64) + struct.pack("<Q", size * 8 & (1 << 64) - 1)).hex()


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a split as cells in order; a split lies in one task."""
    place = 0
    for b in batches:
        file, start = b.column("file").to_numpy(), b.column("start").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1), len(file)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            data = b"".join(b.column("data").slice(lo, hi - lo).to_pylist())
            parts = [data[i : i + CELL] for i in range(0, len(data), CELL)]
            n = len(parts)
            if n:
                yield pa.RecordBatch.from_pydict({"file": pa.array([int(file[lo])] * n, pa.int32()), "start": pa.array([int(start[lo])] * n, pa.int64()), "place": pa.array(range(place, place + n), pa.int64()), "n": pa.array([len(p) for p in parts], pa.int64()), "data": pa.array(parts, pa.binary())})
            place += n


def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, of each file its state first: the state after its cells."""
    blocks, now, held = fast_blocks(), None, b""
    row = lambda: pa.RecordBatch.from_pydict({"file": pa.array([now], pa.int32()), "start": pa.array([-1], pa.int64()), "place": pa.array([0], pa.int64()), "data": pa.array([held], pa.binary())})
    for b in batches:
        for file, start, data in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), b.column("data"), strict=True):
            if start >= 0:
                held = further(held, data.as_py(), blocks)
                continue
            if now is not None:
                yield row()
            now, held = file, data.as_py()
    if now is not None:
        yield row()


def long_md5(spark: SparkSession, path: str, files: Sequence[tuple[str, int]], wanted: Column, step: int) -> DataFrame:
    """file, file_md5 of these (``_metadata.file_path``, bytes) below ``path``; ``wanted`` tells them by ``_metadata``.

    Lines are the only pieces of any file that Spark reads by splits. Their bytes are as in the file, but that the mark at the
    begin of a file is left out and the last line may have got an end: both are told by the file's length.
    """
    number = spark.createDataFrame([(f, i) for i, (f, _) in enumerate(files)], "path string, file int")
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path).filter(wanted)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"))
    lines = lines.join(F.broadcast(number), "path").select("file", "start", "data")
    split = lines.mapInArrow(cells, "file int, start long, place long, n long, data binary").withColumn("step", F.floor(F.col("start") / step).cast("int"))
    split, at = stored_at(split, "file-cells", ["step"], {"parquet.block.size": str(HELD)})
    found = {r.file: r.n for r in split.groupBy("file").agg(F.sum("n").alias("n")).collect()}
    begin, blocks = [], fast_blocks()
    for i, (f, size) in enumerate(files):
        missing = size - found.get(i, 0)
        if missing not in (-1, 0, 2, 3):
            raise ValueError(f"{f}: {size} bytes, {found.get(i, 0)} read")
        begin.append((i, -1, 0, further(state(size), MARK if missing > 0 else b"", blocks)))
    schema = "file int, start long, place long, data binary"
    held, old = spark.createDataFrame(begin, schema), None
    for k in range(max(size for _, size in files) // step + 1):
        rows = split.filter(F.col("step") == k).select("file", "start", "place", "data").unionByName(held)
        rows = rows.repartition(min(2000, 4 * len(files)), "file").sortWithinPartitions("file", "start", "place")
        held, new = stored_at(rows.mapInArrow(chained, schema), "file-states")
        release(spark, [old] if old else [])
        old = new
    release(spark, [at])
    last = [(files[r.file][0], digest(r.data, b"", blocks)) for r in held.collect()]
    release(spark, [old])
    return spark.createDataFrame(last, "__file string, file_md5 string")
