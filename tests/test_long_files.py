"""Files that are read by splits have the md5 of their bytes."""

import hashlib

import numpy as np
import pytest

from cohortlens.sources import io, long_files


def test_chain_goes_on_from_any_state():
    data = np.random.default_rng(1).bytes(5000)
    for blocks in (long_files.plain_blocks, long_files.fast_blocks()):
        for size in (0, 1, 55, 56, 63, 64, 65, 119, 120, 5000):
            for cut in (0, 1, 64, 70, size):
                held = long_files.further(long_files.state(size), data[: min(cut, size)], blocks)
                assert long_files.digest(held, data[min(cut, size) : size], blocks) == hashlib.md5(data[:size]).hexdigest()
    with pytest.raises(ValueError):
        long_files.digest(long_files.state(7), b"short", long_files.plain_blocks)


def test_files_by_splits(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = {"random": rng.bytes(300_000), "ends": rng.bytes(200_000) + b"\n\n", "zeros": bytes(150_000), "lines": b"\n" * 120_000, "marked": b"\xef\xbb\xbf" + rng.bytes(130_000) + b"\r", "marked ends": b"\xef\xbb\xbf" + rng.bytes(140_000) + b"\r\n", "short": b"few"}
    home = tmp_path / "a b%[1]" / "Mild"
    home.mkdir(parents=True)
    for name, data in texts.items():
        (home / f"{name}.bin").write_bytes(data)
    (home / "packed.gz").write_bytes(texts["random"])
    (home / "other.txt").write_bytes(texts["random"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        files = io.scan_files(spark, str(tmp_path), ["bin", "gz"], long=100_000, step=50_000)
        got = {f.stem: (f.bytes, f.file_md5, f.class_name, f.split) for f in files.drop("content").collect()}
        content = {f.stem: bytes(f.content) for f in files.select("stem", "content").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    texts["packed"] = texts["random"]
    assert got == {n: (len(x), hashlib.md5(x).hexdigest(), "Mild", "a b%[1]") for n, x in texts.items()}
    assert content == texts


def test_no_task_takes_a_long_file(spark, tmp_path):
    """The reader of whole files is told to refuse it, as it does over 2 GB."""
    data = np.random.default_rng(3).bytes(400_000)
    (tmp_path / "long.bin").write_bytes(data)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100000")
    try:
        files = io.scan_files(spark, str(tmp_path), ["bin"], long=100_000, step=100_000).select("bytes", "file_md5").collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [tuple(f) for f in files] == [(len(data), hashlib.md5(data).hexdigest())]
