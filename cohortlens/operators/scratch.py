"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; unset, as in tests, a temporary folder in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='cohortlens-')}")
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and read it back: nothing above is computed twice, and a lost executor costs tasks."""
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str, by: Sequence[str] = (), options: Mapping[str, str] | None = None) -> tuple[DataFrame, str]:
    """``stored``, and where it lies, for ``release``; ``by``: a folder for each value."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path, partitionBy=list(by) or None)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these tables of the session, all if ``paths`` is left out; only when whatever reads them has been written."""
    mine = _written.get(spark.sparkContext.applicationId, [])
    for p in list(mine) if paths is None else paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        mine.remove(p)
