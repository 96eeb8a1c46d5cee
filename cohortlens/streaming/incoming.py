"""Incoming records as a stream: the same projections as in batch, with rejects, snapshots and one result per id."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean


def incoming(spark: SparkSession, path: str, schema: T.StructType, names: Mapping[str, str], id_column: str, files_per_batch: int = 4) -> DataFrame:
    """JSON lines of a folder as they come, renamed (B2) and with an id for every record."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return clean.surrogate_id(clean.rename_aliases(raw, names), id_column)


def run_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there now to Parquet and stop; a second call goes on where the first stopped."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def each_batch(df: DataFrame, checkpoint: str, put: Callable[[DataFrame, int], None]) -> None:
    df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def score_and_emit(df: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """The batch projection applied to the stream, results appended."""
    run_now(score(df), path, checkpoint)


def with_rejects(df: DataFrame, required: Sequence[str], good: str, bad: str, checkpoint: str) -> None:
    """Rows with a value in one of ``required`` to one folder, the others to another. A batch that runs again replaces what it wrote."""

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows, empty = clean.split_empty_rows(batch, required)
        rows.write.mode("overwrite").parquet(f"{good}/batch={number}")
        empty.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    each_batch(df, checkpoint, put)


def latest_snapshot(df: DataFrame, path: str, checkpoint: str) -> None:
    """I4: the folder holds the last non-empty micro-batch."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(path)

    each_batch(df, checkpoint, put)


def once_per_id(df: DataFrame, id_column: str, time: str, delay: str = "1 hour") -> DataFrame:
    """An id counts once within the watermark."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([id_column])


def windowed_counts(df: DataFrame, time: str, by: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts per tumbling window; late rows are dropped after ``delay``."""
    return df.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
