"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All stages keep the columns of their input (sharding adds two). Null and empty texts are scored like any other, have no
near duplicates and no benchmark words, count no words in the mix, and get a shard. Rows that repeat an id stay rows of
their own until the near-duplicate stage, which keeps or drops an id with all its rows. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm import decontamination, mixing, near_dup, quality, sharding
from cohortlens.llm.common import release, stored, table, written

N_SHARDS = 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id."""
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 3 times)."""
    return mixing.mixed(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shuffled shards, with ``shard`` and ``slot``."""
    return sharding.shuffle_into_shards(docs, N_SHARDS)


STAGES = [("quality", quality_stage), ("near_duplicates", near_dup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("sharding", sharding_stage)]
#: SQL can't express the classifier; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows after all stages. Once a stage is written, what it read and the tables between its steps are deleted."""
    docs, earlier = table(spark, sf_dir, "documents"), written(spark)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        release(spark, [p for p in written(spark)[:-1] if p not in earlier])
    return STAGES[-1][1](spark, docs, sf_dir)
