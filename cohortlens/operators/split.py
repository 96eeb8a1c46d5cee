"""Splits and folds. All randomness is md5(seed | key): the same on every engine, cluster and run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import running


def seeded(seed: int | str, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_int(seed: int | str, *keys: str) -> Column:
    """32 bits of it."""
    return F.conv(F.substring(seeded(seed, *keys), 1, 8), 16, 10).cast("long")


def stratified_split(units: DataFrame, unit: str, klass: str, seed: int, shares: Sequence[float] = (0.7, 0.15, 0.15), names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Each class is shuffled and cut by rounded shares; val and test get one unit at least, of two units one trains and one tests."""
    one = F.lit(1).cast("long")
    u = running(units.withColumns({"__at": F.struct(seeded(seed, unit), F.col(unit)), "__one": one}), "__at", ["__one"], [klass])
    u = u.withColumns({"__r": F.col("before___one") + 1, "__n": F.col("all___one")}).drop("__at", "__one", "before___one", "all___one")
    n_val, n_test = (F.when(F.col("__n") > 2, F.greatest(F.floor(F.col("__n") * s + 0.5), F.lit(1))) for s in shares[1:])
    n_val, n_test = F.coalesce(n_val, F.lit(0)), F.coalesce(n_test, F.when(F.col("__n") == 2, 1).otherwise(0))
    split = F.when(F.col("__r") <= n_val, names[1]).when(F.col("__r") <= n_val + n_test, names[2]).otherwise(names[0])
    return u.withColumn("split", split).drop("__r", "__n")


def group_folds(groups: DataFrame, group: str, klass: str, seeds: Sequence[int] = (101, 202, 303), k: int = 5) -> DataFrame:
    """Group, repeat, outer_fold: every group is tested once per repeat, classes are spread evenly.

    Groups of a class are shuffled and dealt out in turn; each class begins where its own hash says, so that small
    classes don't all fill the first fold.
    """
    seeds_ = F.explode(F.array(*[F.struct(F.lit(i).alias("repeat"), F.lit(s).alias("seed")) for i, s in enumerate(seeds)]))
    g = groups.select(F.col(group).alias("group"), F.col(klass).alias("klass")).distinct().withColumn("x", seeds_).select("group", "klass", "x.*")
    at = F.struct(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("group").cast("string"))), "group")
    g = running(g.withColumns({"__at": at, "__one": F.lit(1).cast("long")}), "__at", ["__one"], ["repeat", "klass"])
    begin = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("seed").cast("string"), F.col("klass").cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(k))
    return g.select("group", "klass", "repeat", F.pmod(F.col("before___one") + begin, F.lit(k)).cast("int").alias("outer_fold"))


def inner_folds(folds: DataFrame, repeat: int, outer_fold: int, k: int = 3, seed: int = 7) -> DataFrame:
    """Folds of the groups that train in an outer fold."""
    train = folds.filter((F.col("repeat") == repeat) & (F.col("outer_fold") != outer_fold))
    return group_folds(train, "group", "klass", [seed], k).select("group", "klass", F.col("outer_fold").alias("inner_fold"))


def fold_parts(rows: DataFrame, group: str, folds: DataFrame, repeat: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """C17: train and test rows of a fold, by anti and semi join on the group."""
    test = folds.filter((F.col("repeat") == repeat) & (F.col("outer_fold") == fold)).select(F.col("group").alias(group))
    return rows.join(test, group, "left_anti"), rows.join(test, group, "left_semi")


def stamp_folds(rows: DataFrame, group: str, folds: DataFrame) -> DataFrame:
    """Rows of each repeat with their outer fold."""
    return rows.join(folds.select(F.col("group").alias(group), "repeat", "outer_fold"), [group, "repeat"])


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """N rows (of each group), the first by seeded hash."""
    if not by:
        return df.withColumn("__h", seeded(seed, key)).orderBy("__h", key).limit(n).drop("__h")
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy(seeded(seed, key), key))).filter(F.col("__r") <= n).drop("__r")


def group_label(df: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """First label along ``order``, most frequent label (ties: the smallest), and whether labels are mixed."""
    c = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    return c.groupBy(group).agg(F.min_by(label, "o").alias("first_label"), F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias("majority_label"), (F.count(F.lit(1)) > 1).alias("mixed"))


def random_label(df: DataFrame, group: str, key: str, seed: int, k: int) -> Column:
    """A class for each group (for rows without one, for each row) from the seeded hash."""
    unit = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("row:"), F.col(key).cast("string")))
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), unit)), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
