"""Metrics from predictions: all derive from small tables of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import running


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (K * n_c); with two classes neg/pos follows from ``n``."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    every = W.partitionBy()
    return c.select(label, "n", (F.sum("n").over(every).cast("double") / (F.count(F.lit(1)).over(every) * F.col("n"))).alias("weight"))


def majority(df: DataFrame, label: str) -> DataFrame:
    """The most frequent class (ties: the smallest), as one row."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(1).select(F.col(label).alias("majority"))


def unit_probabilities(df: DataFrame, unit: str | Sequence[str], p: str, how: str = "mean", top: int = 8, trim: float = 0.2) -> DataFrame:
    """rows' probability vectors to one per unit, scaled to sum 1: mean, median, trimmed, top (rows by confidence) or logmean.

    One row per unit and class (k, p): a unit's rows are never gathered into one value.
    """
    unit = [unit] if isinstance(unit, str) else list(unit)
    rows = df
    if how == "top":
        rows = rows.withColumn("__r", F.row_number().over(W.partitionBy(*unit).orderBy(F.desc(F.array_max(p)), F.xxhash64(p)))).filter(F.col("__r") <= top)
    x = rows.select(*unit, F.posexplode(p).alias("k", "x"))
    if how == "trimmed":
        w = W.partitionBy(*unit, "k")
        x = x.withColumn("__r", F.row_number().over(w.orderBy("x"))).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__c", F.floor(F.col("__n") * trim))
        x = x.filter((F.col("__r") > F.col("__c")) & (F.col("__r") <= F.col("__n") - F.col("__c")))
    how_ = {"mean": F.avg("x"), "top": F.avg("x"), "trimmed": F.avg("x"), "median": F.percentile("x", 0.5), "logmean": F.exp(F.avg(F.ln(F.greatest("x", F.lit(1e-6)))))}[how]
    g = x.groupBy(*unit, "k").agg(how_.alias("p"))
    return g.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy(*unit)))


def unit_statistics(df: DataFrame, unit: str, p: str) -> DataFrame:
    """Mean, maximum and sample deviation (one row: 0) of each class's probability."""
    x = df.select(unit, F.posexplode(p).alias("k", "x"))
    return x.groupBy(unit, "k").agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("std"))


def confusion(df: DataFrame, y: str, pred: str, classes: Sequence[int]) -> DataFrame:
    """Y, pred, n for all pairs of classes, zeros included."""
    grid = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias("y")).withColumn("pred", F.explode(F.array(*[F.lit(c) for c in classes])))
    n = df.groupBy(F.col(y).cast("int").alias("y"), F.col(pred).cast("int").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of each class, from a confusion table with optional keys ``by``."""
    by = list(by)
    row = cm.groupBy(*by, "y").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    col = cm.groupBy(*by, F.col("pred").alias("y")).agg(F.sum("n").alias("predicted"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = row.join(col, [*by, "y"], "full").na.fill(0, ["support", "tp", "predicted"])
    x = x.withColumn("precision", div(F.col("tp"), F.col("predicted"))).withColumn("recall", div(F.col("tp"), F.col("support")))
    return x.withColumn("f1", div(2 * F.col("tp"), F.col("predicted") + F.col("support"))).select(*by, "y", "precision", "recall", "f1", "support", "predicted")


def classification(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro F1 (classes present in truth or prediction), weighted F1, balanced accuracy (classes in truth)."""
    p = per_class(cm, by)
    there = F.col("support") + F.col("predicted") > 0
    n = F.sum("support")
    return p.groupBy(*by).agg(
        (F.sum(F.col("recall") * F.col("support")) / n).alias("accuracy"), F.avg(F.when(there, F.col("f1"))).alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def kappa(cm: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Quadratic-weighted kappa; NULL if only one class is there."""
    by = list(by)
    w = W.partitionBy(*by)
    marg_y, marg_p, n = F.sum("n").over(W.partitionBy(*by, "y")), F.sum("n").over(W.partitionBy(*by, "pred")), F.sum("n").over(w)
    x = cm.withColumn("e", marg_y * marg_p / n).withColumn("w", F.pow(F.col("y") - F.col("pred"), 2))
    return x.groupBy(*by).agg((1 - F.try_divide(F.sum(F.col("w") * F.col("n")), F.sum(F.col("w") * F.col("e")))).alias("kappa"))


def within_one(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Share of predictions at most one class off."""
    return df.agg(F.avg((F.abs(F.col(pred) - F.col(y)) <= 1).cast("double")).alias("within_one"))


def roc_counts(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives of each distinct score: what ROC figures need, without sorting rows."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney with ties as halves; NULL if a class is absent."""
    c = running(roc_counts(df, y, score, by), "score", ["neg"], by)
    x = c.withColumn("won", F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return x.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_auc_ovr(df: DataFrame, y: str, p: str, weighted: bool = False) -> DataFrame:
    """Each class against the rest; the mean of the defined ones, or weighted by how often a class is true."""
    x = df.select(F.col(y).alias("y"), F.posexplode(p).alias("k", "s")).withColumn("t", (F.col("y") == F.col("k")).cast("int"))
    c = roc_auc(x, "t", "s", ["k"]).join(x.groupBy("k").agg(F.sum("t").alias("n")), "k").filter("auc is not null")
    return c.agg((F.sum(F.col("auc") * F.col("n")) / F.sum("n") if weighted else F.avg("auc")).alias("auc"))


def roc_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rates at each threshold (score >= threshold)."""
    c = running(roc_counts(df, y, score, by), "score", ["neg", "pos"], by, descending=True)
    rate = lambda k: F.try_divide(F.col(f"before_{k}") + F.col(k), F.col(f"all_{k}"))
    return c.select(*by, F.col("score").alias("threshold"), rate("neg").alias("fpr"), rate("pos").alias("tpr"))


def calibration_bins(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Bins (lo, hi] of confidence with count, mean confidence and accuracy; a confidence of 0 is in none."""
    b = F.ceil(F.col(confidence) * bins).cast("int")
    return df.filter(F.col(confidence) > 0).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Sum over bins of share times |accuracy - confidence|."""
    b = calibration_bins(df, confidence, correct, bins).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("n_all"))))  # one row
    return b.agg(F.sum(F.col("n") / F.col("n_all") * F.abs(F.col("accuracy") - F.col("mean_confidence"))).alias("ece"))


def reliability(df: DataFrame, confidence: str, correct: str, least: int = 5) -> DataFrame:
    """The bins with at least ``least`` rows."""
    return calibration_bins(df, confidence, correct).filter(F.col("n") >= least)


def threshold_counts(df: DataFrame, y: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """threshold, tp, fp, fn, tn: one pass; each row is counted once by the number of thresholds it reaches."""
    t = sorted(thresholds)
    reached = F.lit(0)
    for v in t:
        reached = reached + (F.col(score) >= v).cast("int")
    c = df.groupBy(reached.alias("k")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    grid = df.sparkSession.createDataFrame(list(enumerate(t)), "i int, threshold double")
    x = c.crossJoin(F.broadcast(grid))  # as many rows as thresholds, squared
    yes = F.col("k") > F.col("i")
    part = lambda c, v: F.sum(F.when(c, F.col(v)).otherwise(0))
    return x.groupBy("threshold").agg(part(yes, "pos").alias("tp"), part(yes, "neg").alias("fp"), part(~yes, "pos").alias("fn"), part(~yes, "neg").alias("tn"))


def threshold_sweep(df: DataFrame, y: str, score: str, thresholds: Sequence[float], weighted: bool = False) -> DataFrame:
    """F1 of the positive class at each threshold, or of both classes weighted by their rows, and which is the best (the first of equals)."""
    f1 = lambda hit: F.coalesce(F.try_divide(2 * F.col(hit), 2 * F.col(hit) + F.col("fp") + F.col("fn")), F.lit(0.0))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    x = threshold_counts(df, y, score, thresholds).withColumn("f1", (f1("tp") * pos + f1("tn") * neg) / (pos + neg) if weighted else f1("tp"))
    first = F.row_number().over(W.orderBy(F.desc("f1"), "threshold")) == 1
    return x.select("threshold", "tp", "fp", "fn", "f1", first.alias("best"))


def precision_coverage(df: DataFrame, correct: str, margin: str, margins: Sequence[float], target: float) -> DataFrame:
    """Precision and number kept at each least margin; ``chosen``: the first that reaches the target, else the last."""
    x = threshold_counts(df, correct, margin, margins).select(F.col("threshold").alias("margin"), (F.col("tp") + F.col("fp")).alias("kept"), F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"))
    good = F.coalesce(F.col("precision") >= target, F.lit(False))
    first = F.min(F.when(good, F.col("margin"))).over(W.partitionBy())
    return x.withColumn("chosen", F.col("margin") == F.coalesce(first, F.max("margin").over(W.partitionBy())))


def mean_std(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation over repeats; 0 for a single one."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
