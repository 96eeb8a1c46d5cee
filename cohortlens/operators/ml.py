"""Models on Spark ML. Every fit takes the training frame alone; what it learnt is applied to other frames."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from functools import partial
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import GBTClassifier, DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import ordinal_probabilities
from .metrics import class_weights, classification
from .order import numbered, running
from .similarity import nearest
from .split import seeded_int

# Rows of a part at least, and fits of a search that run side by side.
ROWS, FITS = 4096, 4


def vectors(df: DataFrame, column: str, to: str = "features") -> DataFrame:
    """An array column as an ML vector."""
    return df.withColumn(to, array_to_vector(F.transform(F.col(column), lambda x: x.cast("double"))))


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns as one vector."""
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="skip").transform(df)


def weighted(train: DataFrame, label: str = "label") -> DataFrame:
    """D31 as a weight column; as many classes as there are rows in the weights."""
    return train.join(F.broadcast(class_weights(train, label).select(label, "weight")), label)


def classifier(kind: str, n_train: int = 1000, label: str = "label", weight: str | None = None, n_classes: int = 2, seed: int = 0, **options) -> Estimator:
    """H1-H8 by name. ``C`` is the inverse regularisation per row, as in common libraries; kinds for two classes only are wrapped one against the rest."""
    common = {"labelCol": label, "featuresCol": "features"} | ({"weightCol": weight} if weight else {})
    c = options.pop("C", 1.0)
    if kind == "logistic":
        return LogisticRegression(regParam=1 / (c * n_train), **{"elasticNetParam": 0.0, "maxIter": 50} | options, **common)
    if kind == "svm":
        svc = LinearSVC(regParam=1 / (c * n_train), **{"maxIter": 20} | options, **common)
        return svc if n_classes == 2 else OneVsRest(classifier=svc, **common)
    if kind == "naive_bayes":
        return NaiveBayes(modelType="gaussian", **options, **common)
    if kind == "tree":
        return DecisionTreeClassifier(seed=seed, **options, **common)
    if kind == "forest":
        return RandomForestClassifier(seed=seed, **{"numTrees": 20} | options, **common)
    if kind == "boosting":
        gbt = GBTClassifier(seed=seed, **{"maxIter": 10, "maxDepth": 3} | options, **common)
        return gbt if n_classes == 2 else OneVsRest(classifier=gbt, **common)
    if kind == "perceptron":  # has no weights: resample instead
        common.pop("weightCol", None)
        return MultilayerPerceptronClassifier(seed=seed, **{"maxIter": 30} | options, **common)
    raise ValueError(f"no classifier is called {kind}")


def scored(model: Model, df: DataFrame, label: str = "label", score: str = "weightedFMeasure") -> float:
    """Weighted F1, or another metric of ML's evaluator."""
    name = {"f1": "f1", "weightedFMeasure": "f1"}.get(score, score)
    return MulticlassClassificationEvaluator(labelCol=label, metricName=name).evaluate(model.transform(df))


def features_in_fold(k: int, robust: bool = False) -> list:
    """Scaling, then PCA: to be fitted inside the fold."""
    scale = RobustScaler(inputCol="features", outputCol="scaled", withCentering=True) if robust else StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return [scale, PCA(k=k, inputCol="scaled", outputCol="pca")]


def knn_classify(train: DataFrame, test: DataFrame, key: str, vector: str, label: str, k: int = 5, weights: str = "uniform", metric: str = "cosine") -> DataFrame:
    """H3: vote of the k nearest training rows (cosine, l1 or l2), each one vote (uniform), its ``similarity`` (cosine) or one over its ``distance``."""
    near = nearest(test, train, key, vector, k, metric).join(train.select(F.col(key).alias("other"), F.col(label).alias("vote")), "other")
    far = (1 if metric == "cosine" else 0) - F.col("sim")
    w = {"uniform": F.lit(1.0), "similarity": F.greatest(F.col("sim"), F.lit(0.0)), "distance": 1 / F.greatest(far, F.lit(1e-9))}[weights]
    votes = near.groupBy("id", "vote").agg(F.sum(w).alias("votes"))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("votes"), "vote"))
    return votes.withColumn("r", best).filter("r = 1").select(F.col("id").alias(key), F.col("vote").alias("prediction"))


def ridge_classify(train: DataFrame, test: DataFrame, label: str, classes: Sequence[int], alpha: float = 1.0) -> DataFrame:
    """H9: one ridge regression on +1/-1 for each class (squared error + ``alpha`` times squared weights); the largest value wins."""
    out, counts = test, {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    n = max(1, sum(counts.values()))
    for c in classes:
        share = counts.get(c, 0) / n
        # Spark's penalty is per row and in units of the target's deviation.
        penalty = alpha / n * (2 * (share * (1 - share)) ** 0.5 or 1.0)
        y = train.withColumn("__y", F.when(F.col(label) == c, 1.0).otherwise(-1.0))
        m = LinearRegression(labelCol="__y", predictionCol=f"__v{c}", elasticNetParam=0.0, regParam=penalty, standardization=False, maxIter=50).fit(y)
        out = m.transform(out)
    v = F.array(*[F.col(f"__v{c}") for c in classes])
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(v, F.array_max(v)).cast("int"))
    return out.withColumn("prediction", best).drop(*[f"__v{c}" for c in classes])


def ordinal_classify(train: DataFrame, test: DataFrame, label: str, k: int) -> DataFrame:
    """A balanced logistic regression on y > c for each c, made monotone, turned into class probabilities ``p``."""
    out = test
    for c in range(k - 1):
        y = train.withColumn("__y", (F.col(label) > c).cast("double"))
        m = classifier("logistic", y.count(), label="__y", weight="weight", maxIter=20).fit(weighted(y, "__y"))
        out = m.transform(out).withColumn(f"__q{c}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
    p = ordinal_probabilities(F.array(*[F.col(f"__q{c}") for c in range(k - 1)]))
    return out.withColumn("p", p).withColumn("prediction", F.array_position("p", F.array_max("p")).cast("int") - 1).drop(*[f"__q{c}" for c in range(k - 1)])


def out_of_fold(train: DataFrame, kinds: Mapping[str, Estimator], fold: str, k: int, key: str) -> DataFrame:
    """Probabilities of each model for rows that its fit didn't see: key, one array column per model."""
    parts = None
    for f in range(k):
        fit, rest = train.filter(F.col(fold) != f), train.filter(F.col(fold) == f)
        for name, est in kinds.items():
            rest = est.fit(fit).transform(rest).withColumn(f"p_{name}", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
        parts = rest if parts is None else parts.unionByName(rest)
    return parts


def stack(train: DataFrame, test: DataFrame, kinds: Mapping[str, Estimator], fold: str, k: int, key: str, label: str = "label") -> DataFrame:
    """A logistic regression on the out-of-fold probabilities of the base models."""
    oof = out_of_fold(train, kinds, fold, k, key)
    base = test
    for name, est in kinds.items():
        base = est.fit(train).transform(base).withColumn(f"p_{name}", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
    join = lambda d: d.withColumn("meta", array_to_vector(F.concat(*[F.col(f"p_{n}") for n in kinds])))
    return LogisticRegression(featuresCol="meta", labelCol=label, maxIter=20).fit(join(oof)).transform(join(base))


def grid_search(train: DataFrame, est: Estimator, grid: Mapping[str, Sequence], fold: str | None = None, k: int = 5, draws: int | None = None, label: str = "label", seed: int = 0) -> CrossValidatorModel:
    """Cross-validated search by weighted F1; ``draws``: so many random cells of the grid.

    What ``CrossValidator`` does, but rows are dealt out evenly first (a file can be one part) and cached once for all folds,
    and all cells of a fold are scored in one pass.
    """
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(est.getParam(name), list(values))
    cells = b.build()
    if draws is not None and draws < len(cells):
        cells = random.Random(seed).sample(cells, draws)
    x = train.withColumn("__fold", F.col(fold) if fold else F.floor(F.rand(seed) * k))
    spark = train.sparkSession
    x = x.repartition(min(-(-train.count() // ROWS) or 1, max(spark.sparkContext.defaultParallelism, train.rdd.getNumPartitions()))).persist()
    try:
        found = {r[0] for r in x.select("__fold").distinct().collect()}
        if found != set(range(k)):
            raise ValueError(f"folds are {sorted(found, key=str)}, not each of 0 to {k - 1}")
        fits = [partial(est.fit, x.filter(F.col("__fold") != f), c) for f in range(k) for c in cells]
        with ThreadPool(FITS) as pool:
            models = pool.map(lambda fit: fit(), [inheritable_thread_target(spark)(f) for f in fits], 1)
        scores = [weighted_f1(models[f * len(cells) :][: len(cells)], x.filter(F.col("__fold") == f), label) for f in range(k)]
        mean = [sum(s[i] for s in scores) / k for i in range(len(cells))]
        std = [(sum((s[i] - m) ** 2 for s in scores) / k) ** 0.5 for i, m in enumerate(mean)]
        best = est.fit(x, cells[mean.index(max(mean))])
    finally:
        x.unpersist()
    return CrossValidatorModel(best, mean, None, std)


def weighted_f1(models: Sequence[Model], df: DataFrame, label: str) -> list[float]:
    """Weighted F1 of each model on the same rows, in one pass."""
    keep, told = df.columns, []
    for i, m in enumerate(models):
        df = m.transform(df).select(*keep, *told, F.col("prediction").alias(f"__p{i}"))
        told.append(f"__p{i}")
    each = df.select(F.col(label).alias("y"), F.posexplode(F.array(*told)).alias("cell", "pred"))
    counts = classification(each.groupBy("cell", "y", "pred").agg(F.count(F.lit(1)).alias("n")), ["cell"])
    f1 = {r.cell: r.weighted_f1 for r in counts.collect()}
    return [f1[i] for i in range(len(models))]


def nested_cv(df: DataFrame, est: Estimator, grid: Mapping[str, Sequence], outer: str, k_outer: int, inner: str, k_inner: int, label: str = "label") -> DataFrame:
    """For each outer fold the inner folds choose the settings, the choice is fitted again on all that trains and predicts the outer fold."""
    out = None
    for f in range(k_outer):
        train, test = df.filter(F.col(outer) != f), df.filter(F.col(outer) == f)
        best = grid_search(train, est, grid, inner, k_inner, label=label)
        p = best.transform(test).withColumn("inner_score", F.lit(max(best.avgMetrics)))
        out = p if out is None else out.unionByName(p)
    return out


def refit(parts: Sequence[DataFrame], est: Estimator) -> Model:
    """Fit again on several parts together."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return est.fit(whole)


def smote(train: DataFrame, key: str, vector: str, label: str, minority, k: int = 5, ratio: float = 1.5, seed: int = 0) -> DataFrame:
    """If the largest class is at least ``ratio`` times the minority, new rows between minority rows and their neighbours until the classes match.

    Copy number, neighbour and place between come from md5(seed | id | copy): the same on every run.
    """
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    few, most = counts.get(minority, 0), max(counts.values(), default=0)
    if few < 2 or most < ratio * few:
        return train
    own = train.filter(F.col(label) == minority).withColumn("copies", F.lit(-(-(most - few) // few)))
    new = between_neighbours(own, key, vector, label, min(k, few - 1), seed)
    return train.select(vector, label).unionByName(new.orderBy("copy", "o", key).limit(most - few).select(vector, label))


def adasyn(train: DataFrame, key: str, vector: str, label: str, minority, k: int = 5, ratio: float = 1.5, seed: int = 0) -> DataFrame:
    """As ``smote``, but a minority row gets new rows by the share of other classes among its neighbours; none if no neighbour is of another class."""
    counts = {r[0]: r[1] for r in train.groupBy(label).count().collect()}
    few, most = counts.get(minority, 0), max(counts.values(), default=0)
    if few < 2 or most < ratio * few:
        return train
    own = train.filter(F.col(label) == minority)
    hard = nearest(own, train, key, vector, k).join(train.select(F.col(key).alias("other"), F.col(label).alias("__of")), "other").groupBy("id").agg(F.avg((F.col("__of") != minority).cast("double")).alias("share"))
    total = hard.agg(F.sum("share")).first()[0] or 0.0
    if not total:
        return train
    own = own.join(hard.select(F.col("id").alias(key), F.round(F.col("share") / total * (most - few)).cast("int").alias("copies")), key).filter("copies > 0")
    mine = train.filter(F.col(label) == minority)
    return train.select(vector, label).unionByName(between_neighbours(own, key, vector, label, min(k, few - 1), seed, mine).select(vector, label))


def between_neighbours(own: DataFrame, key: str, vector: str, label: str, k: int, seed: int, among: DataFrame | None = None) -> DataFrame:
    """``copies`` new rows for each row of ``own``: between it and one of its k nearest of ``among`` (else ``own``)."""
    among = own if among is None else among
    near = nearest(own, among, key, vector, k).select(F.col("id").alias(key), "other", "rank")
    new = own.select(key, vector, label, "copies").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    h = seeded_int(seed, key, "copy")
    new = new.withColumn("rank", (F.pmod(h, F.lit(k)) + 1).cast("int")).withColumn("t", F.pmod(F.floor(h / 64), F.lit(1000)) / 1000.0).withColumn("o", h)
    new = new.join(near, [key, "rank"]).join(among.select(F.col(key).alias("other"), F.col(vector).alias("w")), "other")
    mixed = F.zip_with(F.col(vector), F.col("w"), lambda a, b: a + F.col("t") * (b - a))
    return new.withColumn(vector, mixed.cast(dict(own.dtypes)[vector]))


def platt(train: DataFrame, score: str, y: str) -> Model:
    """A logistic regression on the score."""
    return LogisticRegression(featuresCol="__score", labelCol=y, maxIter=50).fit(train.withColumn("__score", array_to_vector(F.array(F.col(score).cast("double")))).withColumn(y, F.col(y).cast("double")))


def fit_temperature(df: DataFrame, logits: str, y: str, grid: Sequence[float]) -> DataFrame:
    """The temperature with the least mean negative log-likelihood; all in one aggregation."""
    nll = lambda t: F.avg(F.ln(F.aggregate(F.transform(logits, lambda v: F.exp(v / t)), F.lit(0.0), lambda a, b: a + b)) - F.element_at(logits, F.col(y).cast("int") + 1) / t)
    wide = df.agg(*[nll(t).alias(f"t{i}") for i, t in enumerate(grid)])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)]))
    return wide.select(rows.alias("x")).select("x.*").orderBy("nll", "temperature").limit(1)


def elbow(df: DataFrame, ks: Sequence[int], seed: int = 0) -> DataFrame:
    """K, inertia; k = 1 is the total sum of squares."""
    out = []
    for k in ks:
        if k == 1:
            r = df.select(Summarizer.variance(F.col("features")).alias("v"), Summarizer.count(F.col("features")).alias("n")).first()
            out.append((1, float(sum(r.v) * (r.n - 1))))
        else:
            out.append((k, float(KMeans(k=k, seed=seed, maxIter=10).fit(df).summary.trainingCost)))
    return df.sparkSession.createDataFrame(out, "k int, inertia double")


def silhouettes(df: DataFrame, ks: Sequence[int], seed: int = 0) -> DataFrame:
    """K, silhouette (squared Euclidean)."""
    e = ClusteringEvaluator(metricName="silhouette", distanceMeasure="squaredEuclidean")
    return df.sparkSession.createDataFrame([(k, float(e.evaluate(KMeans(k=k, seed=seed, maxIter=10).fit(df).transform(df)))) for k in ks], "k int, silhouette double")


def hierarchy(df: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Sizes of the clusters of a top-down hierarchy."""
    return BisectingKMeans(k=k, seed=seed).fit(df).transform(df).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def linear_contributions(model, df: DataFrame, key: str) -> DataFrame:
    """Coefficient times distance from the mean, for each row and feature, of a two-class linear model."""
    mean = df.select(Summarizer.mean(F.col("features")).alias("m")).first().m
    parts = F.array(*[F.struct(F.lit(i).alias("feature"), (vector_to_array("features")[i] - float(mean[i])) * float(w)) for i, w in enumerate(model.coefficients)])
    x = df.select(key, F.explode(parts).alias("x"))
    return x.select(key, "x.feature", F.col("x.col2").alias("contribution"))


def permutation_importance(model, df: DataFrame, features: Sequence[int], key: str, label: str = "label", seed: int = 0) -> DataFrame:
    """Loss of weighted F1 when a feature's values are shuffled among the rows: all features in one pass. Keys are distinct.

    A shuffle is a join of two orders of the rows, by key and by a seeded hash.
    """
    one = F.lit(1).cast("long")
    values = df.select(F.col(key).alias("__key"), F.posexplode(vector_to_array("features")).alias("feature", "__x")).filter(F.col("feature").isin(list(features)))
    values = values.select("feature", "__x", F.xxhash64(F.lit(seed), "feature", "__key").alias("__h"), one.alias("__one"))
    shuffled = running(values, "__h", ["__one"], ["feature"]).select("feature", "__x", F.col("before___one").alias("__n"))
    a = F.transform(vector_to_array("features"), lambda v, j: F.when(j == F.col("feature"), F.col("__x")).otherwise(v))
    rows = numbered(df.select(key, label, "features"), key, "__n").join(shuffled, "__n").withColumn("features", array_to_vector(a))
    found = model.transform(rows).groupBy("feature", F.col(label).alias("y"), F.col("prediction").alias("pred")).agg(F.count(one).alias("n"))
    return classification(found, ["feature"]).select("feature", (F.lit(scored(model, df, label)) - F.col("weighted_f1")).alias("importance"))


def bag_pool(df: DataFrame, bag: str, how: str = "mean") -> DataFrame:
    """One vector per bag; nothing is gathered."""
    f = Summarizer.mean(F.col("features")) if how == "mean" else Summarizer.max(F.col("features"))
    return df.groupBy(bag).agg(f.alias("features"))


def pipeline(stages: Sequence, est: Estimator) -> Pipeline:
    est.setFeaturesCol(stages[-1].getOutputCol())
    return Pipeline(stages=[*stages, est])
