"""Models against closed forms, brute force and planted truths."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens.operators import metrics, ml, order
from cohortlens.sources import io

SCHEMA = "id long, v array<double>, label double"


def table(spark, x, y):
    rows = [(i, [float(a) for a in v], float(c)) for i, (v, c) in enumerate(zip(x, y, strict=True))]
    return ml.vectors(spark.createDataFrame(rows, SCHEMA), "v").repartition(4).cache()


@pytest.fixture(scope="module")
def two():
    """Two overlapping classes, three features of different scales; the last says nothing."""
    g = np.random.default_rng(1)
    y = np.arange(240) % 2
    x = np.c_[g.normal(size=240) + y, 5 * g.normal(size=240) - 4 * y, 0.2 * g.normal(size=240)]
    return x, y


@pytest.fixture(scope="module")
def df(spark, two):
    return table(spark, *two)


@pytest.fixture(scope="module")
def blobs(spark):
    g = np.random.default_rng(2)
    y = np.arange(90) % 3
    x = np.array([[0, 0], [20, 0], [0, 20]])[y] + g.normal(size=(90, 2))
    return x, y, table(spark, x, y)


def predicted(out):
    return np.array([r.prediction for r in out.orderBy("id").select("prediction").collect()])


def logistic_by_newton(x, y, ridge):
    """Coefficients and intercept of mean log-loss + sum(ridge * w^2) / 2."""
    z, p = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    r = np.r_[ridge, 0.0]
    for _ in range(60):
        s = 1 / (1 + np.exp(-z @ p))
        p = p - np.linalg.solve((z * (s * (1 - s))[:, None]).T @ z / len(x) + np.diag(r), z.T @ (s - y) / len(x) + r * p)
    return p


def test_logistic_regression_is_the_optimum(two, df):
    x, y = two
    m = ml.classifier("logistic", len(x), C=0.5, maxIter=200, tol=1e-10).fit(df)
    want = logistic_by_newton(x, y, x.var(0, ddof=1) / (0.5 * len(x)))
    assert np.allclose([*m.coefficients, m.intercept], want, atol=2e-3)


def test_linear_svm(blobs, two, df):
    x, y = two
    m = ml.classifier("svm", len(x), C=1.0, maxIter=100).fit(df)
    w, s, t = np.array(m.coefficients), x.std(0, ddof=1), 2 * y - 1
    loss = lambda w, b: np.maximum(0, 1 - t * (x @ w + b)).mean() + ((w * s) ** 2).sum() / 2 / len(x)
    best = loss(w, m.intercept)
    g = np.random.default_rng(3)
    assert all(loss(w + g.normal(size=3) * 0.1 / s, m.intercept + 0.1 * g.normal()) > best - 2e-3 for _ in range(50))
    _, c, d = blobs
    assert (predicted(ml.classifier("svm", 90, n_classes=3).fit(d).transform(d)) == c).all()


def test_gaussian_naive_bayes(two, df):
    x, y = two
    like = np.stack([np.log((y == c).mean()) - (np.log(x[y == c].var(0)) / 2 + (x - x[y == c].mean(0)) ** 2 / 2 / x[y == c].var(0)).sum(1) for c in (0, 1)], 1)
    assert (predicted(ml.classifier("naive_bayes").fit(df).transform(df)) == like.argmax(1)).all()


def test_stump_is_the_best_split(two, df):
    x, y = two
    m = ml.classifier("tree", maxDepth=1, maxBins=256).fit(df)
    gini = lambda k: 2 * k.mean() * (1 - k.mean()) if len(k) else 0.0
    cost = lambda j, t: ((x[:, j] <= t).sum() * gini(y[x[:, j] <= t]) + (x[:, j] > t).sum() * gini(y[x[:, j] > t])) / len(x)
    best = min(cost(j, t) for j in range(3) for t in x[:, j])
    root = m._java_obj.rootNode().split()
    assert cost(root.featureIndex(), root.threshold()) == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize(("kind", "options"), [("forest", {"numTrees": 15}), ("boosting", {"maxIter": 8}), ("perceptron", {"layers": [2, 12, 2], "maxIter": 150})])
def test_what_a_line_cannot_split(spark, kind, options):
    g = np.random.default_rng(4)
    x = g.uniform(-1, 1, size=(400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)
    d = table(spark, x, y)
    fit, rest = d.filter("id % 4 <> 0"), d.filter("id % 4 = 0")
    assert ml.scored(ml.classifier("logistic", 300).fit(fit), rest, score="accuracy") < 0.7
    assert ml.scored(ml.classifier(kind, 300, **options).fit(fit), rest, score="accuracy") > 0.85
    if kind == "boosting":
        three = d.withColumn("label", F.when(F.col("id") % 3 == 0, 2.0).otherwise(F.col("label"))).withColumn("features", ml.array_to_vector(F.array(F.col("label"), F.col("label") * F.col("label"))))
        assert ml.scored(ml.classifier(kind, 400, n_classes=3, maxIter=2).fit(three), three, score="accuracy") == 1.0


@pytest.mark.parametrize("weights", ["uniform", "similarity"])
def test_knn(two, df, weights):
    x, y = two
    u = x / np.linalg.norm(x, axis=1)[:, None]
    fit, rest = np.arange(len(x)) % 3 > 0, np.arange(len(x)) % 3 == 0
    want = []
    for i in np.flatnonzero(rest):
        s = u[fit] @ u[i]
        top = np.lexsort((np.flatnonzero(fit), -s))[:5]
        w = np.ones(5) if weights == "uniform" else np.maximum(s[top], 0)
        want.append(np.argmax([w[y[fit][top] == c].sum() for c in (0, 1)]))
    got = ml.knn_classify(df.filter("id % 3 > 0"), df.filter("id % 3 = 0"), "id", "v", "label", weights=weights)
    assert (predicted(got) == np.array(want)).mean() == 1.0


@pytest.mark.parametrize(("metric", "order"), [("l1", 1), ("l2", 2)])
def test_knn_by_distance(two, df, metric, order):
    x, y = two
    fit, rest = np.arange(len(x)) % 3 > 0, np.arange(len(x)) % 3 == 0
    want = []
    for i in np.flatnonzero(rest):
        far = np.linalg.norm(x[fit] - x[i], ord=order, axis=1)
        top = np.lexsort((np.flatnonzero(fit), far))[:5]
        want.append(np.argmax([(1 / far[top][y[fit][top] == c]).sum() for c in (0, 1)]))
    got = ml.knn_classify(df.filter("id % 3 > 0"), df.filter("id % 3 = 0"), "id", "v", "label", weights="distance", metric=metric)
    assert (predicted(got) == np.array(want)).mean() == 1.0


def test_equal_neighbours_are_taken_by_id(spark):
    d = table(spark, [[1.0, 0.0]] * 40 + [[1.0, 0.1]] * 3, [0] * 43)
    got = ml.nearest(d.filter("id >= 40"), d.filter("id < 40"), "id", "v", 3)
    assert {(r.id, r.other) for r in got.collect()} == {(i, k) for i in (40, 41, 42) for k in (0, 1, 2)}


def test_ridge_is_the_normal_equations(two, df):
    x, y = two
    out = ml.ridge_classify(df, df, "label", [0, 1], alpha=30.0)
    c = x - x.mean(0)
    t = np.where(y == 1, 1.0, -1.0)
    w = np.linalg.solve(c.T @ c + 30.0 * np.eye(3), c.T @ (t - t.mean()))
    assert (predicted(out) == (c @ w + t.mean() > 0)).all()


def test_ordinal(spark):
    g = np.random.default_rng(6)
    x = g.uniform(0, 3, size=(300, 1))
    d = table(spark, x, np.floor(x[:, 0]))
    out = ml.ordinal_classify(d.filter("id % 3 > 0"), d.filter("id % 3 = 0"), "label", 3).select("label", "prediction", "p").collect()
    assert all(abs(sum(r.p) - 1) < 1e-9 and min(r.p) >= 0 and r.p[r.prediction] == max(r.p) for r in out)
    assert np.mean([r.prediction == r.label for r in out]) > 0.9


def test_stacking_uses_models_that_did_not_see_the_row(two, df):
    x, y = two
    folded = df.withColumn("fold", (F.col("id") % 3).cast("int"))
    kinds = {"nb": ml.classifier("naive_bayes"), "tree": ml.classifier("tree", maxDepth=2)}
    oof = ml.out_of_fold(folded, kinds, "fold", 3, "id")
    rows = {r.id: r.p_nb[1] for r in oof.collect()}
    assert len(rows) == len(x)
    fold = np.arange(len(x)) % 3
    for i in (0, 1, 2, 77):
        a, b = x[fold != i % 3], y[fold != i % 3]
        like = [np.log((b == c).mean()) - (np.log(a[b == c].var(0)) / 2 + (x[i] - a[b == c].mean(0)) ** 2 / 2 / a[b == c].var(0)).sum() for c in (0, 1)]
        assert rows[i] == pytest.approx(1 / (1 + np.exp(like[0] - like[1])), abs=1e-6)
    whole = ml.stack(folded, df, kinds, "fold", 3, "id")
    assert (predicted(whole) == y).mean() >= max((predicted(k.fit(df).transform(df)) == y).mean() for k in kinds.values()) - 0.05


def test_search_and_nested_search(two, df):
    folded = df.withColumn("outer", (F.col("id") % 2).cast("int")).withColumn("inner", (F.col("id") % 3).cast("int"))
    est = ml.classifier("logistic", 200, maxIter=20)
    best = ml.grid_search(folded, est, {"regParam": [1e-3, 50.0]}, "inner", 3)
    assert len(best.avgMetrics) == 2 and best.bestModel.getRegParam() == 1e-3
    assert len(ml.grid_search(folded, est, {"regParam": [1e-3, 0.1, 50.0]}, "inner", 3, draws=2).avgMetrics) == 2
    out = ml.nested_cv(folded, est, {"regParam": [1e-3, 50.0]}, "outer", 2, "inner", 3)
    assert out.count() == df.count() == out.select("id").distinct().count()
    again = est.copy({est.regParam: 1e-3}).fit(folded.filter("outer <> 1")).transform(folded.filter("outer = 1"))
    assert (predicted(out.filter("outer = 1")) == predicted(again)).all()


def test_search_deals_rows_out_and_scores_as_spark_does(spark, monkeypatch):
    """Rows of one part are fitted by all cores, the same scores as ``CrossValidator``'s come out, and a fold's cells are scored together."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    x = spark.range(0, 3 * ml.ROWS, 1, 1).selectExpr("id", "cast(id % 3 as int) as fold", "array(sin(id), cos(id * 7), sin(id * id)) as v", "cast(sin(id) + cos(id * 3) > 0.4 as double) as label")
    x = ml.vectors(x, "v")
    est = ml.classifier("logistic", 200, maxIter=5)
    cells = ParamGridBuilder().addGrid(est.regParam, [0.001, 0.3]).addGrid(est.elasticNetParam, [0.0, 1.0]).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=cells, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=3, foldCol="fold").fit(x)
    parts, fit = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: (parts.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    monkeypatch.setattr(MulticlassClassificationEvaluator, "evaluate", None)
    best = ml.grid_search(x, est, {"regParam": [0.001, 0.3], "elasticNetParam": [0.0, 1.0]}, "fold", 3)
    assert best.avgMetrics == pytest.approx(cv.avgMetrics, abs=1e-9) and best.stdMetrics == pytest.approx(cv.stdMetrics, abs=1e-9)
    assert best.bestModel.getRegParam() == cv.bestModel.getRegParam() and best.bestModel.getElasticNetParam() == cv.bestModel.getElasticNetParam()
    assert len(parts) == 13 and set(parts) == {3}
    with pytest.raises(ValueError):
        ml.grid_search(x.filter("fold <> 1"), est, {"regParam": [0.1]}, "fold", 3)


def test_refit_is_the_fit_on_all_parts(df):
    both = ml.refit([df.filter("id < 100"), df.filter("id >= 100")], ml.classifier("naive_bayes")).transform(df)
    assert (predicted(both) == predicted(ml.classifier("naive_bayes").fit(df).transform(df))).all()


def test_features_are_fitted_in_the_fold(two, df):
    x, _ = two
    fit = np.arange(len(x)) < 120
    m = ml.pipeline(ml.features_in_fold(2), ml.classifier("naive_bayes")).fit(df.filter("id < 120"))
    got = np.array([list(r.pca) for r in m.transform(df).orderBy("id").select("pca").collect()])
    z = (x - x[fit].mean(0)) / x[fit].std(0, ddof=1)
    _, _, axes = np.linalg.svd(z[fit], full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(z @ axes[:2].T), atol=1e-6)
    assert ml.features_in_fold(2, robust=True)[0].getWithCentering()


def test_smote_and_adasyn(spark, two):
    x, y = two
    y = np.where(np.arange(240) % 6 == 1, 1, 0)
    d = table(spark, x, y)
    few = x[y == 1]
    for make in (ml.smote, ml.adasyn):
        rows = make(d, "id", "v", "label", 1.0).filter("label = 1").collect()
        assert abs(len(rows) - (y == 0).sum()) <= (0 if make is ml.smote else len(few))
        for r in rows[len(few) :][:20]:  # each new row lies between two of the minority
            v = np.array(r.v)
            a, b = few[:, None], few[None]
            t = ((v - a) * (b - a)).sum(-1) / np.maximum(((b - a) ** 2).sum(-1), 1e-12)
            assert np.min(np.linalg.norm(a + np.clip(t, 0, 1)[..., None] * (b - a) - v, axis=-1)) < 1e-6
        assert make(d.filter("label = 0 or id < 1"), "id", "v", "label", 1.0).count() == (y == 0).sum() + int(y[0] == 1)
    apart = table(spark, np.r_[np.c_[np.ones(10), np.arange(10) / 100], np.c_[-np.ones(40), np.arange(40) / 100]], [1] * 10 + [0] * 40)
    assert ml.adasyn(apart, "id", "v", "label", 1.0).count() == 50  # no neighbour of another class: nothing is hard


def test_platt_scaling(spark):
    g = np.random.default_rng(8)
    s = g.normal(size=300)
    y = (g.uniform(size=300) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(int)
    m = ml.platt(spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int"), "s", "y")
    assert np.allclose([m.coefficients[0], m.intercept], logistic_by_newton(s[:, None], y, np.zeros(1)), atol=2e-3)


def test_clusters(blobs):
    x, y, d = blobs
    inside = sum(((x[y == c] - x[y == c].mean(0)) ** 2).sum() for c in range(3))
    e = {r.k: r.inertia for r in ml.elbow(d, [1, 3, 5]).collect()}
    assert e[1] == pytest.approx(((x - x.mean(0)) ** 2).sum()) and e[3] == pytest.approx(inside) and e[5] < e[3]
    far = np.stack([((x[:, None] - x[None, y == c]) ** 2).sum(-1).sum(1) / ((y == c).sum() - (y == c)[:, None].T[0] * 1.0) for c in range(3)], 1)
    own = far[np.arange(90), y]
    other = np.where(np.arange(3) == y[:, None], np.inf, far).min(1)
    s = {r.k: r.silhouette for r in ml.silhouettes(d, [2, 3]).collect()}
    assert s[3] == pytest.approx(((other - own) / np.maximum(other, own)).mean(), abs=1e-6) and s[3] > s[2]
    assert sorted(r.n for r in ml.hierarchy(d, 3).collect()) == [30, 30, 30]


def test_attributions(two, df):
    x, y = two
    m = ml.classifier("logistic", len(x)).fit(df)
    got = {(r.id, r.feature): r.contribution for r in ml.linear_contributions(m, df, "id").collect()}
    w = np.array(m.coefficients)
    assert all(got[i, j] == pytest.approx(w[j] * (x[i, j] - x[:, j].mean()), abs=1e-9) for i in (0, 5, 239) for j in range(3))
    imp = {r.feature: r.importance for r in ml.permutation_importance(m, df, range(3), "id").collect()}
    assert set(imp) == {0, 1, 2} and imp[1] > 0.05 and imp[0] > 0.02 and abs(imp[2]) < 0.03
    # A shuffle keeps each feature's values: of a feature that is alike in all rows nothing changes.
    flat = df.withColumn("features", ml.array_to_vector(F.array(vector_to_array("features")[0], vector_to_array("features")[1], F.lit(1.0))))
    assert ml.permutation_importance(m, flat, [2], "id").first().importance == pytest.approx(0.0, abs=1e-12)


@pytest.mark.parametrize("how", ["mean", "max"])
def test_bag_pool(two, df, how):
    x, _ = two
    got = {r.bag: list(r.features) for r in ml.bag_pool(df.withColumn("bag", F.col("id") % 7), "bag", how).collect()}
    assert all(np.allclose(got[b], getattr(x[np.arange(len(x)) % 7 == b], how)(0)) for b in range(7))


def test_bundle_serves_the_version_of_its_pointer(spark, df, tmp_path):
    models = {}
    for version, k in (("v1", 1), ("v2", 2)):
        models[version] = ml.pipeline(ml.features_in_fold(k), ml.classifier("naive_bayes")).fit(df)
        io.save_bundle(spark, f"file://{tmp_path}/b", version, models[version], {"threshold": k / 10, "classes": ["a", "b"]})
    served, meta = io.load_bundle(spark, f"file://{tmp_path}/b")
    assert (meta.version, meta.threshold, meta.classes) == ("v2", 0.2, ["a", "b"])
    assert (predicted(served.transform(df)) == predicted(models["v2"].transform(df))).all()


def test_running_sums(spark):
    r = random.Random(4)
    rows = [(g, s, r.randrange(5)) for g in (0, 1, None) for s in r.sample(range(4000), 900 if g == 0 else 40)]
    d = spark.createDataFrame(rows, "g int, s long, n long").repartition(5)
    for descending in (False, True):
        got = {(x.g, x.s): (x.before_n, x.all_n) for x in order.running(d, "s", ["n"], ["g"], descending).collect()}
        for g, s, _ in rows:
            mine = [(q, n) for h, q, n in rows if h == g]
            assert got[g, s] == (sum(n for q, n in mine if (q > s if descending else q < s)), sum(n for _, n in mine))
    words = [f"w{r.random()}" for _ in range(500)] + [None]
    place = {x.v: x.place for x in order.numbered(spark.createDataFrame([(w,) for w in words], "v string"), "v", "place").collect()}
    assert [w for w, _ in sorted(place.items(), key=lambda p: p[1])] == [None, *sorted(words[:-1])]
    assert order.numbered(spark.createDataFrame([], "v string"), "v", "place").count() == 0


def test_auc_and_curve_over_many_scores(spark):
    r = random.Random(9)
    rows = [(r.randrange(700), r.randrange(2)) for _ in range(1500)]
    d = spark.createDataFrame(rows, "s long, y int").repartition(3)
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert metrics.roc_auc(d, "y", "s").first().auc == pytest.approx(auc)
    for x in metrics.roc_curve(d, "y", "s").collect()[::37]:
        assert x.tpr == pytest.approx(sum(s >= x.threshold for s in pos) / len(pos)) and x.fpr == pytest.approx(sum(s >= x.threshold for s in neg) / len(neg))
