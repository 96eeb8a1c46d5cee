"""Queries of models (H1-H28): rows-only checks; ``tests/test_models.py`` holds the operators against closed forms, brute force and planted truths."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import boosting, explain, kernels, ml, surrogates, ward
from ..operators import split as P
from ..registry import query
from ..sources.tables import table


def rows(spark, d):
    e = table(spark, d, "embeddings").withColumn("fold", F.pmod(P.seeded_int(3, "vec_id"), F.lit(5)).cast("int"))
    return ml.vectors(e.withColumn("label", F.col("label").cast("double")), "embedding").cache()


def halves(spark, d, two=False):
    x = rows(spark, d)
    x = x.withColumn("label", (F.col("label") >= 5).cast("double")) if two else x
    return x.filter("fold <> 4"), x.filter("fold = 4")


def plain(df):
    return df.select("vec_id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("prediction"))


FOLDS = "e AS (SELECT vec_id, label, embedding, ('0x' || substr(md5('3|' || vec_id), 1, 8))::BIGINT % 5 AS fold FROM embeddings)"


def bayes_sql(units: str, fit: str, score: str, out: str, priors: bool = True) -> str:
    """Gaussian naive Bayes over ``units`` (id, label, fold, v): fitted on the rows of ``fit``, predicted for those of ``score``."""
    prior = "ln(count(*))" if priors else "0"
    return f"""WITH {FOLDS}, u AS ({units}), l AS (SELECT id, label, fold, unnest(v)::DOUBLE AS x, generate_subscripts(v, 1) AS i FROM u),
    g AS (SELECT label AS c, i, avg(x) AS m, var_pop(x) AS w FROM l WHERE {fit} GROUP BY ALL),
    f AS (SELECT 1e-9 * max(w) AS least FROM (SELECT var_pop(x) AS w FROM l WHERE {fit} GROUP BY i)),
    p AS (SELECT label AS c, {prior} AS prior FROM u WHERE {fit} GROUP BY 1),
    s AS (SELECT id, l.label, c, any_value(prior) + sum(-0.5 * ln(w + least) - (x - m) ** 2 / (2 * (w + least))) AS score FROM l JOIN g USING (i) JOIN p USING (c) CROSS JOIN f WHERE {score} GROUP BY ALL)
    SELECT {out} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, c) AS r FROM s) WHERE r = 1"""


ROWS, PLAIN = "SELECT vec_id AS id, label, fold, embedding AS v FROM e", "id AS vec_id, label::INT AS y, c::INT AS prediction"


def model_query(name, kind, two=False, sql=None, **options):
    @query(name, sql)
    def run(spark, d):
        train, test = halves(spark, d, two)
        est = ml.classifier(kind, train.count(), n_classes=2 if two else 10, weight=None if kind == "perceptron" else "weight", **options)
        return plain(est.fit(ml.weighted(train)).transform(test))

    return run


model_query("h1_logistic_regression", "logistic", C=1.0, maxIter=20)
model_query("h2_linear_svm", "svm", two=True, maxIter=10)
model_query("h4_naive_bayes", "naive_bayes", sql=bayes_sql(ROWS, "fold <> 4", "fold = 4", PLAIN, priors=False))  # balanced weights: equal priors
model_query("h5_decision_tree", "tree", maxDepth=5)
model_query("h6_random_forest", "forest", numTrees=10)
model_query("h7_perceptron", "perceptron", layers=[64, 16, 10])
model_query("h8_boosting", "boosting", two=True, maxIter=5)


def kernel_query(name, kind, **options):
    @query(name)
    def run(spark, d):
        train, test = halves(spark, d, two=True)
        k = kernels.Kernel(kind, kernels.gamma_by_scale(train), 256, **options)
        fit, rest = (k.apply(x.drop("features"), "embedding") for x in (train, test))
        return plain(ml.classifier("svm", train.count(), weight="weight", maxIter=10).fit(ml.weighted(fit)).transform(rest))


kernel_query("h2_rbf_svm", "rbf")
kernel_query("h2_poly_svm", "poly", degree=3)


@query("h8_histogram_boosting")
def h8_histograms(spark, d):
    train, test = halves(spark, d)
    model = boosting.fit(train, "embedding", "label", "vec_id", rounds=8, max_depth=3, max_leaves=6, rate=0.3)
    return plain(model.transform(test, "embedding"))


STUMPS = f"""WITH {FOLDS}, l AS (SELECT vec_id, label, fold, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS f FROM e),
t AS (SELECT * FROM l WHERE fold <> 4),
b AS (SELECT DISTINCT f, unnest(quantile_cont(x, {[i / 16 for i in range(1, 16)]})) AS border FROM t GROUP BY f),
c AS (SELECT label AS c, count(*) AS n_c, sum(count(*)) OVER () AS n FROM e WHERE fold <> 4 GROUP BY 1),
s AS (SELECT f, border, label, count(*) AS n_l FROM t JOIN b USING (f) WHERE x <= border GROUP BY ALL),
g AS (SELECT f, border, c, n_c / n AS p, n, n_c, coalesce(sum(n_l), 0) AS n_low, coalesce(sum(n_l) FILTER (label = c), 0) AS n_own FROM b CROSS JOIN c JOIN s USING (f, border) GROUP BY ALL),
h AS (SELECT *, p * n_low - n_own AS gl, p * (1 - p) * n_low AS hl, p * (n - n_low) - (n_c - n_own) AS gr, p * (1 - p) * (n - n_low) AS hr FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY round(gl ** 2 / (hl + 1) + gr ** 2 / (hr + 1), 9) DESC, f, border) AS r FROM h WHERE n_low < n AND least(hl, hr) >= 1e-3),
m AS (SELECT vec_id, label, c, round(ln(p) - 0.3 * CASE WHEN x <= border THEN gl / (hl + 1) ELSE gr / (hr + 1) END, 9) AS m FROM l JOIN k USING (f) WHERE fold = 4 AND r = 1)
SELECT vec_id, label::INT AS y, arg_max(c, (m, -c))::INT AS prediction FROM m GROUP BY ALL"""


@query("h8_first_stumps", STUMPS)
def h8_stumps(spark, d):
    train, test = halves(spark, d)
    return plain(boosting.fit(train, "embedding", "label", "vec_id", rounds=1, max_depth=1, bins=16).transform(test, "embedding"))


@query(
    "h8_ordered_statistics",
    """WITH o AS (SELECT o_orderkey, o_orderpriority, (o_orderstatus = 'F')::INT AS y, md5('5|' || o_orderkey) AS h FROM orders)
    SELECT o_orderkey, round((coalesce(sum(y) OVER w, 0) + 10 * (SELECT avg(y) FROM o)) / (count(*) OVER w + 10), 9) AS encoded FROM o
    WINDOW w AS (PARTITION BY o_orderpriority ORDER BY h, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def h8_ordered(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return boosting.ordered_statistics(o, "o_orderpriority", "y", "o_orderkey", "encoded", 5, 10.0).select("o_orderkey", F.round("encoded", 9).alias("encoded"))


def knn_sql(distance: str, vote: str = "count(*)") -> str:
    return f"""WITH {FOLDS}, u AS (SELECT *, sqrt(list_inner_product(v, v)) AS norm FROM (SELECT *, embedding::DOUBLE[] AS v FROM e)),
    d AS (SELECT t.vec_id, r.vec_id AS other, r.label, {distance} AS far FROM u t JOIN u r ON t.fold = 4 AND r.fold <> 4),
    s AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY far, other) AS k FROM d),
    n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY {vote} DESC, label) AS r FROM s WHERE k <= 5 GROUP BY 1, 2)
    SELECT vec_id, label::INT AS prediction FROM n WHERE r = 1"""


def knn_query(name, sql, **options):
    @query(name, sql)
    def run(spark, d):
        train, test = halves(spark, d)
        return ml.knn_classify(train, test, "vec_id", "embedding", "label", **options).select("vec_id", F.col("prediction").cast("int").alias("prediction"))


knn_query("h3_knn", knn_sql("-list_inner_product(t.v, r.v) / (t.norm * r.norm)"))
knn_query("h3_knn_l1", knn_sql("list_sum(list_transform(range(1, len(t.v) + 1), lambda i: abs(t.v[i] - r.v[i])))"), metric="l1")
knn_query("h3_knn_l2", knn_sql("list_distance(t.v, r.v)", "sum(1 / greatest(far, 1e-9))"), metric="l2", weights="distance")


@query("h9_ridge")
def h9(spark, d):
    train, test = halves(spark, d, two=True)
    return plain(ml.ridge_classify(train, test, "label", [0, 1]))


@query("h10_ordinal")
def h10(spark, d):
    x = rows(spark, d).withColumn("label", F.floor(F.col("label") / 4).cast("double"))
    o = ml.ordinal_classify(x.filter("fold <> 4"), x.filter("fold = 4"), "label", 3)
    return o.select("vec_id", F.col("label").cast("int").alias("y"), "prediction", F.round(S.total(F.col("p")), 6).alias("p_sum"))


@query("h11_stacking")
def h11(spark, d):
    train, test = halves(spark, d, two=True)
    kinds = {"forest": ml.classifier("forest"), "boosting": ml.classifier("boosting"), "logistic": ml.classifier("logistic", train.count(), maxIter=20)}
    return plain(ml.stack(train, test, kinds, "fold", 4, "vec_id"))


@query("h12_unit_aggregator")
def h12(spark, d):
    from ..operators.metrics import unit_statistics
    from .metrics import probabilities

    u = unit_statistics(probabilities(spark, d), "unit", "p").groupBy("unit").pivot("k", [0, 1, 2, 3]).agg(F.first("mean").alias("mean"), F.first("max").alias("max"), F.first("std").alias("std"))
    x = ml.assembled(u, [c for c in u.columns if c != "unit"]).withColumn("label", (F.col("unit") % 2).cast("double"))
    return ml.classifier("logistic", 50, maxIter=10).fit(x).transform(x).select("unit", F.col("prediction").cast("int").alias("prediction"))


@query("h13_scale_pca")
def h13(spark, d):
    train, test = halves(spark, d)
    m = ml.pipeline(ml.features_in_fold(8), ml.classifier("logistic", train.count(), maxIter=10)).fit(train)
    return plain(m.transform(test))


@query("h14_grid_search")
def h14(spark, d):
    train, _ = halves(spark, d, two=True)
    est = ml.classifier("logistic", train.count(), maxIter=5)
    grid = {"regParam": [0.001, 0.003, 0.01, 0.03, 0.1, 0.3], "elasticNetParam": [0.0, 0.25, 0.5, 1.0]}
    m = ml.grid_search(train, est, grid, "fold", 4, draws=20)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(m.avgMetrics)], "cell int, f1 double")


@query("h15_nested_cv")
def h15(spark, d):
    x = rows(spark, d).withColumn("label", (F.col("label") >= 5).cast("double")).withColumn("outer", (F.col("fold") % 2)).withColumn("inner", (F.pmod(P.seeded_int(9, "vec_id"), F.lit(2))).cast("int"))
    return plain(ml.nested_cv(x, ml.classifier("logistic", 400, maxIter=5), {"regParam": [0.001, 0.1]}, "outer", 2, "inner", 2))


@query("h16_refit", bayes_sql(ROWS, "fold < 4", "fold = 4", PLAIN))
def h16(spark, d):
    x = rows(spark, d)
    return plain(ml.refit([x.filter("fold < 3"), x.filter("fold = 3")], ml.classifier("naive_bayes")).transform(x.filter("fold = 4")))


@query("h17_smote", "WITH c AS (SELECT (label = 0)::INT::DOUBLE AS label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT max(n) AS most, coalesce(min(n) FILTER (label = 1), 0) AS few FROM c) SELECT label, CASE WHEN label = 1 AND few >= 2 AND most >= 1.5 * few THEN most ELSE n END AS n FROM c CROSS JOIN m")
def h17(spark, d):
    x = rows(spark, d).withColumn("label", (F.col("label") == 0).cast("double"))
    return ml.smote(x, "vec_id", "embedding", "label", 1.0).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("h18_platt")
def h18(spark, d):
    from .metrics import length_scores

    s = length_scores(spark, d)
    m = ml.platt(s, "s", "y")
    return spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "slope double, intercept double")


@query("h21_leakage_experiment")
def h21(spark, d):
    """One model, three splits (by row, by unit of copies, by unit with shuffled labels): leaks show as higher scores."""
    x = rows(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("row", F.col("vec_id") * 2 + F.col("copy"))
    by_row = F.pmod(P.seeded_int(1, "row"), F.lit(5)) == 0
    by_unit = F.pmod(P.seeded_int(1, "vec_id"), F.lit(5)) == 0
    shuffled = x.withColumn("label", P.random_label(x, "vec_id", "vec_id", 5, 10).cast("double"))
    out = []
    for name, data, test in (("row", x, by_row), ("unit", x, by_unit), ("unit, shuffled labels", shuffled, by_unit)):
        m = ml.classifier("tree", maxDepth=10).fit(data.filter(~test))
        out.append((name, ml.scored(m, data.filter(test), score="accuracy")))
    return spark.createDataFrame(out, "split string, accuracy double")


@query("h22_elbow")
def h22(spark, d):
    return ml.elbow(rows(spark, d), range(1, 11))


@query("h23_silhouette")
def h23(spark, d):
    return ml.silhouettes(rows(spark, d), range(2, 11))


@query("h24_hierarchy")
def h24(spark, d):
    return ml.hierarchy(rows(spark, d), 4)


@query("h24_ward")
def h24_ward(spark, d):
    cut = ward.ward(table(spark, d, "embeddings"), "embedding")
    return cut.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"), F.min("vec_id").alias("first_id"))


@query("h25_linear_contributions")
def h25(spark, d):
    train, test = halves(spark, d, two=True)
    return ml.linear_contributions(ml.classifier("logistic", train.count(), maxIter=10).fit(train), test, "vec_id")


@query("h25_permutation_importance")
def h25_permutation(spark, d):
    train, test = halves(spark, d, two=True)
    return ml.permutation_importance(ml.classifier("naive_bayes").fit(train), test, range(64), "vec_id")


@query("h25_tree_shapley")
def h25_trees(spark, d):
    train, test = halves(spark, d, two=True)
    return explain.shapley_values(ml.classifier("boosting", maxIter=10).fit(train), test, "vec_id")


@query("h25_local_surrogates")
def h25_local(spark, d):
    train, test = halves(spark, d, two=True)
    m = ml.classifier("boosting", maxIter=5).fit(train)
    return surrogates.local_surrogates(m, test, train, "vec_id", vector_to_array("probability")[1], samples=200)


@query("h26_batch_scoring")
def h26(spark, d):
    train, test = halves(spark, d, two=True)
    p = ml.classifier("logistic", train.count(), maxIter=10).fit(train).transform(test)
    return p.select("vec_id", vector_to_array("probability")[1].alias("p")).select("vec_id", F.round("p", 6).alias("p"), S.decision(F.col("p")).alias("d")).select("vec_id", "p", "d.predicted", "d.uncertain")


@query("h28_bag_pooling", bayes_sql("SELECT id, label, 0 AS fold, list(x ORDER BY i) AS v FROM (SELECT label || '-' || vec_id % 5 AS id, label, i, avg(x) AS x FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM e) GROUP BY ALL) GROUP BY ALL", "true", "true", "id AS bag, c::INT AS prediction"))
def h28(spark, d):
    x = rows(spark, d).withColumn("bag", F.concat_ws("-", F.col("label").cast("int").cast("string"), (F.col("vec_id") % 5).cast("string")))
    bags = ml.bag_pool(x, "bag").withColumn("label", F.substring_index("bag", "-", 1).cast("double"))
    return ml.classifier("naive_bayes").fit(bags).transform(bags).select("bag", F.col("prediction").cast("int").alias("prediction"))
