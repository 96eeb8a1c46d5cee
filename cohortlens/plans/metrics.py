"""Queries of metrics, bootstrap and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bootstrap as B
from ..operators import metrics as M
from ..operators import select as L
from ..registry import query
from ..sources.tables import table
from .profile import rounded

K = range(10)
#: A score for each row: quality labels against document length; two scorers of ten classes on the embeddings.
LENGTH = "SELECT doc_id, quality AS y, least(n_chars / 4000.0, 1.0)::DOUBLE AS s FROM documents JOIN labels USING (doc_id)"
PRED = "SELECT vec_id, label AS y, vec_id % 50 AS unit, (CASE WHEN ('0x' || substr(md5('a|' || vec_id), 1, 4))::INT % 100 < 70 THEN label ELSE ('0x' || substr(md5('b|' || vec_id), 1, 4))::INT % 10 END)::INT AS pred, (CASE WHEN ('0x' || substr(md5('c|' || vec_id), 1, 4))::INT % 100 < 50 THEN label ELSE ('0x' || substr(md5('d|' || vec_id), 1, 4))::INT % 10 END)::INT AS other, (('0x' || substr(md5('p|' || vec_id), 1, 4))::INT % 1000) / 1000.0::DOUBLE AS conf FROM embeddings"


#: Probabilities: softmax of four entries of each vector.
P4 = "SELECT vec_id, unit, k, exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id) AS x FROM (SELECT vec_id, vec_id % 50 AS unit, k, embedding[k + 1]::DOUBLE * 5 AS x, greatest(embedding[1], embedding[2], embedding[3], embedding[4])::DOUBLE * 5 AS m FROM embeddings, range(0, 4) r(k))"


def length_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", F.col("quality").alias("y"), F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("s"))


def predictions(spark, d):
    h = lambda salt, m: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}|"), F.col("vec_id").cast("string"))), 1, 4), 16, 10).cast("int"), F.lit(m))
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.col("label").alias("y"), (F.col("vec_id") % 50).alias("unit"), F.when(h("a", 100) < 70, F.col("label")).otherwise(h("b", 10)).cast("int").alias("pred"), F.when(h("c", 100) < 50, F.col("label")).otherwise(h("d", 10)).cast("int").alias("other"), (h("p", 1000) / 1000.0).alias("conf"))


@query("d35_threshold_sweep", f"WITH s AS ({LENGTH}), t AS (SELECT i / 20.0 AS threshold FROM range(1, 20) r(i)), c AS (SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn FROM s, t GROUP BY 1), f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c) SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(f1, 9) AS f1, row_number() OVER (ORDER BY f1 DESC, threshold) = 1 AS best FROM f")
def d35(spark, d):
    return rounded(M.threshold_sweep(length_scores(spark, d), "y", "s", [i / 20 for i in range(1, 20)]), "f1", digits=9)


GRID = "SELECT y, pred FROM range(0, 10) a(y), range(0, 10) b(pred)"
CM = f"SELECT g.y::INT AS y, g.pred::INT AS pred, count(p.vec_id) AS n FROM ({GRID}) g LEFT JOIN ({PRED}) p ON p.y = g.y AND p.pred = g.pred GROUP BY 1, 2"


@query("d23_confusion", CM)
def d23(spark, d):
    return M.confusion(predictions(spark, d), "y", "pred", K)


PC = f"SELECT y, CASE WHEN pr > 0 THEN tp * 1.0 / pr ELSE 0 END AS precision, CASE WHEN su > 0 THEN tp * 1.0 / su ELSE 0 END AS recall, CASE WHEN pr + su > 0 THEN 2.0 * tp / (pr + su) ELSE 0 END AS f1, su AS support, pr AS predicted FROM (SELECT y, sum(n) AS su, sum(n) FILTER (y = pred) AS tp FROM ({CM}) GROUP BY 1) JOIN (SELECT pred AS y, sum(n) AS pr FROM ({CM}) GROUP BY 1) USING (y)"


@query("d24_per_class", f"SELECT y, round(precision, 9)::DOUBLE AS precision, round(recall, 9)::DOUBLE AS recall, round(f1, 9)::DOUBLE AS f1, support::BIGINT AS support, predicted::BIGINT AS predicted FROM ({PC})")
def d24(spark, d):
    return rounded(M.per_class(M.confusion(predictions(spark, d), "y", "pred", K)), "precision", "recall", "f1", digits=9)


@query("d24_classification", f"SELECT round(sum(recall * support) / sum(support), 9)::DOUBLE AS accuracy, round(avg(f1), 9)::DOUBLE AS macro_f1, round(sum(f1 * support) / sum(support), 9)::DOUBLE AS weighted_f1, round(avg(recall), 9)::DOUBLE AS balanced_accuracy FROM ({PC})")
def d24_all(spark, d):
    return rounded(M.classification(M.confusion(predictions(spark, d), "y", "pred", K)), "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy", digits=9)


@query("d25_roc_auc", f"WITH s AS ({LENGTH}) SELECT round((SELECT sum(CASE WHEN p.s > n.s THEN 1.0 WHEN p.s = n.s THEN 0.5 ELSE 0 END) FROM s p, s n WHERE p.y = 1 AND n.y = 0) / ((SELECT count(*) FROM s WHERE y = 1) * (SELECT count(*) FROM s WHERE y = 0)), 9)::DOUBLE AS auc")
def d25(spark, d):
    return rounded(M.roc_auc(length_scores(spark, d), "y", "s"), "auc", digits=9)


OVR = "WITH x AS (SELECT vec_id, k, x AS s, CASE WHEN label % 4 = k THEN 1 ELSE 0 END AS t FROM ({P4}) JOIN embeddings USING (vec_id)), r AS (SELECT k, t, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM x), a AS (SELECT k, sum(t) AS n, (sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2.0) / (sum(t) * sum(1 - t)) AS auc FROM r GROUP BY 1) SELECT round({agg}, 9)::DOUBLE AS auc FROM a"


@query("d25_roc_auc_ovr", OVR.format(P4=P4, agg="avg(auc)"))
def d25_ovr(spark, d):
    return rounded(M.roc_auc_ovr(probabilities(spark, d).withColumn("y", F.col("label") % 4), "y", "p"), "auc", digits=9)


@query("d25_roc_auc_weighted", OVR.format(P4=P4, agg="sum(auc * n) / sum(n)"))
def d25_weighted(spark, d):
    return rounded(M.roc_auc_ovr(probabilities(spark, d).withColumn("y", F.col("label") % 4), "y", "p", weighted=True), "auc", digits=9)


@query("d35_weighted_sweep", f"WITH s AS ({LENGTH}), t AS (SELECT i / 100.0 AS threshold FROM range(1, 100) r(i)), c AS (SELECT threshold, count(*) FILTER (s >= threshold AND y = 1) AS tp, count(*) FILTER (s >= threshold AND y = 0) AS fp, count(*) FILTER (s < threshold AND y = 1) AS fn, count(*) FILTER (s < threshold AND y = 0) AS tn FROM s, t GROUP BY 1), f AS (SELECT *, (CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END * (tp + fn) + CASE WHEN 2 * tn + fp + fn > 0 THEN 2.0 * tn / (2 * tn + fp + fn) ELSE 0 END * (tn + fp)) / (tp + fp + fn + tn) AS f1 FROM c) SELECT threshold::DOUBLE AS threshold, tp, fp, fn, round(f1, 9)::DOUBLE AS f1, row_number() OVER (ORDER BY round(f1, 12) DESC, threshold) = 1 AS best FROM f")
def d35_weighted(spark, d):
    return rounded(M.threshold_sweep(length_scores(spark, d), "y", "s", [i / 100 for i in range(1, 100)], weighted=True), "f1", digits=9)


@query("d26_roc_curve", f"SELECT s AS threshold, round(sum(count(*) FILTER (y = 0)) OVER w / (SELECT count(*) FROM ({LENGTH}) WHERE y = 0), 9)::DOUBLE AS fpr, round(sum(count(*) FILTER (y = 1)) OVER w / (SELECT count(*) FROM ({LENGTH}) WHERE y = 1), 9)::DOUBLE AS tpr FROM ({LENGTH}) GROUP BY s WINDOW w AS (ORDER BY s DESC)")
def d26(spark, d):
    return rounded(M.roc_curve(length_scores(spark, d), "y", "s"), "fpr", "tpr", digits=9)


@query("d27_kappa", f"SELECT round(1 - sum(w * n) / sum(w * e), 9)::DOUBLE AS kappa FROM (SELECT power(y - pred, 2) AS w, n, sum(n) OVER (PARTITION BY y) * sum(n) OVER (PARTITION BY pred) / sum(n) OVER () AS e FROM ({CM}))")
def d27(spark, d):
    return rounded(M.kappa(M.confusion(predictions(spark, d), "y", "pred", K)), "kappa", digits=9)


@query("d28_within_one", f"SELECT round(avg(CASE WHEN abs(pred - y) <= 1 THEN 1.0 ELSE 0.0 END), 9) AS within_one FROM ({PRED})")
def d28(spark, d):
    return rounded(M.within_one(predictions(spark, d), "y", "pred"), "within_one", digits=9)


BINS = f"SELECT ceil(conf * 10)::INT AS bin, count(*) AS n, avg(conf) AS mean_confidence, avg(CASE WHEN pred = y THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({PRED}) WHERE conf > 0 GROUP BY 1"


def with_correct(spark, d):
    return predictions(spark, d).withColumn("correct", (F.col("pred") == F.col("y")).cast("int"))


@query("d29_calibration_error", f"SELECT round(sum(n * 1.0 / (SELECT count(*) FROM embeddings) * abs(accuracy - mean_confidence)), 9)::DOUBLE AS ece FROM ({BINS})")
def d29(spark, d):
    return rounded(M.calibration_error(with_correct(spark, d), "conf", "correct"), "ece", digits=9)


@query("d30_reliability", f"SELECT bin, n, round(mean_confidence, 9) AS mean_confidence, round(accuracy, 9) AS accuracy FROM ({BINS}) WHERE n >= 5")
def d30(spark, d):
    return rounded(M.reliability(with_correct(spark, d), "conf", "correct"), "mean_confidence", "accuracy", digits=9)


@query("d33_mean_std", f"SELECT unit, round(avg(conf), 9) AS mean, round(coalesce(stddev_samp(conf), 0), 9) AS std, count(*) AS n FROM ({PRED}) GROUP BY 1")
def d33(spark, d):
    return rounded(M.mean_std(predictions(spark, d), ["unit"], "conf"), "mean", "std", digits=9)


@query("d43_evaluation_summary", f"SELECT y AS y_true, count(*) AS n, count(*) FILTER (pred = y) AS n_correct FROM ({PRED}) GROUP BY 1")
def d43(spark, d):
    return with_correct(spark, d).groupBy(F.col("y").alias("y_true")).agg(F.count(F.lit(1)).alias("n"), F.sum("correct").cast("long").alias("n_correct"))


def probabilities(spark, d):
    x = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 5)
    return table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("unit"), "label", S.softmax(x).alias("p"))


def unit_sql(agg, source=P4):
    return f"SELECT unit, k::INT AS k, round(p / sum(p) OVER (PARTITION BY unit), 9) AS p FROM (SELECT unit, k, {agg} AS p FROM ({source}) GROUP BY 1, 2)"


def unit_query(name, how, sql):
    @query(name, sql)
    def run(spark, d):
        return rounded(M.unit_probabilities(probabilities(spark, d), "unit", "p", how), "p", digits=9)

    return run


unit_query("d20_unit_mean", "mean", unit_sql("avg(x)"))
unit_query("d20_unit_median", "median", unit_sql("quantile_cont(x, 0.5)"))
unit_query("d20_unit_logmean", "logmean", unit_sql("exp(avg(ln(greatest(x, 1e-6))))"))
unit_query("d20_unit_trimmed", "trimmed", unit_sql("avg(x)", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit, k ORDER BY x) AS r, floor(count(*) OVER (PARTITION BY unit, k) * 0.2) AS c, count(*) OVER (PARTITION BY unit, k) AS n FROM ({P4})) WHERE r > c AND r <= n - c"))
unit_query("e7_top_by_confidence", "top", unit_sql("avg(x)", f"SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY unit ORDER BY c DESC, vec_id) AS r FROM (SELECT *, max(x) OVER (PARTITION BY vec_id) AS c FROM ({P4}))) WHERE r <= 8"))


@query("d21_unit_statistics", f"SELECT unit, k::INT AS k, round(avg(x), 9) AS mean, round(max(x), 9) AS max, round(coalesce(stddev_samp(x), 0), 9) AS std FROM ({P4}) GROUP BY 1, 2")
def d21(spark, d):
    return rounded(M.unit_statistics(probabilities(spark, d), "unit", "p"), "mean", "max", "std", digits=9)


@query("d22_unit_plain_mean", f"SELECT unit, round(avg(x) FILTER (k = 0), 9) AS p0, round(avg(x) FILTER (k = 1), 9) AS p1, round((SELECT avg(label) FROM embeddings e WHERE e.vec_id % 50 = p.unit))::INT AS y FROM ({P4}) p GROUP BY 1")
def d22(spark, d):
    p = probabilities(spark, d)
    return rounded(p.groupBy("unit").agg(F.avg(F.col("p")[0]).alias("p0"), F.avg(F.col("p")[1]).alias("p1"), F.round(F.avg("label")).cast("int").alias("y")), "p0", "p1", digits=9)


OVER = "SELECT vec_id, list_transform(range(0, 3), lambda k: 1 / (1 + exp(-5 * embedding[k + 1]::DOUBLE))) AS q FROM embeddings"


@query("e8_monotone_thresholds", f"SELECT vec_id, round(q[1], 9) AS q0, round(least(q[1], q[2]), 9) AS q1, round(least(q[1], q[2], q[3]), 9) AS q2 FROM ({OVER})")
def e8(spark, d):
    from pyspark.sql import Window as W

    q = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.slice("embedding", 1, 3), lambda v: 1 / (1 + F.exp(-5 * v.cast("double"))))).alias("k", "q"))
    run = q.withColumn("q", F.min("q").over(W.partitionBy("vec_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)))
    return rounded(run.groupBy("vec_id").pivot("k", [0, 1, 2]).agg(F.first("q")).withColumnsRenamed({"0": "q0", "1": "q1", "2": "q2"}), "q0", "q1", "q2", digits=9)


@query("g9_ordinal_probabilities", f"SELECT vec_id, round(greatest(1 - a, 1e-6) / t, 9) AS p0, round(greatest(a - b, 1e-6) / t, 9) AS p1, round(greatest(b - c, 1e-6) / t, 9) AS p2, round(greatest(c, 1e-6) / t, 9) AS p3 FROM (SELECT *, greatest(1 - a, 1e-6) + greatest(a - b, 1e-6) + greatest(b - c, 1e-6) + greatest(c, 1e-6) AS t FROM (SELECT vec_id, q[1] AS a, least(q[1], q[2]) AS b, least(q[1], q[2], q[3]) AS c FROM ({OVER})))")
def g9(spark, d):
    q = F.transform(F.slice("embedding", 1, 3), lambda v: 1 / (1 + F.exp(-5 * v.cast("double"))))
    p = table(spark, d, "embeddings").select("vec_id", S.ordinal_probabilities(q).alias("p"))
    return rounded(p.select("vec_id", *[F.col("p")[i].alias(f"p{i}") for i in range(4)]), *[f"p{i}" for i in range(4)], digits=9)


@query("g4_argmax_softmax", f"SELECT vec_id, arg_max(k, x)::INT AS cls, round(max(x), 9) AS top FROM ({P4}) GROUP BY 1")
def g4(spark, d):
    return probabilities(spark, d).select("vec_id", S.argmax(F.col("p")).alias("cls"), F.round(F.array_max("p"), 9).alias("top"))


@query("g5_vector_functions", "SELECT vec_id, round(list_inner_product(v, list_reverse(v)), 6) AS flip_dot, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(list_inner_product(c, c), 6) AS centred_square FROM (SELECT vec_id, v, list_transform(v, lambda x: x - list_avg(v)) AS c FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings))")
def g5(spark, d):
    v = F.col("embedding")
    c = S.centred(v)
    return table(spark, d, "embeddings").select("vec_id", F.round(S.dot(v, F.reverse(v)), 6).alias("flip_dot"), F.round(F.sqrt(S.dot(v, v)), 6).alias("norm"), F.round(S.dot(c, c), 6).alias("centred_square"))


@query("g6_class_map", f"SELECT vec_id, round(max(x) FILTER (k = 1), 9) AS prob_b, round(max(x) FILTER (k = 3), 9) AS prob_d FROM ({P4}) GROUP BY 1")
def g6(spark, d):
    m = probabilities(spark, d).select("vec_id", F.to_json(S.class_map(["a", "b", "c", "d"], F.col("p"))).alias("j"))
    m = m.select("vec_id", F.from_json("j", "map<string,double>").alias("m"))
    return m.select("vec_id", F.round(F.col("m")["b"], 9).alias("prob_b"), F.round(F.col("m")["d"], 9).alias("prob_d"))


@query("g7_decision", f"SELECT vec_id, CASE WHEN x >= 0.3 THEN 1 ELSE 0 END AS predicted, round(CASE WHEN x >= 0.3 THEN x ELSE 1 - x END, 9) AS risk, round(abs(x - 0.5), 9) AS margin, abs(x - 0.5) < 0.1 AS uncertain FROM ({P4}) WHERE k = 0")
def g7(spark, d):
    x = probabilities(spark, d).select("vec_id", S.decision(F.col("p")[0], 0.3).alias("d")).select("vec_id", "d.*")
    return rounded(x, "risk", "margin", digits=9)


@query("g8_align_classes", f"SELECT vec_id, round(max(x) FILTER (k = 2), 9) AS p0, 0.0::DOUBLE AS p1, round(max(x) FILTER (k = 0), 9) AS p2 FROM ({P4}) GROUP BY 1")
def g8(spark, d):
    known = F.array(F.lit("x"), F.lit("y"), F.lit("z"), F.lit("w"))
    a = probabilities(spark, d).select("vec_id", S.align_classes(known, F.col("p"), ["z", "absent", "x"]).alias("a"))
    return a.select("vec_id", F.round(F.col("a")[0], 9).alias("p0"), F.col("a")[1].alias("p1"), F.round(F.col("a")[2], 9).alias("p2"))


@query("g10_temperature", "SELECT vec_id, round(exp(embedding[1]::DOUBLE / 2) / (exp(embedding[1]::DOUBLE / 2) + exp(embedding[2]::DOUBLE / 2) + exp(embedding[3]::DOUBLE / 2)), 9) AS p0 FROM embeddings")
def g10(spark, d):
    x = F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", F.round(S.softmax(x, 2.0)[0], 9).alias("p0"))


@query("g11_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, 'v' || strftime(ts, '%Y%m%d') AS version FROM events")
def g11(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.concat(F.lit("v"), F.date_format("ts", "yyyyMMdd")).alias("version"))


#: Resamples of D36 and D37.
N_B = 1000


def draw_sql(pred):
    return f"SELECT b, y, {pred} AS pred, count(*) AS n FROM (SELECT b, (('0x' || substr(md5('0|' || b || '|' || i), 1, 8))::BIGINT % nu) AS rank FROM range(0, {N_B}) x(b), (SELECT count(DISTINCT unit) AS nu FROM ({PRED})), range(0, 50) z(i) WHERE i < nu) JOIN (SELECT unit, row_number() OVER (ORDER BY unit) - 1 AS rank FROM (SELECT DISTINCT unit FROM ({PRED}))) USING (rank) JOIN ({PRED}) USING (unit) GROUP BY 1, 2, 3"


def macro_sql(pred):
    c = draw_sql(pred)
    return f"SELECT b, avg(2.0 * coalesce(tp, 0) / (coalesce(su, 0) + coalesce(pr, 0))) AS v FROM (SELECT b, y, sum(n) AS su, sum(n) FILTER (y = pred) AS tp FROM ({c}) GROUP BY 1, 2) FULL JOIN (SELECT b, pred AS y, sum(n) AS pr FROM ({c}) GROUP BY 1, 2) USING (b, y) GROUP BY 1"


@query("d36_bootstrap_interval", f"SELECT round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi FROM ({macro_sql('pred')})")
def d36(spark, d):
    return rounded(B.metric_interval(predictions(spark, d), "unit", "y", "pred", n_resamples=N_B), "mean", "lo", "hi", digits=9)


@query("d36_bootstrap_poisson")
def d36_poisson(spark, d):
    counts = B.poisson_counts(predictions(spark, d), "unit", "y", "pred", 10, 2000)
    return B.interval(M.classification(counts, ["b"]), "accuracy")


@query("d37_paired_difference", f"SELECT round(avg(x), 9) AS mean, round(quantile_cont(x, 0.025), 9) AS lo, round(quantile_cont(x, 0.975), 9) AS hi, round(least(1.0, 2 * least(avg(CASE WHEN x <= 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN x >= 0 THEN 1.0 ELSE 0 END))), 9)::DOUBLE AS p, quantile_cont(x, 0.025) > 0 OR quantile_cont(x, 0.975) < 0 AS distinguishable FROM (SELECT p.v - q.v AS x FROM ({macro_sql('pred')}) p JOIN ({macro_sql('other')}) q USING (b))")
def d37(spark, d):
    p = predictions(spark, d)
    x = B.paired_difference(p.select("unit", "y", "pred"), p.select("unit", "y", F.col("other").alias("pred")), "unit", "y", "pred", n_resamples=N_B)
    return rounded(x, "mean", "lo", "hi", "p", digits=9)


@query("d36_bootstrap_split")
def d36_split(spark, d):
    return B.metric_interval(predictions(spark, d), "unit", "y", "pred", n_resamples=2000, how="split")


@query("d37_paired_split")
def d37_split(spark, d):
    p = predictions(spark, d)
    return B.paired_difference(p.select("unit", "y", "pred"), p.select("unit", "y", F.col("other").alias("pred")), "unit", "y", "pred", n_resamples=2000, how="split")


@query("c16_paired_join", f"SELECT vec_id, pred, other, pred = y AND other <> y AS first_only FROM ({PRED})")
def c16(spark, d):
    p = predictions(spark, d)
    a, b = p.select("vec_id", "y", "pred"), p.select("vec_id", "other")
    return a.join(b, "vec_id").select("vec_id", "pred", "other", ((F.col("pred") == F.col("y")) & (F.col("other") != F.col("y"))).alias("first_only"))


#: A registry of runs: accuracies of five scorers by fold.
REG = "SELECT 'm' || m AS method, 'f' || (m % 3) AS family, f AS fold, round(avg(CASE WHEN ('0x' || substr(md5(m || '|' || vec_id), 1, 4))::INT % 100 < 40 + 8 * m THEN 1.0 ELSE 0.0 END), 9) AS score, count(*) AS n FROM embeddings, range(0, 5) x(m), range(0, 5) y(f) WHERE vec_id % 5 = f GROUP BY ALL"


def registry(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("fold")).withColumn("m", F.explode(F.array(*[F.lit(i) for i in range(5)])))
    h = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("m").cast("string"), F.col("vec_id").cast("string"))), 1, 4), 16, 10).cast("int"), F.lit(100))
    r = e.groupBy("m", "fold").agg(F.round(F.avg((h < 40 + 8 * F.col("m")).cast("double")), 9).alias("score"), F.count(F.lit(1)).alias("n"))
    return r.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("method"), F.concat(F.lit("f"), (F.col("m") % 3).cast("string")).alias("family"), "fold", "score", "n")


@query("e5_best_per_fold", f"SELECT method, family, fold, score, n FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, method) AS r FROM ({REG})) WHERE r = 1")
def e5(spark, d):
    return L.best_per_fold(registry(spark, d), ["fold"], "score", "method")


@query("e6_best_of_families", f"SELECT method, family, fold, score, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, method) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY fold, family ORDER BY score DESC, method) AS r FROM ({REG})) WHERE r = 1) WHERE rank <= 2")
def e6(spark, d):
    return L.best_of_families(registry(spark, d), ["fold"], "family", "score", "method", 2)


@query("d40_selection_frequency", f"SELECT method, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, method) AS r FROM ({REG})) WHERE r = 1 GROUP BY 1")
def d40(spark, d):
    return L.selection_frequency(L.best_per_fold(registry(spark, d), ["fold"], "score", "method"), "method")


@query("d41_comparison", f"SELECT method, mean, lowest, row_number() OVER (ORDER BY mean DESC, method) = 1 AS winner FROM (SELECT method, round(avg(score), 9) AS mean, min(score) AS lowest FROM ({REG}) GROUP BY 1)")
def d41(spark, d):
    r = registry(spark, d).groupBy("method").agg(F.round(F.avg("score"), 9).alias("mean"), F.min("score").alias("lowest"))
    long = r.select("method", F.explode(F.create_map(F.lit("mean"), F.col("mean"), F.lit("lowest"), F.col("lowest"))).alias("metric", "value"))
    return L.comparison(long, "method", "metric", "value", ["mean", "lowest"], "mean")


@query("d42_best_config", f"SELECT method, fold, score, n FROM ({REG}) ORDER BY score DESC, n, method || fold LIMIT 1")
def d42(spark, d):
    r = registry(spark, d).withColumn("key", F.concat("method", F.col("fold").cast("string")))
    return L.best_config(r, "score", "n", "key").select("method", "fold", "score", "n")


@query("h19_ensemble", f"SELECT unit, round(avg(x) FILTER (k = 0), 9) AS p0, round(avg(x) FILTER (k = 3), 9) AS p3 FROM ({P4}) GROUP BY 1")
def h19(spark, d):
    e = L.ensemble(probabilities(spark, d), ["unit"], "p")
    return e.select("unit", F.round(F.col("p")[0], 9).alias("p0"), F.round(F.col("p")[3], 9).alias("p3"))


@query("h20_auto_select", f"WITH c AS (SELECT fold, method FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY score DESC, method) AS r FROM ({REG})) WHERE r = 1) SELECT vec_id, method FROM embeddings JOIN c ON vec_id % 5 = fold")
def h20(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 5).alias("fold")).withColumn("method", F.explode(F.array(*[F.lit(f"m{i}") for i in range(5)])))
    return L.auto_select(registry(spark, d), e, ["fold"], "score", "method").select("vec_id", "method")


@query("h18_temperature", f"WITH t AS (SELECT round(0.25 + i * 0.25, 2) AS temperature FROM range(0, 32) r(i)), s AS (SELECT vec_id, label % 4 AS y, list_transform(range(1, 5), lambda j: embedding[j]::DOUBLE * 5) AS x FROM embeddings), n AS (SELECT temperature, avg(ln(list_sum(list_transform(x, lambda v: exp(v / temperature)))) - x[y + 1] / temperature) AS nll FROM s, t GROUP BY 1) SELECT temperature::DOUBLE AS temperature, round(nll, 6) AS nll FROM n ORDER BY n.nll LIMIT 1")
def h18(spark, d):
    from ..operators.ml import fit_temperature

    e = table(spark, d, "embeddings").select((F.col("label") % 4).alias("y"), F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 5).alias("x"))
    return rounded(fit_temperature(e, "x", "y", [round(0.25 + i * 0.25, 2) for i in range(32)]), "nll")
