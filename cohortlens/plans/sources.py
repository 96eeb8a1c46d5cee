"""Queries of sources, sinks, images and streams."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import image, similarity
from ..registry import query
from ..sources import io
from ..sources.tables import table
from ..streaming import incoming
from .profile import rounded


def folder(spark, name):
    """A new folder in the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("a1_csv_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def a1(spark, d):
    c = table(spark, d, "customer")
    path = folder(spark, "csv")
    c.write.option("header", True).csv(path)
    return io.read_csv(spark, path, c.schema)


@query("a2_head", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def a2(spark, d):
    return io.head(table(spark, d, "orders"), 25, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("a3_json_ingest", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE event_id % 7 <> 0 UNION ALL SELECT event_id, (props->>'k')::INT FROM events WHERE event_id % 3 = 0 AND event_id % 7 <> 0")
def a3(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 7 == 0, "none").when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit(","), "props", F.lit("]"))).otherwise(F.col("props"))
    return io.parse_json(e.select("event_id", text.alias("j")), "j", "k:int")[0]


@query("a5_json_rejects", "SELECT event_id, 'not an object' AS reason FROM events WHERE event_id % 7 = 0")
def a5(spark, d):
    e = table(spark, d, "events")
    return io.parse_json(e.select("event_id", F.when(F.col("event_id") % 7 == 0, "none").otherwise(F.col("props")).alias("j")), "j", "k:int")[1].select("event_id", "reason")


@query("a5_csv_rejects", "SELECT event_type, count(*) AS n FROM events WHERE event_id % 11 = 0 GROUP BY 1")
def a5_csv(spark, d):
    path = folder(spark, "bad-csv")
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_id") % 11 == 0, "many").otherwise(F.col("value").cast("string")).alias("value"))
    e.write.option("header", True).csv(path)
    bad = io.read_csv_checked(spark, path, spark.createDataFrame([], "event_type string, value double").schema)[1]
    return bad.groupBy(F.split("text", ",")[0].alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("a4_file_scan")
def a4(spark, d):
    return io.scan_files(spark, d, ["parquet"]).select("class_name", "split", "stem", "bytes", "file_md5")


@query("a6_csv_sink", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def a6(spark, d):
    return io.write_table(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), folder(spark, "sink"), "csv")


@query("a7_metadata_sink", "SELECT 'l_quantity' AS column_name, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def a7(spark, d):
    from ..operators.clean import FitParams

    p = FitParams().fit_ranges(table(spark, d, "lineitem"), ["l_quantity"])
    back = io.write_table(spark.createDataFrame([(p.to_json(),)], "params string"), folder(spark, "params"), "json")
    q = FitParams.from_json(back.first().params)
    return spark.createDataFrame([(c, v[0], v[1]) for c, v in q.ranges.items()], "column_name string, lo double, hi double")


@query("a8_named_table", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def a8(spark, d):
    return io.save_named(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), f"customers_{uuid.uuid4().hex}")


@query("a9_registry", "SELECT event_type AS method, '{\"n\":' || count(*) || '}' AS config, NULL AS note FROM events GROUP BY 1 UNION ALL SELECT event_type, '{\"n\":' || count(*) || '}', NULL FROM events GROUP BY 1")
def a9(spark, d):
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.struct(F.count(F.lit(1)).alias("n")).alias("config"), F.max("value").alias("not_kept"))
    path = folder(spark, "registry")
    io.append_registry(runs, path, ["time", "method", "config", "note"])
    return io.append_registry(runs, path, ["time", "method", "config", "note"]).select("method", "config", "note")


@query("a10_prediction_store", "SELECT vec_id, label, (vec_id % 3)::INT AS repeat FROM embeddings")
def a10(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", (F.col("vec_id") % 3).cast("int").alias("repeat"))
    return io.write_table(e, folder(spark, "oof"), by=["repeat"])


@query("a11_model_bundle")
def a11(spark, d):
    """A pipeline (scaler and model) is saved under its version with threshold, classes and feature order, and served by a pointer to that version."""
    from ..operators import ml

    e = ml.vectors(table(spark, d, "embeddings").withColumn("label", (F.col("label") >= 5).cast("double")), "embedding")
    path = folder(spark, "bundle")
    model = ml.pipeline(ml.features_in_fold(8), ml.classifier("logistic", e.count(), maxIter=5)).fit(e)
    io.save_bundle(spark, path, "v1", model, {"threshold": 0.4, "classes": ["0", "1"], "features": ["embedding"]})
    served, meta = io.load_bundle(spark, path)
    p = served.transform(e).select("vec_id", vector_to_array("probability")[1].alias("p"))
    return p.select("vec_id", (F.col("p") >= meta.threshold).cast("int").alias("prediction"), F.lit(meta.version).alias("version"))


@query("a12_content_cache", "SELECT md5(text) AS md5, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def a12(spark, d):
    return io.content_cache(table(spark, d, "documents").select("doc_id", F.md5("text").alias("md5")), "md5", "doc_id").select("md5", "doc_id")


@query("a13_remaining_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def a13(spark, d):
    return io.remaining(table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("a14_evaluate_once", "SELECT DISTINCT event_type AS method FROM events WHERE event_type NOT IN ('click', 'view')")
def a14(spark, d):
    run = table(spark, d, "events").select(F.col("event_type").alias("method")).distinct()
    return io.evaluate_once(run.filter(F.col("method").isin("click", "view")), run, ["method"])


@query("a15_manifest", "SELECT page_id, CASE WHEN page_id % 3 <> 0 THEN 'out/' || page_id END AS output_path, CASE WHEN page_id % 3 <> 0 THEN 'written' ELSE 'failed' END AS status FROM pages")
def a15(spark, d):
    p = table(spark, d, "pages").select("page_id")
    return io.manifest(p, p.filter("page_id % 3 <> 0").withColumn("output_path", F.concat(F.lit("out/"), F.col("page_id").cast("string"))), "page_id")


@query("a16_comparison_report", "SELECT event_type, printf('%.3f [%.3f, %.3f]', avg(value) - 40, min(value) - 1, max(value) - 40) AS estimate, CASE WHEN min(value) - 1 > 0 OR max(value) - 40 < 0 THEN 'yes' ELSE 'no' END AS differs FROM events GROUP BY 1")
def a16(spark, d):
    e = table(spark, d, "events").groupBy("event_type").agg((F.avg("value") - 40).alias("v"), (F.min("value") - 1).alias("lo"), (F.max("value") - 40).alias("hi"))
    return io.comparison_report(e, "event_type", "v", "lo", "hi")


def pixels(spark, d):
    """The embeddings as 8 by 8 images, each pixel drawn 8 by 8."""

    def draw(frames):
        for f in frames:
            out = []
            for i, v in f.itertuples(index=False):
                a = np.asarray(v, np.float64).reshape(8, 8)
                out.append((str(i), 64, 64, np.kron(np.clip(a * 300 + 60, 0, 255).astype(np.uint8), np.ones((8, 8), np.uint8)).tobytes()))
            yield pd.DataFrame(out, columns=["id", "height", "width", "data"])

    return image.by_pieces(table(spark, d, "embeddings").select("vec_id", "embedding"), draw, image.PIXELS)


@query("k1_describe")
def k1(spark, d):
    return image.describe(pixels(spark, d)).select("id", "height", "width", "pixel_md5", F.round("mean_intensity", 6).alias("mean_intensity"), F.round("frac_black", 6).alias("frac_black"))


@query("k2_perceptual_hashes")
def k2(spark, d):
    return image.describe(pixels(spark, d)).select("id", "dhash", "phash", "phash_flip", S.hamming(F.col("phash"), F.col("phash_flip")).alias("distance"))


@query("k3_standardise")
def k3(spark, d):
    return image.standardised(pixels(spark, d), 32).select("id", "height", "width", F.md5("data").alias("md5"))


K4 = "SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE - list_min(embedding)::DOUBLE) / (list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE)) AS v FROM embeddings"


def unit_range(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", image.normalised(v).alias("v"))


@query("k4_intensity_normalise", f"SELECT vec_id, round(v[1], 9) AS first, round(list_sum(v), 6) AS total FROM ({K4})")
def k4(spark, d):
    return unit_range(spark, d).select("vec_id", F.round(F.col("v")[0], 9).alias("first"), F.round(S.total(F.col("v")), 6).alias("total"))


@query("k5_intensity_discretise", f"SELECT vec_id, round(list_sum(list_transform(v, lambda x: least(floor(x * 8), 7) / 7)), 6) AS total FROM ({K4})")
def k5(spark, d):
    return unit_range(spark, d).select("vec_id", F.round(S.total(image.discretised(F.col("v"), 8)), 6).alias("total"))


@query("k6_feature_vectors")
def k6(spark, d):
    return image.feature_vectors(pixels(spark, d), 8).select("id", F.size("vec").alias("n"), F.round(S.total(F.transform("vec", lambda x: x.cast("double"))), 4).alias("total"))


@query("k7_global_features")
def k7(spark, d):
    return rounded(image.describe(pixels(spark, d)).select("id", "mask_mean", "mask_std", "mask_share"), "mask_mean", "mask_std", "mask_share")


@query("k8_handcrafted")
def k8(spark, d):
    x = image.handcrafted(pixels(spark, d))
    return rounded(x, *[c for c in x.columns if c != "id"])


@query("k9_augment")
def k9(spark, d):
    return image.augmented(pixels(spark, d), 2).select("id", "height", "width", F.md5("data").alias("md5"))


@query("k10_stacked_slices", "SELECT vec_id, round(coalesce(lag(x) OVER w, x), 6) AS a, round(x, 6) AS b, round(coalesce(lead(x) OVER w, x), 6) AS c FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def k10(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    t = similarity.triple(e, "label", "vec_id", "x").select("vec_id", F.array("previous", "x", "following").alias("s"))
    return t.select("vec_id", *[F.round(F.col("s")[i], 6).alias(n) for i, n in enumerate("abc")])


@query("h27_image_prediction")
def h27(spark, d):
    from ..operators import ml

    x = image.feature_vectors(image.standardised(pixels(spark, d), 32), 8)
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("label").cast("double").alias("label"))
    x = ml.vectors(x.join(e, "id"), "vec")
    p = ml.classifier("naive_bayes").fit(x).transform(x)
    from pyspark.ml.functions import vector_to_array

    q = p.select("id", vector_to_array("probability").alias("p"))
    return q.select("id", S.argmax(F.col("p")).alias("predicted_class"), F.round(F.array_max("p"), 6).alias("confidence"))


def replay(spark, d):
    """events as JSON lines in a few files, and their schema."""
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("ID"), F.col("ts").cast("timestamp").alias("TIME"), F.col("user_id").alias("USER"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("VAL"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("KIND"))
    path = folder(spark, "incoming")
    e.repartition(6, "USER").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)
    return path, e.schema


NAMES = {"ID": "id", "TIME": "ts", "USER": "user_id", "VAL": "value", "VALUE": "value", "KIND": "kind"}


def stream(spark, d):
    path, schema = replay(spark, d)
    return incoming.incoming(spark, path, schema, NAMES, "id")


@query("i1_incoming_stream", "SELECT user_id, count(*) AS n, count(*) FILTER (event_id % 5 = 0) AS made_ids, round(sum(CASE WHEN event_id % 6 <> 0 THEN value END), 4) AS total FROM events GROUP BY 1")
def i1(spark, d):
    out = folder(spark, "rows")
    incoming.run_now(stream(spark, d), out, folder(spark, "check"))
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length("id") == 12).alias("made_ids"), F.round(F.sum("value"), 4).alias("total"))


def band(df):
    """The projection that batch and stream share."""
    p = 1 / (1 + F.exp(-(F.coalesce("value", F.lit(0.0)) - 50) / 25))
    x = df.withColumn("d", S.decision(p))
    return x.select("user_id", "ts", F.round(p, 6).alias("p"), "d.predicted", "d.uncertain")


SCORED = "SELECT user_id, ts, round(p, 6) AS p, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS predicted, abs(p - 0.5) < 0.1 AS uncertain FROM (SELECT user_id, ts, 1 / (1 + exp(-(CASE WHEN event_id % 6 <> 0 THEN value ELSE 0 END - 50) / 25)) AS p FROM events)"


@query("i2_score_stream", SCORED)
def i2(spark, d):
    out = folder(spark, "scores")
    incoming.score_and_emit(stream(spark, d), band, out, folder(spark, "check"))
    return spark.read.parquet(out)


@query("i2_score_batch", SCORED)
def i2_batch(spark, d):
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 6 != 0, F.col("value")))
    return band(e)


@query("i3_reject_stream", "SELECT event_id % 12 = 0 AS rejected, count(*) AS n FROM events GROUP BY 1")
def i3(spark, d):
    good, bad = folder(spark, "good"), folder(spark, "bad")
    incoming.with_rejects(stream(spark, d), ["value", "kind"], good, bad, folder(spark, "check"))
    rows = spark.read.parquet(good).select(F.lit(False).alias("rejected")).unionAll(spark.read.parquet(bad).select(F.lit(True).alias("rejected")))
    return rows.groupBy("rejected").agg(F.count(F.lit(1)).alias("n"))


@query("i4_latest_snapshot", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def i4(spark, d):
    """All files in one micro-batch: the snapshot is the whole upload."""
    path, schema = replay(spark, d)
    out = folder(spark, "snapshot")
    incoming.latest_snapshot(incoming.incoming(spark, path, schema, NAMES, "id", files_per_batch=1000), out, folder(spark, "check"))
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("i5_once_per_id", "SELECT user_id, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1")
def i5(spark, d):
    path, schema = replay(spark, d)
    s = incoming.incoming(spark, path, schema, NAMES, "id", files_per_batch=1000)
    twice = s.filter(F.length("id") < 12).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    out = folder(spark, "once")
    incoming.run_now(incoming.once_per_id(twice, "id", "ts", "60 days"), out, folder(spark, "check"))
    return spark.read.parquet(out).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("i_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def i_windows(spark, d):
    """The windowed count of a stream, on a static frame: the same rows."""
    return incoming.windowed_counts(table(spark, d, "events"), "ts", "event_type")
