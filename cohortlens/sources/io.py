"""Sources and sinks: explicit schemas in, rejects apart, results out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .long_files import PACKED, long_md5

# File extensions of images.
IMAGE_TYPES = ["png", "jpg", "jpeg", "bmp", "tif", "tiff"]
# Bytes from which a file is read by splits (Spark's own split), and that a task chains of one.
LONG, STEP = 128 << 20, 256 << 20


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A1: a CSV with a header and a given schema."""
    return spark.read.schema(schema).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """A5: good rows, and rows that don't fit the schema as (text, error)."""
    whole = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    # Spark doesn't answer queries on the corrupt column alone from the file: both parts read the parsed rows.
    rows = spark.read.schema(whole).option("header", True).option("columnNameOfCorruptRecord", "_bad").option("enforceSchema", False).csv(path).persist()
    return rows.filter("_bad is null").drop("_bad"), rows.filter("_bad is not null").select(F.col("_bad").alias("text"), F.lit("doesn't fit the schema").alias("error"))


def head(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """A2: the first n rows by a key."""
    return df.orderBy(*key).limit(n)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A3: files that hold one object or an array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def parse_json(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """A3: text with one object or an array of objects -> one row each; texts that are neither are rejected with a reason."""
    t = F.trim(F.coalesce(F.col(column), F.lit("")))
    items = F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})
    x = df.withColumn("__items", items).withColumn("__form", F.when(t.startswith("{") | t.startswith("["), "ok").when(t == "", "empty").otherwise("not an object"))
    good = x.filter((F.col("__form") == "ok") & (F.size("__items") > 0)).withColumn("__item", F.explode("__items")).select(*[c for c in df.columns if c != column], "__item.*")
    return good, x.filter((F.col("__form") != "ok") | (F.coalesce(F.size("__items"), F.lit(0)) <= 0)).select(*df.columns, F.col("__form").alias("reason"))


def scan_files(spark: SparkSession, path: str, types: Sequence[str] = IMAGE_TYPES, long: int = LONG, step: int = STEP) -> DataFrame:
    """A4: all files below a folder: path, class (parent folder), split (its parent), stem, bytes, md5, content.

    Files of more than ``long`` bytes are read by splits, no task takes more than about ``step`` bytes of one, and their md5 needs no
    cell for the whole; ``content``, if it is selected, does. Packed files stay whole. Long files are read when this is called.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ending = lambda c, of: F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1)).isin(list(of))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    told = ["path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("class_name"), F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("split"), F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), F.col("length").alias("bytes")]
    whole = lambda f: f.select(*told, F.md5("content").alias("file_md5"), "content")
    packed = [t for t in types if t in PACKED]
    by_split = [t for t in types if t not in PACKED]
    out = whole(files.filter((F.col("length") <= long) & ending("path", types)))
    if packed:
        out = out.unionByName(whole(files.filter((F.col("length") > long) & ending("path", packed))))
    far = files.filter((F.col("length") > long) & ending("path", by_split))
    listed = [(r.file_path, r.length) for r in far.select("_metadata.file_path", "length").collect()]
    if not listed:
        return out
    wanted = (F.col("_metadata.file_size") > long) & ending("_metadata.file_path", by_split)
    sums = long_md5(spark, path, listed, wanted, step)
    chained = far.select(*told, "content", F.col("_metadata.file_path").alias("__file")).join(F.broadcast(sums), "__file")
    return out.unionByName(chained.select(*out.columns))


def decode_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A4, A5: decoded images (origin, height, width, nChannels, data) and those that can't be read, with a reason."""
    im = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(path).select("image.*")
    return im.filter("width > 0"), im.filter("width <= 0").select("origin", F.lit("can't be decoded").alias("error"))


def write_table(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> DataFrame:
    """Replace what is there and read it back."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).option("header", True).format(form).save(path)
    r = df.sparkSession.read.schema(df.schema).option("header", True).format(form)
    return r.load(path)


def save_named(df: DataFrame, name: str) -> DataFrame:
    """Replace a named table."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def append_registry(df: DataFrame, path: str, fields: Sequence[str]) -> DataFrame:
    """Append rows with exactly these fields; nested values as JSON text, the time of writing in ``time``; extra columns are left out."""
    out = []
    for f in fields:
        if f == "time":
            out.append(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("time"))
        elif f not in df.columns:
            out.append(F.lit(None).cast("string").alias(f))
        elif isinstance(df.schema[f].dataType, (T.StructType, T.ArrayType, T.MapType)):
            out.append(F.to_json(f).alias(f))
        else:
            out.append(F.col(f))
    rows = df.select(*out)
    rows.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that isn't done yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def evaluate_once(registry: DataFrame, run: DataFrame, keys: Sequence[str], force: bool = False) -> DataFrame:
    """The rows of ``run`` that may be evaluated on the test split: those that weren't yet, or all if forced."""
    return run if force else remaining(run, registry, keys)


def content_cache(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per content hash, the first by ``order``; unreadable rows (null hash) are left out."""
    w = W.partitionBy(key).orderBy(order)
    return df.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def manifest(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """One row per input and output; inputs without output have failed."""
    made = outputs.select(F.col(key), F.col("output_path"), F.lit("written").alias("status"))
    return inputs.join(made, key, "left").withColumn("status", F.coalesce("status", F.lit("failed")))


def comparison_report(df: DataFrame, name: str, value: str, lo: str, hi: str) -> DataFrame:
    """``x.xxx [lo, hi]`` and whether 0 is outside; best first."""
    return df.orderBy(F.desc(value), name).select(name, F.format_string("%.3f [%.3f, %.3f]", value, lo, hi).alias("estimate"), F.when((F.col(lo) > 0) | (F.col(hi) < 0), "yes").otherwise("no").alias("differs"))


def save_bundle(spark: SparkSession, path: str, version: str, model, meta: dict) -> None:
    """The fitted pipeline and its meta data under ``path/<version>``; ``path/served`` names the version in use."""
    model.write().overwrite().save(f"{path}/{version}/model")
    for name, row in ((f"{version}/meta", meta | {"version": version}), ("served", {"version": version})):
        spark.createDataFrame([Row(**row)]).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, Row]:
    """The pipeline that is served, and its meta data."""
    version = spark.read.json(f"{path}/served").first().version
    return PipelineModel.load(f"{path}/{version}/model"), spark.read.json(f"{path}/{version}/meta").first()
