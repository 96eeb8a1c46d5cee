"""Cleaning: renames, coercion, encodings, and fitted transformations that never see rows they weren't fitted on."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import numbered, running
from .profile import aggregate_columns
from .quantiles import fitted
from .scratch import stored


def drop_identifiers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """B1: without these columns; those that aren't there are no error."""
    return df.drop(*columns)


def rename_aliases(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """B2: alias -> name. Where several spellings are there the first non-null in the order of ``names`` counts (the name itself first)."""
    out, made = [], set()
    for c in df.columns:
        to = names.get(c, c)
        if to in made:
            continue
        made.add(to)
        spellings = [to, *(a for a, n in names.items() if n == to)]
        present = [F.col(f"`{s}`") for s in spellings if s in df.columns]
        out.append((F.coalesce(*present) if len(present) > 1 else present[0]).alias(to))
    return df.select(*out)


def missing_features(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """The expected columns that aren't there."""
    gone = sorted(set(expected) - set(df.columns))
    return df.sparkSession.createDataFrame([(c,) for c in gone], "feature string")


def missing_keys(df: DataFrame, column: str, expected: Sequence[str]) -> DataFrame:
    """B3, for records kept as JSON text: the expected keys that no record has."""
    seen = df.select(F.explode(F.json_object_keys(column)).alias("feature")).distinct()
    return df.sparkSession.createDataFrame([(c,) for c in expected], "feature string").join(seen, "feature", "left_anti")


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def split_empty_rows(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a value, and rows in which all columns are null or blank."""
    empty = F.lit(True)
    for c in columns:
        empty = empty & blank(c)
    return df.filter(~empty), df.filter(empty)


def surrogate_id(df: DataFrame, id_column: str, length: int = 12) -> DataFrame:
    """A null or blank id becomes the first digits of an md5 of the row: the same on every run."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != id_column]))
    return df.withColumn(id_column, F.coalesce(F.nullif(F.trim(F.col(id_column).cast("string")), F.lit("")), F.substring(F.md5(row), 1, length)))


def impose_features(df: DataFrame, features: Sequence[str], fill: float = 0) -> DataFrame:
    """Exactly these columns in this order; missing ones are filled."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(fill).alias(c) for c in features])


def numeric_majority(df: DataFrame, columns: Sequence[str], share: float = 0.8) -> list[str]:
    """Text columns of which at least max(1, floor(share * non-null)) values are numbers; one pass."""
    if not columns:
        return []
    row = df.agg(*[F.struct(F.count(c).alias("n"), F.count(F.col(c).try_cast("double")).alias("k")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c].k >= max(1, int(share * row[c].n))]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those columns as doubles, what doesn't parse as NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in numeric_majority(df, columns)})


def binary_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, kind: ``binary`` if all non-null values are 0 or 1, ``empty`` without any, else ``other``."""
    x = aggregate_columns(df, columns, {"n": F.count, "odd": lambda c: F.count_if(~c.cast("double").isin(0.0, 1.0))})
    return x.select("column_name", F.when(F.col("n") == 0, "empty").when(F.col("odd") == 0, "binary").otherwise("other").alias("kind"))


@dataclass
class FitParams:
    """What was fitted, for use on other rows. ``to_json`` and ``from_json`` keep it."""

    ranges: dict = field(default_factory=dict)
    fills: dict = field(default_factory=dict)
    bounds: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> FitParams:
        return cls(**json.loads(text))

    def fit_ranges(self, train: DataFrame, columns: Sequence[str]) -> FitParams:
        """Minimum and maximum; a constant or empty column stays unscaled."""
        row = train.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(c) for c in columns]).first()
        self.ranges = {c: [row[c][0], row[c][1], row[c][0] is not None and row[c][0] != row[c][1]] for c in columns}
        return self

    def scale_ranges(self, df: DataFrame, fill: float | None = None, clip: bool = False) -> DataFrame:
        """To 0..1; NULL takes ``fill``, else the minimum, else 0. Values outside the range stay outside unless clipped."""
        out = {}
        for c, (lo, hi, scaled) in self.ranges.items():
            x = F.coalesce(F.col(c).try_cast("double"), F.lit(fill if fill is not None else lo if lo is not None else 0.0).cast("double"))
            x = (x - lo) / (hi - lo) if scaled else x
            out[c] = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if clip and scaled else x
        return df.withColumns(out)

    def fit_fills(self, train: DataFrame, numeric: Sequence[str], text: Sequence[str] = ()) -> FitParams:
        """Exact medians of numeric columns, modes of text columns (ties: the smallest)."""
        medians, modes = fitted(train, numeric, [0.5]), train.agg(*[F.mode(c, True).alias(c) for c in text]).first() if text else {}
        self.fills = {c: medians.get(c, [None])[0] for c in numeric} | {c: modes[c] for c in text}
        return self

    def impute(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in self.fills.items() if v is not None})

    def fit_bounds(self, train: DataFrame, columns: Sequence[str], skip_binary: bool = True, method: str = "iqr", width: float = 1.5) -> FitParams:
        """Quartiles +- 1.5 IQR, or mean +- ``width`` deviations (``zscore``); columns of zeros and ones are left out."""
        flags = {r.column_name for r in binary_columns(train, columns).collect() if r.kind == "binary"} if skip_binary else set()
        use = [c for c in columns if c not in flags]
        if method == "iqr":
            q = fitted(train, use, [0.25, 0.75])
            self.bounds = {c: [q[c][0] - width * (q[c][1] - q[c][0]), q[c][1] + width * (q[c][1] - q[c][0])] for c in use if c in q}
        else:
            row = train.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in use]).first()
            self.bounds = {c: [row[c][0] - width * row[c][1], row[c][0] + width * row[c][1]] for c in use if row[c][0] is not None}
        return self

    def winsorize(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c).cast("double"), F.lit(lo)), F.lit(hi))) for c, (lo, hi) in self.bounds.items()})

    def outlier_counts(self, df: DataFrame) -> DataFrame:
        """How many values each column has outside its bounds."""
        cols = list(self.bounds)
        wide = df.agg(*[F.count_if(~F.col(c).between(*self.bounds[c])).alias(f"n_outliers__{c}") for c in cols])
        return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_outliers__{c}").alias("n_outliers")) for c in cols])).alias("x")).select("x.*")

    def fit_scales(self, train: DataFrame, columns: Sequence[str], robust: bool = False) -> FitParams:
        """Mean and population deviation, or median and IQR."""
        if robust:
            q = fitted(train, columns, [0.25, 0.5, 0.75])
            self.scales = {c: [q[c][1], q[c][2] - q[c][0] or 1.0] for c in columns if c in q}
        else:
            row = train.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in columns]).first()
            self.scales = {c: [row[c][0], row[c][1] or 1.0] for c in columns if row[c][0] is not None}
        return self

    def standardise(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - m) / s for c, (m, s) in self.scales.items()})


def sorted_codes(df: DataFrame, column: str) -> DataFrame:
    """Value -> code by sorted value, from 0."""
    values = df.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return numbered(values, "value", "code").select("value", F.col("code").cast("int").alias("code"))


def appearance_codes(df: DataFrame, column: str, order: str) -> DataFrame:
    """Value -> code by first appearance along ``order``."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("__first"))
    places = sorted_codes(firsts, "__first").select(F.col("value").alias("__first"), "code")
    return firsts.join(places, "__first").select("value", "code")


def encode(df: DataFrame, column: str, codes: DataFrame, unseen: int = -1) -> DataFrame:
    """The column's code; NULL and values that weren't seen get ``unseen`` (only those rows)."""
    out = df.join(codes.select(F.col("value").alias("__value"), F.col("code").alias(f"{column}_code")), F.col(column) == F.col("__value"), "left").drop("__value")
    return out.withColumn(f"{column}_code", F.coalesce(f"{column}_code", F.lit(unseen)))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Alphabetical codes with NULL as a class named ``nan``."""
    return sorted_codes(df.select(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("v")), "v")


def finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinities become NULL."""
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in columns})


def anova_f(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """The F statistic of each feature between the classes, from group sums: one aggregation."""
    sums = [s for f in features for s in (F.sum(F.col(f)).alias(f"s__{f}"), F.sum(F.col(f) * F.col(f)).alias(f"q__{f}"))]
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums)
    aggs = [F.count(F.lit(1)).alias("k"), F.sum("n").alias("n_all")]
    for f in features:
        aggs += [F.sum(F.col(f"s__{f}") * F.col(f"s__{f}") / F.col("n")).alias(f"between__{f}"), F.sum(f"s__{f}").alias(f"t__{f}"), F.sum(f"q__{f}").alias(f"q__{f}")]
    w = g.agg(*aggs)
    row = lambda f: F.struct(
        F.lit(f).alias("feature"),
        (((F.col(f"between__{f}") - F.col(f"t__{f}") * F.col(f"t__{f}") / F.col("n_all")) / (F.col("k") - 1)) / ((F.col(f"q__{f}") - F.col(f"between__{f}")) / (F.col("n_all") - F.col("k")))).alias("f"),
    )
    return w.select(F.explode(F.array(*[row(f) for f in features])).alias("x")).select("x.*")


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of each feature, in equal-width bins, with the class (nats)."""
    edges = df.agg(*[F.struct(F.min(f), F.max(f)).alias(f) for f in features]).first()
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.least(F.floor((F.col(f) - edges[f][0]) * bins / ((edges[f][1] - edges[f][0]) or 1.0)), F.lit(bins - 1)).alias("bin")) for f in features]))
    c = df.select(F.col(label).alias("y"), long.alias("x")).select("y", "x.*").groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    all_, by_bin, by_y = (F.sum("n").over(W.partitionBy(*k)) for k in (["feature"], ["feature", "bin"], ["feature", "y"]))
    return c.withColumn("i", F.col("n") / all_ * F.ln(F.col("n") * all_ / (by_bin * by_y))).groupBy("feature").agg(F.sum("i").alias("mi"))


def digamma(n: Column) -> Column:
    """Of numbers from 1 on: the series at n + 6, less the six steps to it."""
    x = n + 6.0
    steps = [1 / (n + float(i)) for i in range(6)]
    return F.ln(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8) - sum(steps[1:], steps[0])


#: Rows of a run of sorted values in which neighbours are looked for.
RUN = 4096


def neighbour_information(df: DataFrame, features: Sequence[str], label: str, key: str, k: int = 3) -> DataFrame:
    """Feature, mi: mutual information of each feature with the class (nats) from nearest neighbours, at least 0.

    A row's radius is the distance to its k-th neighbour of its own class (all others, if fewer); how many rows of any class are
    strictly inside it (at no distance, if the radius is 0), against what the class alone would give, tells the information.
    Rows with a NULL or NaN are left out of that feature, and so are classes with one row there. Ids are distinct. Values are
    sorted in slices and cut into runs that overlap by k; ranks of the two ends of a radius come from one more sorted pass.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    rows = df.filter(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("y"), each.alias("e")).select("id", "y", "e.*").filter("x is not null and not isnan(x)")
    of_class = rows.groupBy("feature", "y").agg(F.count(F.lit(1)).alias("ny")).filter("ny > 1")
    rows = stored(rows.join(of_class, ["feature", "y"]).withColumn("at", F.struct("x", "id")), "values")
    placed = stored(running(rows.withColumn("one", F.lit(1).cast("long")), "at", ["one"], ["feature", "y"]).select("feature", "y", "id", "x", "ny", F.col("before_one").alias("place")), "places")
    runs = F.explode(F.sequence(F.greatest(F.floor((F.col("place") - k) / RUN), F.lit(0)), F.floor((F.col("place") + k) / RUN)))
    w = W.partitionBy("feature", "y", "run").orderBy("place")
    sides = {f"l{j}": F.coalesce(F.col("x") - F.lag("x", j).over(w), F.lit(float("inf"))) for j in range(1, k + 1)} | {f"r{j}": F.coalesce(F.lead("x", j).over(w) - F.col("x"), F.lit(float("inf"))) for j in range(1, k + 1)}
    near = placed.withColumn("run", runs).withColumns(sides).filter(F.floor(F.col("place") / RUN) == F.col("run"))
    left, right = F.array(F.lit(0.0), *[F.col(f"l{j}") for j in range(1, k + 1)]), F.array(F.lit(0.0), *[F.col(f"r{j}") for j in range(1, k + 1)])
    kth = F.least(F.lit(k), F.col("ny") - 1).cast("int")
    radius = F.array_min(F.transform(F.sequence(F.lit(0), kth), lambda j: F.greatest(left[j], right[kth - j])))
    near = near.select("feature", "id", "x", "ny", kth.alias("k"), radius.alias("r"))
    # 1 is a value; what is asked stands before (0) or after (2) the values that it equals.
    zero = F.col("r") == 0
    marks = F.explode(F.array(F.struct(F.col("x").alias("v"), F.lit(1).alias("kind"), F.lit(0).alias("sign")), F.struct((F.col("x") - F.col("r")).alias("v"), F.when(zero, 0).otherwise(2).alias("kind"), F.lit(-1).alias("sign")), F.struct((F.col("x") + F.col("r")).alias("v"), F.when(zero, 2).otherwise(0).alias("kind"), F.lit(1).alias("sign"))))
    marked = near.withColumn("m", marks).select("feature", "id", "ny", "k", "m.sign", (F.col("m.kind") == 1).cast("long").alias("value"), F.struct("m.v", "m.kind", "id", "m.sign").alias("at"))
    counted = running(stored(marked, "marks"), "at", ["value"], ["feature"])
    inside = counted.groupBy("feature", "id", "ny", "k").agg(F.sum(F.col("sign") * F.col("before_value")).alias("m"))
    mi = digamma(F.count(F.lit(1)).cast("double")) + F.avg(digamma(F.col("k").cast("double"))) - F.avg(digamma(F.col("ny").cast("double"))) - F.avg(digamma(F.col("m").cast("double")))
    return inside.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))


def risk_band(positive: Column, score: Column) -> Column:
    """Class and score to one of six labels."""
    band = F.when(score >= 0.8, "high").when(score >= 0.6, "moderate").otherwise("low")
    return F.concat(F.when(positive, "positive").otherwise("negative"), F.lit("_"), band)


def first_pattern(c: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    """The name of the first pattern that the text matches, else ``other``."""
    out = F.lit("other")
    for name, p in reversed(patterns):
        out = F.when(c.rlike(p), name).otherwise(out)
    return out


def remap(c: Column, mapping: Mapping) -> Column:
    """Old value -> new value; others NULL."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]
