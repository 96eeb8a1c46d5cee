"""Image tables: pixels are binary columns, per-image work is a vectorised task over Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

PIXELS = "id string, height int, width int, data binary"
#: Images that a task has as Python objects at once.
PIECE = 256


def by_pieces(images: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInPandas`` with frames of ``PIECE`` rows: of a batch of Arrow only a piece becomes Python objects, before and after ``run``."""
    size, out = PIECE, to_arrow_schema(T._parse_datatype_string(schema))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            frames = (b.slice(i, size).to_pandas() for i in range(0, b.num_rows, size))
            for f in run(frames):
                yield pa.RecordBatch.from_pandas(f, out, preserve_index=False)

    return images.mapInArrow(pieces, schema)


def grey(data: bytes, height: int, width: int, channels: int = 1) -> np.ndarray:
    """An image as (height, width) bytes; blue, green and red are weighed as usual."""
    a = np.frombuffer(data, np.uint8)[: height * width * channels].reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0]
    return np.clip(a[:, :, :3].astype(np.float64) @ [0.114, 0.587, 0.299] + 0.5, 0, 255).astype(np.uint8)


def grey_table(images: DataFrame) -> DataFrame:
    """Spark's decoded images -> id, height, width, data (grey)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            data = [grey(d, h, w, c).tobytes() for d, h, w, c in zip(f["data"], f["height"], f["width"], f["nChannels"], strict=True)]
            yield pd.DataFrame({"id": f["origin"], "height": f["height"], "width": f["width"], "data": data})

    return by_pieces(images.select("origin", "height", "width", "nChannels", "data"), run, PIXELS)


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area means: each target pixel is the mean of what it covers, parts of pixels counted in part."""

    def weights(n: int, m: int) -> np.ndarray:
        edge = np.linspace(0, n, m + 1)
        lo, hi, k = edge[:-1, None], edge[1:, None], np.arange(n)[None, :]
        w = np.clip(np.minimum(hi, k + 1) - np.maximum(lo, k), 0, None)
        return w / w.sum(1, keepdims=True)

    return weights(a.shape[0], height) @ a.astype(np.float64) @ weights(a.shape[1], width).T


def hex_bits(bits: np.ndarray) -> str:
    return f"{int(''.join('1' if b else '0' for b in bits.ravel()), 2):016x}"


def gradient_hash(a: np.ndarray) -> str:
    """K2: 64 signs of horizontal differences of a 9 by 8 image."""
    s = resized(a, 8, 9)
    return hex_bits(s[:, 1:] > s[:, :-1])


def cosine_hash(a: np.ndarray) -> str:
    """K2: 64 lowest cosine coefficients of a 32 by 32 image against their median (the first left out of it)."""
    n = np.arange(32)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * np.arange(8)[:, None] / 64)
    c = basis @ resized(a, 32, 32) @ basis.T
    return hex_bits(c > np.median(c.ravel()[1:]))


def describe(pixels: DataFrame) -> DataFrame:
    """K1, K2, K7: size, md5 of the pixels, mean and deviation, shares of dark pixels, perceptual hashes (mirrored too)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, h, w, d in f.itertuples(index=False):
                a = grey(d, h, w)
                inside = a[a > 10]
                out.append((i, h, w, hashlib.md5(d).hexdigest(), a.mean(), (a < 10).mean(), inside.mean() if len(inside) else 0.0, inside.std() if len(inside) else 0.0, len(inside) / a.size, gradient_hash(a), cosine_hash(a), cosine_hash(a[:, ::-1])))
            yield pd.DataFrame(out, columns=["id", "height", "width", "pixel_md5", "mean_intensity", "frac_black", "mask_mean", "mask_std", "mask_share", "dhash", "phash", "phash_flip"])

    return by_pieces(pixels, run, "id string, height int, width int, pixel_md5 string, mean_intensity double, frac_black double, mask_mean double, mask_std double, mask_share double, dhash string, phash string, phash_flip string")


def standardise(a: np.ndarray, side: int, least: int = 50, margin: int = 4) -> np.ndarray | None:
    """K3: background (median of the border) removed, cut to what is left, letterboxed and resized; None if too little is left."""
    border = np.concatenate([a[0], a[-1], a[:, 0], a[:, -1]])
    b = np.clip(a.astype(np.int16) - int(np.median(border)), 0, 255).astype(np.uint8)
    y, x = np.nonzero(b > 10)
    if len(y) < least:
        return None
    b = b[max(0, y.min() - margin) : y.max() + margin + 1, max(0, x.min() - margin) : x.max() + margin + 1]
    n = max(b.shape)
    box = np.zeros((n, n), np.uint8)
    top, left = (n - b.shape[0]) // 2, (n - b.shape[1]) // 2
    box[top : top + b.shape[0], left : left + b.shape[1]] = b
    return np.clip(resized(box, side, side) + 0.5, 0, 255).astype(np.uint8)


def standardised(pixels: DataFrame, side: int = 64) -> DataFrame:
    """K3 for a table: images with too little left are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [(i, side, side, s.tobytes()) for i, h, w, d in f.itertuples(index=False) if (s := standardise(grey(d, h, w), side)) is not None]
            yield pd.DataFrame(out, columns=["id", "height", "width", "data"])

    return by_pieces(pixels, run, PIXELS)


def normalised(values):
    """K4: an array column of doubles to 0..1 by its range; a constant image becomes zeros.

    A z-score before it changes nothing: it is a linear map, and the range takes linear maps out again.
    """
    lo, hi = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(0.0))


def discretised(values, bins: int):
    """K5: floor(x * bins), at most bins - 1, over bins - 1."""
    return F.transform(values, lambda x: F.least(F.greatest(F.floor(x * bins), F.lit(0)), F.lit(bins - 1)) / (bins - 1))


def feature_vectors(pixels: DataFrame, side: int = 64) -> DataFrame:
    """K6: id and the area means of a side by side image over 255."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "vec": [(resized(grey(d, h, w), side, side) / 255).ravel().astype(np.float32).tolist() for _, h, w, d in f.itertuples(index=False)]})

    return by_pieces(pixels, run, "id string, vec array<float>")


def handcrafted(pixels: DataFrame) -> DataFrame:
    """K8: eight features inside the mask of pixels over 10."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, h, w, d in f.itertuples(index=False):
                a = grey(d, h, w).astype(np.float64)
                m = a[a > 10]
                mid = a[h // 3 : 2 * h // 3, w // 3 : 2 * w // 3]
                q = np.percentile(m, [10, 50, 90]) if len(m) else np.zeros(3)
                out.append((i, len(m) / a.size, m.mean() if len(m) else 0.0, m.std() if len(m) else 0.0, *q, (m < 60).mean() if len(m) else 0.0, (mid < 60).mean() if mid.size else 0.0))
            yield pd.DataFrame(out, columns=["id", "brain_area", "int_mean", "int_std", "int_p10", "int_p50", "int_p90", "dark_share", "central_dark_share"])

    return by_pieces(pixels, run, "id string, brain_area double, int_mean double, int_std double, int_p10 double, int_p50 double, int_p90 double, dark_share double, central_dark_share double")


def augmented(pixels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """K9: n seeded variants of each image (mirror, brightness, contrast, noise), named ``<id>__aug_01`` and so on."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, h, w, d, k in f.itertuples(index=False):
                r = np.random.default_rng(int(hashlib.md5(f"{seed}|{i}|{k}".encode()).hexdigest()[:8], 16))
                a = grey(d, h, w).astype(np.float64)
                a = a[:, ::-1] if r.random() < 0.5 else a
                a = (a - a.mean()) * r.uniform(0.9, 1.1) + a.mean() + r.uniform(-12, 12) + r.normal(0, 2, a.shape)
                out.append((f"{i}__aug_{k:02d}", h, w, np.clip(a + 0.5, 0, 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["id", "height", "width", "data"])

    return by_pieces(pixels.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))), run, PIXELS)
