"""Resampling of gray pictures: separable kernels of whole-number weights, so that results are exact and the same everywhere.

``area`` weighs input pixels by how much of the output pixel they cover; ``linear`` takes the two nearest on each axis, the
border repeated; ``cubic`` is Catmull-Rom widened to the scale when pictures shrink, each axis rounded by itself.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the cubic kernel are whole numbers of 2**-CUBIC_BITS.
CUBIC_BITS = 22


def catmull_rom(x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (1.5 * x - 2.5) * x * x + 1, np.where(x < 2, ((-0.5 * x + 2.5) * x - 4) * x + 2, 0.0))


@functools.lru_cache(256)
def weights(n: int, to: int, kind: str) -> tuple[np.ndarray, int]:
    """(to x n whole numbers, what each row sums to) that make to values of n."""
    i, j = np.arange(n), np.arange(to)[:, None]
    if kind == "area":
        return np.maximum(0, np.minimum((j + 1) * n, (i + 1) * to) - np.maximum(j * n, i * to)).astype(float), n
    out = np.zeros((to, n))
    if kind == "linear":
        at = (2 * np.arange(to) + 1) * n - to  # in parts of 2 * to
        low, part = at // (2 * to), at % (2 * to)
        np.add.at(out, (np.arange(to), np.clip(low, 0, n - 1)), 2 * to - part)
        np.add.at(out, (np.arange(to), np.clip(low + 1, 0, n - 1)), part)
        return out, 2 * to
    if kind == "cubic":
        scale = n / to
        wide = max(1.0, scale)
        for k in range(to):
            centre = (k + 0.5) * scale
            low, high = max(0, int(centre - 2 * wide + 0.5)), min(n, int(centre + 2 * wide + 0.5))
            w = catmull_rom((np.arange(low, high) - centre + 0.5) / wide)
            out[k, low:high] = np.floor(w / w.sum() * (1 << CUBIC_BITS) + 0.5)
        return out, 1 << CUBIC_BITS
    raise ValueError(f"unknown kind {kind}")


def resample(picture: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    """A picture of 0..255 in another size; halves go to the even number, for cubic up."""
    (wy, ny), (wx, nx) = weights(picture.shape[0], height, kind), weights(picture.shape[1], width, kind)
    p = picture.astype(float)  # sums of products stay far below 2**53, so they are exact
    if kind == "cubic":
        across = np.clip(np.floor(p @ wx.T / nx + 0.5), 0, 255)
        return np.clip(np.floor(wy @ across / ny + 0.5), 0, 255).astype(np.uint8)
    return np.rint(wy @ p @ wx.T / (ny * nx)).astype(np.uint8)


def pixels_of(gray, height: int, width: int) -> np.ndarray:
    """A row's picture, whether its pixels are bytes or numbers."""
    flat = np.frombuffer(gray, np.uint8) if isinstance(gray, (bytes, bytearray, memoryview)) else np.asarray(gray, np.int64)
    return flat.reshape(int(height), int(width))


def resized_pixels(gray: Column | str, height: Column | str, width: Column | str, to_height: Column | int, to_width: Column | int, kind: str = "area") -> Column:
    """The pixels, as bytes, of a picture in another size; null for a missing or empty picture."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)

    @F.pandas_udf("binary")
    def run(g: pd.Series, h: pd.Series, w: pd.Series, th: pd.Series, tw: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or not (a > 0 and b > 0 and c > 0 and d > 0) else resample(pixels_of(x, a, b), int(c), int(d), kind).tobytes() for x, a, b, c, d in zip(g, h, w, th, tw)], dtype=object)

    return run(F.col(gray) if isinstance(gray, str) else gray, F.col(height) if isinstance(height, str) else height, F.col(width) if isinstance(width, str) else width, column(to_height), column(to_width))


def kept_shape(height: int, width: int, to_width: int) -> tuple[int, int]:
    """(height, width) of a picture scaled to a width."""
    return (height, width) if width in (0, to_width) or height == 0 else (max(1, round(height * (to_width / width))), to_width)


def similarity_vector(picture: np.ndarray, size: int = 32) -> np.ndarray:
    """A picture as a vector of length 1 about its mean; zeros for one of a single gray."""
    v = resample(picture, size, size, "cubic").astype(float).ravel()
    v -= v.mean()
    n = math.sqrt(float(v @ v))
    return v / n if n else v


def with_vectors(frames: DataFrame, size: int = 32, together: int = 256) -> DataFrame:
    """frames(gray binary, height, width, ...) with their similarity vectors instead of the pixels, null for a null; so many are held at a time."""
    kept = [f for f in frames.schema if f.name not in ("gray", "height", "width")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, together):
                part = b.slice(i, together)
                there = [g.as_py() for g in part.column("gray")]
                found = [similarity_vector(pixels_of(g, h.as_py(), w.as_py()), size) for g, h, w in zip(there, part.column("height"), part.column("width")) if g is not None]
                lengths = np.array([0 if g is None else size * size for g in there], np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(np.r_[np.int32(0), np.cumsum(lengths, dtype=np.int32)]), pa.array(np.concatenate(found) if found else np.empty(0)), mask=pa.array(lengths == 0))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), vectors], [*(f.name for f in kept), "vector"])

    return frames.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "vector array<double>"]))
