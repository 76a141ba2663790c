"""Pixel kernels on gray frames as arrays of ints: NumPy over Arrow batches, a call a frame and none a pixel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.flow import polynomial_flow

FLOW = "mean double, p90 double, area double"


def _each(kind: str, f: Callable) -> Callable[..., Column]:
    """A column function of f, which gets the values of a row and isn't asked where one of them is null."""

    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or (isinstance(v, float) and v != v) for v in row) else f(*row) for row in zip(*columns)], dtype=object)

    def struct(*columns: pd.Series) -> pd.DataFrame:
        names = [x.strip().split(" ")[0] for x in kind.split(",")]
        rows = [(None,) * len(names) if any(v is None for v in row) else f(*row) for row in zip(*columns)]
        return pd.DataFrame(rows, columns=names)

    return lambda *columns: F.pandas_udf(struct if " " in kind else run, kind)(*columns)


def _mean(px) -> float:
    return float(np.mean(px)) if len(px) else None


def _laplacian_variance(px, height, width) -> float:
    """Population variance of the 3x3 Laplacian; beyond the border the image is mirrored without repeating the border."""
    g = np.asarray(px, float).reshape(int(height), int(width))
    p = np.pad(g, [(min(1, n - 1),) * 2 for n in g.shape], mode="reflect")
    p = np.pad(p, [(int(n == 1),) * 2 for n in g.shape], mode="edge")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def _bhattacharyya(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    size = np.sqrt(a.sum() * b.sum())
    return float(np.sqrt(max(0.0, 1 - np.sqrt(a * b).sum() / size))) if size > 0 else 0.0


def _correlation_distance(a, b) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    x, y = a - a.mean(), b - b.mean()
    size = np.sqrt((x * x).sum() * (y * y).sum())
    return max(0.0, 1 - float((x * y).sum() / size)) if size > 0 else 0.0


mean = _each("double", _mean)
#: Variance of the Laplacian of (pixels, height, width).
sharpness = _each("double", _laplacian_variance)
_absolute_difference = _each("double", lambda a, b: float(np.abs(np.asarray(a, float) - np.asarray(b, float)).mean()))


def histogram(px: Column | str, bins: int, top: int = 256) -> Column:
    """Counts of values 0..top-1 in even bins."""
    return _each("array<double>", lambda v: np.bincount(np.asarray(v, np.int64) * bins // top, minlength=bins).astype(float).tolist())(px)


def bhattacharyya(a: Column | str, b: Column | str) -> Column:
    """Distance of two histograms; 0 for missing ones."""
    return F.coalesce(_each("double", _bhattacharyya)(a, b), F.lit(0.0))


def correlation_distance(a: Column | str, b: Column | str) -> Column:
    """One less the Pearson correlation, at least 0; 0 for missing ones."""
    return F.coalesce(_each("double", _correlation_distance)(a, b), F.lit(0.0))


def absolute_difference(a: Column | str, b: Column | str) -> Column:
    """Mean absolute difference, 0 without a frame before."""
    return F.coalesce(_absolute_difference(a, b), F.lit(0.0))


def gray_pixels(data: Column | str, height: Column | str, width: Column | str, channels: Column | str) -> Column:
    """Gray values of an image's bytes (one channel, or blue, green, red and perhaps alpha), rounded half to even."""

    def gray(px, h, w, n):
        if h <= 0 or w <= 0:
            return None
        v = np.frombuffer(px, np.uint8).reshape(-1, int(n)).astype(float)
        return (v[:, 0] if n == 1 else np.rint(0.114 * v[:, 0] + 0.587 * v[:, 1] + 0.299 * v[:, 2])).astype(int).tolist()

    return _each("array<int>", gray)(data, height, width, channels)


def hue_saturation_histogram(data: Column | str, height: Column | str, width: Column | str, hues: int = 30, saturations: int = 32) -> Column:
    """Counts of (hue, saturation) of an image's blue, green and red bytes, hue in 0..179, scaled to 0..1 by their least and greatest."""

    def counts(px, h, w):
        b, g, r = np.frombuffer(px, np.uint8).reshape(-1, 3).astype(float).T
        top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
        d = np.where(top > low, top - low, 1)
        hue = np.where(top == r, (g - b) / d, np.where(top == g, 2 + (b - r) / d, 4 + (r - g) / d)) * 30 * (top > low)
        hue = np.rint(hue % 180) % 180
        sat = np.rint(np.where(top > 0, 255 * (top - low) / np.where(top > 0, top, 1), 0))
        n = np.bincount((hue * hues // 180 * saturations + sat * saturations // 256).astype(int), minlength=hues * saturations).astype(float)
        return ((n - n.min()) / max(n.max() - n.min(), 1e-12)).tolist()

    return _each("array<double>", counts)(data, height, width)


def flow_numbers(dx: np.ndarray, dy: np.ndarray, threshold: float, camera: bool) -> tuple[float, float, float]:
    """Mean, 90th percentile and share above threshold of a flow's lengths, less the median flow if the camera's motion is to be left out."""
    dx, dy = np.asarray(dx, float).ravel(), np.asarray(dy, float).ravel()
    if not len(dx):
        return 0.0, 0.0, 0.0
    if camera:
        dx, dy = dx - np.median(dx), dy - np.median(dy)
    size = np.sqrt(dx * dx + dy * dy)
    return float(size.mean()), float(np.percentile(size, 90)), float((size > threshold).mean())


def flow_summary(dx: Column | str, dy: Column | str, threshold: float = 1.0, camera: bool = True) -> Column:
    """FLOW of flow vectors that are given."""
    return _each(FLOW, lambda a, b: flow_numbers(a, b, threshold, camera))(dx, dy)


def optical_flow(before: Column | str, gray: Column | str, height: Column | str, width: Column | str, threshold: float = 1.0, camera: bool = True, ignore_bottom: float = 0.0, levels: int = 3) -> Column:
    """FLOW between two frames, zeros without a frame before; the bottom share is ignored if asked for."""

    def flow(a, b, h, w):
        keep = max(1, min(int(h), round(int(h) * (1 - ignore_bottom))))
        shape = lambda v: np.asarray(v, float).reshape(int(h), int(w))[:keep]
        return flow_numbers(*polynomial_flow(shape(a), shape(b), levels), threshold, camera)

    found = _each(FLOW, flow)(before, gray, height, width)
    return F.struct(*[F.coalesce(found[c], F.lit(0.0)).alias(c) for c in ("mean", "p90", "area")])


def with_frame_signals(frames: DataFrame) -> DataFrame:
    """frames(clip_id, frame_index, gray, height, width) with brightness, sharpness, frame_diff and hist_diff against the frame sampled before."""
    by = Window.partitionBy("clip_id").orderBy("frame_index")
    f = frames.withColumn("_h", histogram("gray", 64)).withColumns({"_g0": F.lag("gray").over(by), "_h0": F.lag("_h").over(by)})
    return f.withColumns(
        {"brightness": mean("gray"), "sharpness": sharpness("gray", "height", "width"), "frame_diff": absolute_difference("gray", "_g0"), "hist_diff": bhattacharyya("_h", "_h0")}
    ).drop("_h", "_g0", "_h0")


def with_flow(frames: DataFrame, **how) -> DataFrame:
    """frames(clip_id, frame_index, gray, height, width) with flow (FLOW) against the frame sampled before."""
    before = F.lag("gray").over(Window.partitionBy("clip_id").orderBy("frame_index"))
    return frames.withColumn("_g0", before).withColumn("flow", optical_flow("_g0", "gray", "height", "width", **how)).drop("_g0")


def motion_scores(frames: DataFrame) -> DataFrame:
    """frames(clip_id, timestamp, frame_index, gray, height, width) -> (clip_id, timestamp, score): the mean length of the flow."""
    return with_flow(frames, camera=False, levels=2).select("clip_id", "timestamp", F.col("flow.mean").alias("score"))
