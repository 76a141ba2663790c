"""Signals of frames against the frame sampled before, in one pass over pixels as bytes.

A video is cut into segments of frames, the last frame of each also sent to the next as what comes before; a task holds two
frames at a time, so neither a long video nor a window over pictures is sorted or held as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import signals as G
from frameloom.operators.flow import polynomial_flow
from frameloom.operators.resample import kept_shape, pixels_of, resample

SIGNALS = "brightness double, sharpness double, frame_diff double, hist_diff double, flow_mean double, flow_p90 double, motion_area double"


@dataclass(frozen=True)
class ScanSettings:
    """Of a picture's height the bottom share is ignored but for its brightness. Flow is sought at a width, or in an exact shape
    (height, width), and left out if flow is False; diff_shape is the shape in which differences are taken, that of the frame if None."""

    ignore_bottom: float = 0.0
    flow: bool = True
    flow_width: int = 384
    flow_shape: tuple[int, int] | None = None
    diff_shape: tuple[int, int] | None = None
    levels: int = 3
    rounds: int = 3
    threshold: float = 1.0
    camera: bool = True
    bins: int = 64


def for_flow(picture: np.ndarray, s: ScanSettings) -> np.ndarray:
    if s.flow_shape:
        return resample(picture, *s.flow_shape, "linear")
    shape = kept_shape(*picture.shape, s.flow_width)
    return picture if shape == picture.shape else resample(picture, *shape, "area")


def signals(whole: np.ndarray, before: np.ndarray | None, s: ScanSettings) -> tuple[float, ...]:
    """SIGNALS of a picture; all that compares is 0 without one before."""
    kept = cropped(whole, s.ignore_bottom)
    brightness, sharp = float(whole.mean()), G._laplacian_variance(kept, *kept.shape)
    if before is None:
        return brightness, sharp, 0.0, 0.0, 0.0, 0.0, 0.0
    before = cropped(before, s.ignore_bottom)
    a, b = (resample(x, *s.diff_shape, "linear") if s.diff_shape else x for x in (before, kept))
    counts = [np.bincount(x.ravel().astype(np.int64) * s.bins // 256, minlength=s.bins) for x in (before, kept)]
    flow = G.flow_numbers(*polynomial_flow(for_flow(before, s), for_flow(kept, s), s.levels, rounds=s.rounds), s.threshold, s.camera) if s.flow else (0.0, 0.0, 0.0)
    return brightness, sharp, float(np.abs(a.astype(float) - b).mean()), G._bhattacharyya(*counts), *flow


def cropped(picture: np.ndarray, ignore_bottom: float) -> np.ndarray:
    n = picture.shape[0]
    return picture[: max(1, min(n, round(n * (1 - ignore_bottom))))] if ignore_bottom > 0 else picture


def with_signals(frames: DataFrame, settings: ScanSettings = ScanSettings(), place: Column | None = None, segment: int = 256) -> DataFrame:
    """frames(video, frame_index, gray, height, width, ...) with SIGNALS and flow_score instead of the pixels.

    place numbers a video's sampled frames from 0 without gaps (frame_index where every frame is sampled); with gaps, the first
    frame of a segment may have none before it. Frames that can't be read are left out beforehand. Repeated frames are
    compared with each other.
    """
    place = F.col("frame_index") if place is None else place
    kept = [c for c in frames.columns if c not in ("gray", "height", "width")]
    part = F.floor(place / segment).cast("long")
    dealt = F.when(place % segment == segment - 1, F.array(F.struct(part.alias("part"), F.lit(False).alias("only")), F.struct((part + 1).alias("part"), F.lit(True).alias("only")))).otherwise(F.array(F.struct(part.alias("part"), F.lit(False).alias("only"))))
    rows = frames.where("gray is not null").withColumn("_d", F.explode(dealt)).select(*frames.columns, F.col("_d.part").alias("_part"), F.col("_d.only").alias("_only"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name in kept), SIGNALS])
    names = [x.strip().split(" ")[0] for x in SIGNALS.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, before = None, None
        for b in batches:
            found, shown = [], []
            for i, (video, p, only, gray, h, w) in enumerate(zip(b["video"], b["_part"], b["_only"], b["gray"], b["height"], b["width"])):
                picture = pixels_of(gray, h, w)
                if key != (video, p):
                    key, before = (video, p), None
                if not only:
                    same = before if before is not None and before.shape == picture.shape else None
                    found.append(signals(picture, same, settings))
                    shown.append(i)
                before = picture
            out = b.iloc[shown][kept].reset_index(drop=True)
            yield pd.concat([out, pd.DataFrame(found, columns=names, dtype=float)], axis=1)

    done = rows.repartition("video", "_part").sortWithinPartitions("video", "_part", "frame_index", F.desc("_only")).mapInPandas(run, schema)
    return done.withColumn("flow_score", C.flow_score(F.col("flow_mean"), F.col("flow_p90"), F.col("motion_area")))
