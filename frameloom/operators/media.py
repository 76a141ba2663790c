"""Videos as rows: what a probe says of each, and the grid of frames that are looked at. Decoding is a callable that is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import columns as C

METADATA = "path string, fps double, frame_count long, width int, height int, error string"


class UnreadableVideo(ValueError):
    """A video's metadata make no sense."""


def probed(files: DataFrame, loader: Callable[[], Callable]) -> DataFrame:
    """files(path) -> METADATA and duration_sec, a row a video; loader is called once a task, its probe gives (fps, frames, width, height)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probe = None
        for b in batches:
            rows = []
            for path in b.path:
                try:
                    probe = probe or loader()
                    rows.append((path, *probe(path), None))
                except Exception as e:  # noqa: BLE001  kept as the video's outcome
                    rows.append((path, 0.0, 0, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "fps", "frame_count", "width", "height", "error"])

    return with_duration(files.select("path").mapInPandas(run, METADATA))


def with_duration(metadata: DataFrame) -> DataFrame:
    """metadata(fps, frame_count) with duration_sec, 0 where there is no frame rate."""
    return metadata.withColumn("duration_sec", F.when(F.col("fps") > 0, F.col("frame_count") / F.col("fps")).otherwise(0.0))


def checked_metadata(metadata: DataFrame) -> DataFrame:
    """metadata, or an error that names some videos without frame rate or frames."""
    bad = [r[0] for r in metadata.where(~(F.col("fps") > 0) | ~(F.col("frame_count") > 0)).select("path").orderBy("path").limit(5).collect()]
    if bad:
        raise UnreadableVideo(f"no frames in {bad}")
    return metadata


def candidate_grid(metadata: DataFrame, candidate_fps: float, missing_fps: float | None = None) -> DataFrame:
    """metadata(path, fps, frame_count, ...) -> (path, frame_index, timestamp_sec), every step-th frame; missing_fps stands in for a rate that isn't positive."""
    fps = F.col("fps") if missing_fps is None else F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(missing_fps))
    m = metadata.where(F.col("frame_count") > 0).withColumn("rate", fps)
    step = F.greatest(F.lit(1), C.half_even(F.col("rate") / candidate_fps).cast("int"))
    grid = m.select("path", "rate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - 1, step.cast("long"))).alias("frame_index"))
    return grid.select("path", "frame_index", (F.col("frame_index") / F.col("rate")).alias("timestamp_sec"))


def resized(height, width, to_width: int):
    """(height, width) of a frame scaled to to_width with its shape kept; empty frames stay."""
    new = F.greatest(F.lit(1), C.half_even(height * (to_width / width.cast("double"))).cast("int"))
    empty = (height <= 0) | (width <= 0)
    return F.struct(F.when(empty, height).otherwise(new).cast("int").alias("height"), F.when(empty, width).otherwise(F.lit(to_width)).cast("int").alias("width"))
