"""Candidate frames: thinning, signals against the frame before, normalised scores, clip dynamics, fixed grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import columns as C


def thin(frames: DataFrame, step: int) -> DataFrame:
    """Every step-th frame; before any lag, as signals are against the frame sampled before."""
    return frames.where(F.col("frame_index") % step == 0)


def with_lag_signals(frames: DataFrame) -> DataFrame:
    """frame_diff, and hist_diff where the kind changes; 0 for a clip's first frame."""
    by = Window.partitionBy("clip_id").orderBy("frame_index")
    diff = F.coalesce(F.abs(F.col("value") - F.lag("value").over(by)), F.lit(0.0))
    changed = F.when(F.col("kind") != F.lag("kind").over(by), 0.5).otherwise(0.0)
    return frames.withColumns({"frame_diff": diff, "hist_diff": changed})


def with_scores(frames: DataFrame) -> DataFrame:
    """Scores on fixed scales."""
    return frames.withColumns(
        {
            "motion_score": C.clip_scale(F.col("frame_diff"), C.MOTION_CLIP),
            "hist_diff_score": C.clip_scale(F.col("hist_diff"), C.SCENE_CLIP),
            "sharpness_score": C.clip_scale(F.col("sharpness"), C.SHARP_CLIP),
            "brightness_score": C.brightness_score(F.col("brightness")),
        }
    )


def with_min_max_scores(frames: DataFrame) -> DataFrame:
    """Scores between a clip's least and greatest value."""
    by = Window.partitionBy("clip_id")
    scale = lambda c: C.min_max(F.col(c), F.min(c).over(by), F.max(c).over(by))
    return frames.withColumns({"motion_score": scale("frame_diff"), "hist_diff_score": scale("hist_diff"), "sharpness_score": scale("sharpness"), "brightness_score": scale("brightness")})


def clip_dynamics(frames: DataFrame) -> DataFrame:
    """(clip_id, dynamic_score, weight, label): how much a clip moves, and the flow's weight for it."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    agg = frames.groupBy("clip_id").agg(F.percentile("flow_score", 0.75).alias("p75"), F.avg("flow_score").alias("flow"), F.avg("motion_area").alias("area"), F.avg("frame_diff").alias("diff"), F.avg("hist_diff").alias("hist"))
    score = 0.35 * F.col("p75") + 0.25 * F.col("flow") + 0.20 * F.col("area") + 0.10 * clamp(F.col("diff") / 35.0) + 0.10 * clamp(F.col("hist") / 0.5)
    agg = agg.select("clip_id", F.coalesce(clamp(score), F.lit(0.0)).alias("dynamic_score"))
    return agg.withColumn("w", C.adaptive_flow_weight(F.col("dynamic_score"))).select("clip_id", "dynamic_score", "w.weight", "w.label")


def scored(frames: DataFrame, use_optical_flow: bool = True, adaptive: bool = True) -> DataFrame:
    """frames with combined_score. The flow counts only if asked for, by the clip's own weight if adaptive."""
    frames = with_scores(frames)
    if use_optical_flow and adaptive:
        frames = frames.join(clip_dynamics(frames).select("clip_id", "weight"), "clip_id")
    else:
        frames = frames.withColumn("weight", F.lit(C.FLOW_WEIGHT if use_optical_flow else 0.0))
    score = C.combined_score(F.col("hist_diff_score"), F.col("motion_score"), F.col("flow_score"), F.col("weight"), F.col("sharpness_score"), F.col("brightness_score"), F.col("brightness"))
    return frames.withColumn("combined_score", score)


def fixed_frames(frames: DataFrame, n: int = 8) -> DataFrame:
    """The frames at n evenly spaced places of each clip; places may repeat, and a missing frame is left out."""
    sizes = frames.groupBy("clip_id").agg((F.max("frame_index") + 1).alias("n"))
    at = sizes.select("clip_id", F.posexplode(C.evenly_spaced(F.col("n"), n)).alias("position", "frame_index"))
    return at.join(frames, ["clip_id", "frame_index"])


def segments(videos: DataFrame, segment_sec: float = 20.0, most: int | None = None) -> DataFrame:
    """videos(video, duration_sec) -> the grid of segments: (video, segment, start_sec, length_sec, name)."""
    n = F.ceil(F.col("duration_sec") / segment_sec)
    n = F.least(n, F.lit(most)) if most else n
    grid = videos.where(F.col("duration_sec") > 0).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("segment") * segment_sec
    length = F.least(F.lit(segment_sec), F.greatest(F.lit(0.0), F.col("duration_sec") - start))
    return grid.select("video", F.col("segment").cast("int").alias("segment"), start.alias("start_sec"), length.alias("length_sec"), F.format_string("%s_clip_%04d", "video", "segment").alias("name")).where("length_sec > 0")
