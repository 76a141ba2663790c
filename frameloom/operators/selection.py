"""Keyframes of a clip: anchors, then greedy by score with a least gap in time, then without it.

The greedy passes depend on what was taken before, so a clip's candidates (some hundreds at most, a clip being
some seconds) are one array, folded by higher-order functions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TAKEN = "array<struct<pos:int,t:double,reason:string>>"


def _used(taken: Column, c: Column) -> Column:
    return F.exists(taken, lambda s: s["pos"] == c["pos"])


def _anchor(taken: Column, cands: Column, target: Column, reason: str, n: int) -> Column:
    """taken with the nearest unused candidate, the earlier one of two; as it is where n are taken."""
    free = F.filter(cands, lambda c: ~_used(taken, c))
    best = F.array_min(F.transform(free, lambda c: F.struct(F.abs(c["t"] - target).alias("d"), c["pos"].alias("pos"), c["t"].alias("t"))))
    more = F.array_append(taken, F.struct(best["pos"].alias("pos"), best["t"].alias("t"), F.lit(reason).alias("reason")))
    return F.when((F.size(taken) < n) & (F.size(free) > 0), more).otherwise(taken)


def _greedy(taken: Column, ranked: Column, reason: str, n: int, gap: float | None) -> Column:
    def step(acc, c):
        ok = (F.size(acc) < n) & ~_used(acc, c)
        if gap is not None:
            ok &= ~F.exists(acc, lambda s: F.abs(s["t"] - c["t"]) < gap)
        return F.when(ok, F.array_append(acc, F.struct(c["pos"].alias("pos"), c["t"].alias("t"), F.lit(reason).alias("reason")))).otherwise(acc)

    return F.aggregate(ranked, taken, step)


def select_keyframes(frames: DataFrame, durations: DataFrame | None = None, num_frames: int = 8, min_gap_sec: float = 1.0, anchor_start: bool = True, anchor_middle: bool = True, anchor_end: bool = True) -> DataFrame:
    """frames(clip_id, frame_index, timestamp_sec, combined_score) -> (clip_id, frame_order, frame_index, timestamp_sec, selected_reason, combined_score).

    durations(clip_id, duration_sec); a clip's last timestamp stands in for a missing one.
    """
    one = F.struct(F.col("timestamp_sec").alias("t"), F.col("frame_index").cast("int").alias("pos"), F.col("combined_score").alias("score"))
    clips = frames.groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("cands"), F.max("timestamp_sec").alias("last"))
    if durations is not None:
        clips = clips.join(durations.select("clip_id", "duration_sec"), "clip_id", "left").withColumn("last", F.coalesce("duration_sec", "last"))
    clips = clips.withColumn("ranked", F.array_sort(F.transform("cands", lambda c: F.struct((-c["score"]).alias("s"), c["t"].alias("t"), c["pos"].alias("pos")))))
    clips = clips.withColumn("taken", F.array().cast(TAKEN))
    for on, target, reason in ((anchor_start, F.lit(0.0), "temporal_anchor_start"), (anchor_middle, F.col("last") / 2, "temporal_anchor_middle"), (anchor_end, F.greatest(F.lit(0.0), F.col("last") - 0.2), "temporal_anchor_end")):
        if on:
            clips = clips.withColumn("taken", _anchor(F.col("taken"), F.col("cands"), target, reason, num_frames))
    clips = clips.withColumn("taken", _greedy(F.col("taken"), F.col("ranked"), "high_content_score", num_frames, min_gap_sec))
    clips = clips.withColumn("taken", _greedy(F.col("taken"), F.col("ranked"), "high_content_score_gap_relaxed", num_frames, None))
    every = F.transform("cands", lambda c: F.struct(c["pos"].alias("pos"), c["t"].alias("t"), F.lit("all_candidates_used").alias("reason")))
    clips = clips.withColumn("taken", F.when(F.size("cands") <= num_frames, every).otherwise(F.col("taken")))
    return _rows(clips)


def _rows(clips: DataFrame) -> DataFrame:
    by_time = F.array_sort(F.transform("taken", lambda s: F.struct(s["t"].alias("t"), s["pos"].alias("pos"), s["reason"].alias("reason"))))
    out = clips.select("clip_id", "cands", F.posexplode(by_time).alias("frame_order", "s"))
    score = F.element_at(F.filter("cands", lambda c: c["pos"] == F.col("s.pos")), 1)["score"]
    return out.select("clip_id", "frame_order", F.col("s.pos").alias("frame_index"), F.col("s.t").alias("timestamp_sec"), F.col("s.reason").alias("selected_reason"), score.alias("combined_score"))


def _nearest_lit(target: Column) -> Column:
    """The candidate nearest to target that isn't near-black, or the nearest of all."""
    return F.array_min(F.transform("cands", lambda c: F.struct(c["black"].alias("b"), F.abs(c["t"] - target).alias("d"), c["pos"].alias("pos"), c["t"].alias("t"))))


def select_keyframes_v1(frames: DataFrame, num_frames: int = 12, min_gap_sec: float = 1.0, black_threshold: float = 18.0) -> DataFrame:
    """The first sampler's choice: anchors are the nearest frames that aren't near-black (if any), repeated ones are left out, and they aren't held to num_frames.

    frames(clip_id, frame_index, timestamp_sec, combined_score, brightness); the last timestamp is the duration.
    """
    one = F.struct(F.col("timestamp_sec").alias("t"), F.col("frame_index").cast("int").alias("pos"), F.col("combined_score").alias("score"), (F.col("brightness") < black_threshold).alias("black"))
    clips = frames.groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("cands"), F.max("timestamp_sec").alias("last"))
    clips = clips.withColumn("ranked", F.array_sort(F.transform("cands", lambda c: F.struct((-c["score"]).alias("s"), c["t"].alias("t"), c["pos"].alias("pos")))))
    clips = clips.withColumn("taken", F.array().cast(TAKEN))
    for target, reason in ((F.lit(0.0), "temporal_anchor_start"), (F.col("last") * 0.5, "temporal_anchor_middle"), (F.greatest(F.lit(0.0), F.col("last") - 0.05), "temporal_anchor_end")):
        best = _nearest_lit(target)
        more = F.array_append("taken", F.struct(best["pos"].alias("pos"), best["t"].alias("t"), F.lit(reason).alias("reason")))
        clips = clips.withColumn("taken", F.when(_used(F.col("taken"), best), F.col("taken")).otherwise(more))
    clips = clips.withColumn("taken", _greedy(F.col("taken"), F.col("ranked"), "high_content_score", num_frames, min_gap_sec))
    clips = clips.withColumn("taken", _greedy(F.col("taken"), F.col("ranked"), "fill_remaining_best_score", num_frames, None))
    every = F.transform("cands", lambda c: F.struct(c["pos"].alias("pos"), c["t"].alias("t"), F.lit("all_candidates_kept").alias("reason")))
    return _rows(clips.withColumn("taken", F.when(F.size("cands") <= num_frames, every).otherwise(F.col("taken"))))


def nearest_frame(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """(clip_id, target_sec, frame_index) of the frame nearest to each target, the earlier one of two."""
    near = F.struct(F.abs(F.col("timestamp_sec") - F.col("target_sec")), F.col("timestamp_sec"), F.col("frame_index").alias("i"))
    return frames.join(targets, "clip_id").groupBy("clip_id", "target_sec").agg(F.min(near).alias("m")).select("clip_id", "target_sec", F.col("m.i").alias("frame_index"))


def choose_keyframes(frames: DataFrame, most: int = 8, by_score: bool = True) -> DataFrame:
    """Where a clip has over most frames with an image, its best (or first) most by score; missing scores count 0. Then in the order of time."""
    first = [F.desc(F.coalesce("combined_score", F.lit(0.0))), "frame_order"] if by_score else ["frame_order"]
    top = frames.withColumn("r", F.row_number().over(Window.partitionBy("clip_id").orderBy(*first))).where(F.col("r") <= most).drop("r")
    by_time = Window.partitionBy("clip_id").orderBy(F.coalesce("timestamp_sec", F.lit(0.0)), "frame_order")
    return top.withColumn("position", F.row_number().over(by_time) - 1)


def limit_frames(frames: DataFrame, most: int | None) -> DataFrame:
    """The first most frames of each clip by (timestamp, frame_id), missing times last; all for None or less than 1."""
    if not most or most <= 0:
        return frames
    by = Window.partitionBy("clip_id").orderBy(F.asc_nulls_last("timestamp"), "frame_id")
    return frames.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).drop("r")
