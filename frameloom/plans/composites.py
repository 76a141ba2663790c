"""Pipelines made of operators: manifests, keyframe and coverage evaluation, cloud runs, remaining work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import evaluation as E
from frameloom.operators import merge as M
from frameloom.operators import sampling as S
from frameloom.operators import selection as K
from frameloom.operators import shards as R
from frameloom.operators import signals as G
from frameloom.operators import timeline as T
from frameloom.operators.images import encoded, keyframe_files
from frameloom.operators.media import checked_metadata
from frameloom.operators.scan import ScanSettings, with_signals
from frameloom.sources.folders import scratch
from frameloom.sources.staged import write_files
from frameloom.sources.video import read_frames, read_metadata


def build_manifest(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """Sampling records(clip_file, line, duration_sec, error, selected_frames) -> manifest rows on the global timeline.

    Clip ids are those in file names, else the record's place; failed clips keep a row and a span of no length.
    """
    clips = records.withColumn("clip_id", C.clip_number(F.col("clip_file"), F.col("line")))
    clips = T.running_starts(clips, ranges)

    def timed(f, i):
        start = F.col("start_sec") + F.coalesce(f["timestamp_sec"], F.lit(0.0))
        return f.withField("frame_order", i).withField("local_timestamp", C.let(C.millis(F.coalesce(f["timestamp_sec"], F.lit(0.0))), C.format_millis)).withField("global_timestamp_sec", start).withField("global_timestamp", C.let(C.millis(start), C.format_millis))

    # frames are counted before they are timed, so that who only counts them doesn't time them
    out = clips.withColumns({"actual_start_time": C.format_time(F.col("start_sec")), "actual_end_time": C.format_time(F.col("end_sec")), "selected_frame_count": F.coalesce(F.array_size("selected_frames"), F.lit(0))})
    return out.withColumn("selected_frames", F.transform("selected_frames", timed))


def evaluate_keyframes(keyframes: DataFrame, images: DataFrame, version: str) -> DataFrame:
    """keyframes(clip_id, frame_id, timestamp, frame_path) with images(frame_path, gray, height, width): quality flags of each frame."""
    f = keyframes.where("clip_id is not null").join(images, "frame_path", "left").withColumn("_h", G.histogram("gray", 256))
    there = F.col("gray").isNotNull()
    f = f.withColumns(
        {
            "brightness": F.when(there, G.mean("gray")),
            "sharpness": F.when(there, G.sharpness("gray", "height", "width")),
            "entropy": F.when(there, E.entropy(F.col("_h"))),
            "vector": F.when(there, C.centred(F.col("gray"))),
        }
    )
    return E.with_flags(E.with_similarity(f)).withColumn("version", F.lit(version)).drop("gray", "vector", "_h")


def evaluate_motion_coverage(keyframes: DataFrame, motion: DataFrame, paths: DataFrame, version: str, tolerance: float = E.TOLERANCE) -> DataFrame:
    """Coverage of each clip of keyframes, with a note where there is no video (nulls) or no motion (zeros)."""
    cover = E.motion_coverage(E.motion_events(motion), keyframes.select("clip_id", "timestamp"), tolerance)
    known = paths.select("clip_id").distinct().withColumn("_path", F.lit(True))
    moved = motion.select("clip_id").distinct().withColumn("_moved", F.lit(True))
    out = cover.join(known, "clip_id", "left").join(moved, "clip_id", "left")
    lost = F.col("_path").isNull()
    note = F.when(lost, "clip video not found").when(F.col("_moved").isNull(), "no motion data").otherwise("")
    return out.select("clip_id", *[F.when(~lost, F.col(c)).alias(c) for c in ("n_events", "n_covered", "coverage")], note.alias("note"), F.lit(version).alias("version"))


def prepare_cloud_run(manifest: DataFrame, prefix: str, present: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest with store paths, uploads(source, target) that aren't in present(target), one row of counts)."""
    moved = T.with_cloud_paths(manifest, prefix)
    paths = manifest.select("clip_id", F.posexplode("selected_frames.image_path").alias("i", "source"))  # of the frames only these are read
    pairs = paths.select("source", T.cloud_path(F.col("source"), F.col("i"), prefix).alias("target"))
    uploads = pairs.where("source <> target").distinct().join(present, "target", "left_anti").select("source", "target")
    counts = pairs.agg(F.count("*").alias("n_references"), F.count_distinct("target").alias("n_targets"))
    return moved, uploads, counts


def remaining_manifest(manifest: DataFrame, attempts: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The clips still to do, of those asked for, in the order of id."""
    asked = manifest if only is None else R.requested(manifest, only)
    return R.remaining(asked, attempts).orderBy("clip_id")


def bundle_plan(planned: DataFrame, local: DataFrame, needed: str = "config.json") -> DataFrame:
    """Which bundle files can be reused; an empty bundle or one without the needed file is an error."""
    if not planned.where(F.element_at(F.split("path", "/"), -1) == needed).limit(1).count():
        raise ValueError(f"the bundle has no {needed}")
    return M.reusable(planned, local)


def local_frames(manifest: DataFrame, cache: str) -> DataFrame:
    """A manifest whose frames in an object store are named by their place in the cache, the store's path kept as source_image_path."""

    def held(f, i):
        name = F.element_at(F.split(f["image_path"], "/"), -1)
        there = F.concat(F.lit(f"{cache.rstrip('/')}/frames/"), F.format_string("clip_%04d/%02d_", F.col("clip_id"), i), name)
        return f.withField("source_image_path", f["image_path"]).withField("image_path", F.when(f["image_path"].rlike("(?i)^s3://"), there).otherwise(f["image_path"]))

    return manifest.withColumn("selected_frames", F.transform("selected_frames", held))


def contact_grid(frames: DataFrame, width: int = 320, height: int = 180, most_columns: int = 4) -> DataFrame:
    """frames(clip_id, frame_order) with where each lies on its clip's sheet: (row, column, left, top, columns, rows)."""
    n = frames.groupBy("clip_id").agg(F.count("*").alias("n"))
    out = frames.join(n, "clip_id").withColumn("columns", F.least(F.lit(most_columns), F.col("n")).cast("int"))
    out = out.withColumns({"rows": F.ceil(F.col("n") / F.col("columns")).cast("int"), "row": F.floor(F.col("frame_order") / F.col("columns")).cast("int"), "column": (F.col("frame_order") % F.col("columns")).cast("int")})
    return out.withColumns({"left": F.col("column") * width, "top": F.col("row") * height}).drop("n")


def manifest_complete(expected: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row (complete, reason, n, missing): every clip_file of expected has a manifest row with frames."""
    done = manifest.where(F.coalesce("selected_frame_count", F.lit(0)) > 0).select("clip_file").distinct()
    both = expected.select("clip_file").distinct().join(done.withColumn("_there", F.lit(True)), "clip_file", "left")
    counts = both.agg(F.count("*").alias("n"), F.count_if(F.col("_there").isNull()).alias("missing"))
    reason = F.when(F.col("n") == 0, "no clips").when(F.col("missing") > 0, F.format_string("%d missing", "missing")).otherwise("complete")
    return counts.select((reason == "complete").alias("complete"), reason.alias("reason"), "n", "missing")


def sample_clips(frames: DataFrame, durations: DataFrame | None = None, num_frames: int = 8, min_gap_sec: float = 1.0, use_optical_flow: bool = True, adaptive: bool = True, version: str = "1", suffix: str = ".jpg") -> DataFrame:
    """The sampler: raw frames -> a row a clip with its chosen frames, their file names, and how the flow was weighed.

    frames(clip_id, frame_index, timestamp_sec, value, kind, brightness, sharpness, flow_score, motion_area), or with
    frame_diff and hist_diff in place of value and kind.
    """
    signals = frames if "frame_diff" in frames.columns else S.with_lag_signals(frames)
    scored = S.scored(signals, use_optical_flow, adaptive)
    chosen = K.select_keyframes(scored, durations, num_frames, min_gap_sec)
    one = F.struct("frame_order", "frame_index", "timestamp_sec", "selected_reason", "combined_score", C.frame_file_name(F.col("frame_order"), F.col("timestamp_sec"), F.col("frame_index"), suffix).alias("image_file"))
    nested = chosen.groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("selected_frames"), F.count("*").cast("int").alias("selected_count"))
    counts = scored.groupBy("clip_id").agg(F.count("*").alias("num_candidates"), F.first("weight").alias("flow_weight"))
    category: Column = F.lit("fixed_flow_weight" if use_optical_flow else "no_optical_flow")
    out = counts.join(nested, "clip_id")
    if use_optical_flow and adaptive:
        out = out.join(S.clip_dynamics(signals).select("clip_id", "dynamic_score", F.col("label").alias("dynamic_category")), "clip_id")
    else:
        out = out.withColumns({"dynamic_score": F.lit(0.0), "dynamic_category": category})
    return out.withColumn("sampler_version", F.lit(version))


def sample_videos(spark: SparkSession, path: str, out: str, candidate_fps: float = 2.0, missing_fps: float | None = None, scan: ScanSettings = ScanSettings(), num_frames: int = 8, min_gap_sec: float = 1.0, adaptive: bool = True, sheet_width: int = 320, segment: int = 256) -> DataFrame:
    """The sampler on video files: candidates are read and scanned, the chosen frames read again and written to out.

    A row a clip as sample_clips gives it. In out each clip has its frames, its contact sheet and selected_frames.json; all
    files are there at the end, or none. Videos without frames or frame rate are an error, but for missing_fps.
    """
    metadata = checked_metadata(read_metadata(spark, path).withColumn("path", F.col("video")).withColumn("fps", F.when(F.col("fps") > 0, F.col("fps")).otherwise(F.lit(float(missing_fps or 0)))))
    frames = read_frames(spark, path, ("video", "frame_index", "timestamp_sec", "fps", "gray", "height", "width"), candidate_fps, missing_fps)
    place = F.floor(F.col("frame_index") / C.thinning_step(F.col("fps"), candidate_fps))
    held = scratch(spark, "signals")
    with_signals(frames, scan, place, segment).write.parquet(f"{held}/signals")
    found = spark.read.parquet(f"{held}/signals").withColumnRenamed("video", "clip_id")
    durations = metadata.select(F.col("video").alias("clip_id"), (F.col("frame_count") / F.col("fps")).alias("duration_sec"))
    sample_clips(found, durations, num_frames, min_gap_sec, scan.flow, adaptive, suffix=".png").write.parquet(f"{held}/clips")
    clips = spark.read.parquet(f"{held}/clips")
    chosen = clips.select("clip_id", F.explode("selected_frames").alias("f")).select("clip_id", "f.*").drop("image_file")
    pixels = frames.select(F.col("video").alias("clip_id"), F.col("frame_index").cast("int").alias("frame_index"), "gray", "height", "width")
    chosen.join(pixels, ["clip_id", "frame_index"]).write.parquet(f"{held}/chosen")  # pictures, sheets and records are made of it
    write_files(keyframe_files(spark.read.parquet(f"{held}/chosen"), sheet_width), out, overwrite=True)
    return clips


def write_fixed_keyframes(spark: SparkSession, path: str, out: str, n: int = 8, missing_fps: float = 24.0) -> DataFrame:
    """Evenly spaced frames of each video, written to out; (clip_id, frames written). Places that have no frame are left out."""
    frames = read_frames(spark, path, ("video", "frame_index", "timestamp_sec", "gray", "height", "width"), missing_fps=missing_fps)
    counts = read_metadata(spark, path).where("frame_count > 0").select("video", F.posexplode(C.evenly_spaced(F.col("frame_count"), n)).alias("frame_order", "frame_index"))
    chosen = counts.join(frames, ["video", "frame_index"]).withColumn("clip_id", F.col("video"))
    named = chosen.select(F.concat_ws("/", "clip_id", C.frame_file_name(F.col("frame_order"), F.col("timestamp_sec"), F.col("frame_index"), suffix=".png")).alias("path"), encoded("gray", "height", "width").alias("content"))
    write_files(named, out, overwrite=True)
    return chosen.groupBy("clip_id").agg(F.count("*").cast("int").alias("n_frames"))
