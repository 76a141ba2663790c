"""Clips on a global timeline, manifests with nested frames, and what is printed about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.sources.folders import scratch, shared_dir

#: Rows that a task sorts, and the fewest and most ranges that are dealt out where their number isn't given.
RANGE_ROWS, FEWEST_RANGES, MOST_RANGES = 1 << 20, 8, 4096


def range_edges(df: DataFrame, ranges: int | None = None, key: str = "clip_id") -> list[float]:
    """What parts the ranges of key, from one look at df; as many ranges as its rows need if their number isn't given."""
    parts = ranges or MOST_RANGES
    if parts == 1:
        return []
    n, found = df.agg(F.count("*"), F.percentile_approx(F.col(key).cast("double"), [i / parts for i in range(1, parts)], 10_000)).first()
    ranges = ranges or min(parts, max(FEWEST_RANGES, -(-n // RANGE_ROWS)))
    return [found[i * parts // ranges - 1] for i in range(1, ranges)] if found else []


def range_of(edges: list[float], key: str = "clip_id") -> Column:
    """The place of the range of key."""
    return F.size(F.filter(F.lit(edges), lambda x: x < F.col(key))) if edges else F.lit(0)


def in_ranges(df: DataFrame, ranges: int | None = None, key: str = "clip_id") -> DataFrame:
    """df with range, the place of its range of key."""
    return df.withColumn("range", range_of(range_edges(df, ranges, key), key))


def running_starts(clips: DataFrame, ranges: int | None = None) -> DataFrame:
    """clips(clip_id, line, duration_sec) with start_sec and end_sec, in the order of (clip_id, line).

    The clips are dealt into ranges of clip_id (one sort of all if ranges is 1): each range is summed, the sums of ranges (few
    rows) are run through, and only ranges are sorted, so no task sees all clips. Sums then add up in another order, so
    starts may differ in the last bits. Ranges are found and summed from ids and durations alone, kept in the shared folder,
    so that the clips themselves, whatever they are made of, are made once.
    """
    clips = clips.withColumn("duration_sec", F.coalesce(F.col("duration_sec"), F.lit(0.0)))
    order = [F.col("clip_id"), F.col("line")]
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    if ranges == 1:
        start = F.coalesce(F.sum("duration_sec").over(before(Window.orderBy(*order))), F.lit(0.0))
        return clips.withColumn("start_sec", start).withColumn("end_sec", F.col("start_sec") + F.col("duration_sec"))
    shared_dir(clips.sparkSession)
    slim = clips.select("clip_id", "duration_sec").checkpoint(eager=True)
    place = range_of(range_edges(slim, ranges))
    clips = clips.withColumn("range", place)
    sums = slim.withColumn("range", place).groupBy("range").agg(F.sum("duration_sec").alias("t")).withColumn("offset", F.coalesce(F.sum("t").over(before(Window.orderBy("range"))), F.lit(0.0)))
    inside = F.coalesce(F.sum("duration_sec").over(before(Window.partitionBy("range").orderBy(*order))), F.lit(0.0))
    out = clips.withColumn("inside", inside).join(F.broadcast(sums.select("range", "offset")), "range")
    out = out.withColumn("start_sec", F.col("offset") + F.col("inside")).withColumn("end_sec", F.col("start_sec") + F.col("duration_sec"))
    return out.drop("range", "offset", "inside")


def with_global_times(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """frames with their clip's start added to the local time; frame_order is the place in the clip."""
    out = frames.join(clips.select("clip_id", "start_sec"), "clip_id")
    return out.withColumn("global_timestamp_sec", F.col("start_sec") + F.coalesce("timestamp_sec", F.lit(0.0)))


def nested_manifest(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """A row a clip with its frames as an array in order; clips without frames have an empty one."""
    f = with_global_times(frames, clips)
    one = F.struct(
        "frame_order", "frame_index", F.col("timestamp_sec").alias("local_timestamp_sec"), C.format_time(F.col("timestamp_sec")).alias("local_timestamp"), "global_timestamp_sec",
        C.format_time(F.col("global_timestamp_sec")).alias("global_timestamp"), "selected_reason", "combined_score",
    )
    nested = f.groupBy("clip_id").agg(F.array_sort(F.collect_list(one)).alias("selected_frames"))
    out = clips.join(nested, "clip_id", "left").withColumn("selected_frames", F.coalesce("selected_frames", F.array().cast(nested.schema["selected_frames"].dataType)))
    return out.withColumns({"actual_start_time": C.format_time(F.col("start_sec")), "actual_end_time": C.format_time(F.col("end_sec")), "selected_frame_count": F.size("selected_frames")})


def manifest_stats(manifest: DataFrame, low: float = 18.0, high: float = 22.0) -> DataFrame:
    """One row: clips, total, least and greatest duration, frames a clip, and clips whose duration isn't within low..high."""
    odd = ~F.col("duration_sec").between(low, high)
    return manifest.agg(
        F.count("*").alias("n_clips"), F.round(F.sum("duration_sec"), 6).alias("total_sec"), F.min("duration_sec").alias("min_sec"), F.max("duration_sec").alias("max_sec"),
        F.min("selected_frame_count").alias("min_frames"), F.max("selected_frame_count").alias("max_frames"), F.count_if(odd).alias("n_abnormal"),
    )


def cloud_path(path: Column, place: Column, prefix: str) -> Column:
    """Where a frame of clip_id, at its place in it, lies under prefix; a path in the store stays."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(path.rlike("(?i)^s3://"), path).otherwise(F.concat(F.lit(prefix.rstrip("/") + "/"), F.format_string("clip_%04d/%02d_", F.col("clip_id"), place), name))


def with_cloud_paths(manifest: DataFrame, prefix: str) -> DataFrame:
    """Frames' image_path under prefix as clip_%04d/%02d_<name>; the old one kept as source_image_path; paths in the store stay."""

    def moved(f, i):
        return f.withField("source_image_path", f["image_path"]).withField("image_path", cloud_path(f["image_path"], i, prefix))

    return manifest.withColumn("selected_frames", F.transform("selected_frames", moved))


def frame_sources(manifest: DataFrame, present: DataFrame, rows: int = RANGE_ROWS) -> DataFrame:
    """One row: how many frames are referred to, how many distinct paths, and how many aren't in present(image_path).

    Both sides are one table of paths, kept in the shared folder, so that it is made once and its rows are known: it is
    dealt by path into parts of about rows, each of which is summed by path for itself.
    """
    used = manifest.select(F.explode("selected_frames.image_path").alias("image_path")).select("image_path", F.lit(1).alias("n"))
    path = scratch(manifest.sparkSession, "sources") + "/paths"
    used.unionByName(present.select("image_path", F.lit(0).alias("n"))).write.parquet(path)
    both = manifest.sparkSession.read.parquet(path)
    by_path = both.repartition(max(1, -(-both.count() // rows)), "image_path").groupBy("image_path").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 0")
    there = (F.col("least") == 0) & F.col("image_path").isNotNull()  # a missing path is nowhere
    return by_path.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_references"), F.count("image_path").alias("n_paths"), F.coalesce(F.sum(F.when(there, 0).otherwise(F.col("n"))), F.lit(0)).alias("n_missing"))


def boundaries(clips: DataFrame, ranges: int | None = None) -> DataFrame:
    """Beyond the reference: a row for each pair of adjacent clips. Ranges of ids are sorted each for itself; a range's last clip meets the first of the next."""
    dealt = in_ranges(clips, ranges)
    firsts = dealt.groupBy("range").agg(F.min("clip_id").alias("first")).withColumn("after", F.lead("first").over(Window.orderBy("range")))
    inside = dealt.withColumn("inside", F.lead("clip_id").over(Window.partitionBy("range").orderBy("clip_id")))
    out = inside.join(F.broadcast(firsts.select("range", "after")), "range")  # a row a range
    return out.select("clip_id", F.coalesce("inside", "after").alias("next_clip_id"), "end_sec").where("next_clip_id is not null")
