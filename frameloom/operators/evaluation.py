"""Metrics of keyframe choices: quality flags, near-duplicates, motion-event coverage, roll-ups and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.functions import columns as C

#: Default thresholds of the evaluation.
BLUR, ENTROPY, DARK, BRIGHT, SIMILAR = 80.0, 4.2, 25.0, 235.0, 0.96
MOTION_QUANTILE, TOLERANCE = 0.8, 1.0


def entropy(counts: Column) -> Column:
    """Entropy of a histogram of 256 bins over [0, 255], of densities: each share is 256 / 255 times its part of all."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c)
    shares = C.let(total, lambda n: F.transform(F.filter(counts, lambda c: c > 0), lambda c: c / n * (256.0 / 255.0)))
    return -F.aggregate(shares, F.lit(0.0), lambda s, h: s + h * F.log2(h))


def with_similarity(frames: DataFrame) -> DataFrame:
    """frames(clip_id, timestamp, frame_id, vector) with similarity to the vector before it in the clip; rows without one are skipped, not a break."""
    by = Window.partitionBy("clip_id").orderBy(F.asc_nulls_last("timestamp"), "frame_id").rowsBetween(Window.unboundedPreceding, -1)
    out = frames.withColumn("before", F.last("vector", ignorenulls=True).over(by))
    return out.withColumn("similarity", C.cosine(F.col("vector"), F.col("before"))).drop("before")


def with_flags(frames: DataFrame) -> DataFrame:
    """Quality flags of frames(sharpness, entropy, brightness, similarity); null sharpness, entropy and brightness is a missing image."""
    gone = F.col("sharpness").isNull() & F.col("entropy").isNull() & F.col("brightness").isNull()
    flag = lambda test, missing: F.when(gone, missing).otherwise(F.coalesce(test, F.lit(False)).cast("int"))
    out = frames.withColumns(
        {
            "blurry": flag(F.col("sharpness") < BLUR, 1),
            "low_entropy": flag(F.col("entropy") < ENTROPY, 1),
            "dark_or_bright": flag((F.col("brightness") < DARK) | (F.col("brightness") > BRIGHT), 1),
            "duplicate": flag(F.col("similarity") >= SIMILAR, 0),
        }
    )
    names = (("blurry", "blurry"), ("low_entropy", "low entropy"), ("dark_or_bright", "too dark/bright"), ("duplicate", "near duplicate"))
    why = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == 1, label) for c, label in names])), "; ")
    out = out.withColumn("low_info", F.greatest(*[F.col(c) for c, _ in names]))
    return out.withColumn("low_info_reason", F.when(gone, "missing image").otherwise(why))


def sampler_failures(frames: DataFrame, expected: int) -> DataFrame:
    """(clip_id, generated, valid, failed); a clip without a row isn't seen. frames(clip_id, valid)."""
    out = frames.where("clip_id is not null").groupBy("clip_id").agg(F.count("*").alias("generated"), F.count_if("valid").alias("valid_frames"))
    return out.withColumn("failed", ((F.col("generated") < expected) | (F.col("valid_frames") < expected)).cast("int"))


def motion_events(motion: DataFrame, quantile: float = MOTION_QUANTILE) -> DataFrame:
    """Samples at or above their clip's quantile of score; all of them where all are equal."""
    by = Window.partitionBy("clip_id")
    return motion.withColumn("threshold", F.percentile("score", quantile).over(by)).where(F.col("score") >= F.col("threshold"))


def motion_coverage(events: DataFrame, keyframes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(clip_id, n_events, n_covered, coverage): events with a keyframe within tolerance in their clip.

    Times are dealt into bins of the tolerance and a keyframe offered to its own and both neighbours, so it is an
    equality join for long clips as well. Clips of keyframes without events have null coverage.
    """
    e = events.withColumn("bin", F.floor(F.col("timestamp") / tolerance)).withColumn("_e", F.monotonically_increasing_id())
    k = keyframes.select("clip_id", F.col("timestamp").alias("k")).distinct().withColumn("bin", F.explode(F.array(*[F.floor(F.col("k") / tolerance) + d for d in (-1, 0, 1)])))
    hit = e.join(k, (e.clip_id == k.clip_id) & (e.bin == k.bin) & (F.abs(e.timestamp - k.k) <= tolerance), "left_semi").select("clip_id", F.lit(1).alias("covered"))
    n = e.groupBy("clip_id").agg(F.count("*").alias("n_events"))
    c = hit.groupBy("clip_id").agg(F.count("*").alias("n_covered"))
    clips = keyframes.select("clip_id").distinct().join(n, "clip_id", "left").join(c, "clip_id", "left")
    out = clips.select("clip_id", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_covered", F.lit(0)).alias("n_covered"))
    return out.withColumn("coverage", F.when(F.col("n_events") > 0, F.col("n_covered") / F.col("n_events")))


def summary(frames: DataFrame, failures: DataFrame, coverage: DataFrame) -> DataFrame:
    """A row a version: clips, frames, mean flags, failed clips and mean coverage (nulls skipped)."""
    f = frames.groupBy("version").agg(
        F.count_distinct("clip_id").alias("n_clips"), F.count("*").alias("n_frames"), *[F.round(F.avg(c), 6).alias(f"{c}_ratio") for c in ("low_info", "blurry", "low_entropy", "dark_or_bright", "duplicate")]
    )
    s = failures.groupBy("version").agg(F.sum("failed").alias("n_failed"))
    c = coverage.groupBy("version").agg(F.round(F.avg("coverage"), 6).alias("mean_coverage"))
    return f.join(s, "version", "left").join(c, "version", "left")


def comparison(metrics: DataFrame, names: list[str], first: str = "fixed", second: str = "improved") -> DataFrame:
    """(metric, fixed, improved, change) of the two versions' rows; nothing if one is missing."""
    long = metrics.where(F.col("version").isin(first, second)).select("version", *[F.col(n).cast("double").alias(n) for n in names]).unpivot(["version"], names, "metric", "value")
    side = lambda v: F.first(F.when(F.col("version") == v, F.struct("value")), ignorenulls=True)
    both = long.groupBy("metric").agg(side(first).alias("a"), side(second).alias("b")).where("a is not null and b is not null")
    return both.select("metric", F.col("a.value").alias("fixed"), F.col("b.value").alias("improved"), (F.col("b.value") - F.col("a.value")).alias("change"))


def path_map(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """clip_id to path: the scan's (ids lower-cased) before the manifest's."""
    both = manifest.select("clip_id", "clip_path", F.lit(1).alias("p")).unionByName(scan.select(F.lower("clip_id").alias("clip_id"), "clip_path", F.lit(0).alias("p")))
    return both.groupBy("clip_id").agg(F.min_by("clip_path", F.struct("p", "clip_path")).alias("clip_path"))
