"""Which clips a worker takes, what is left to do, and whether a step is complete."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.timeline import in_ranges


class MissingClips(ValueError):
    """Clips were asked for that the manifest doesn't have, or has twice."""


def success() -> Column:
    """An attempt's record without error whose model output parsed."""
    return F.col("error").isNull() & F.col("json_parse_ok").eqNullSafe(True)


def duplicate_ids(records: DataFrame, key: str = "clip_id") -> DataFrame:
    return records.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def checked(records: DataFrame, key: str = "clip_id") -> DataFrame:
    """records, or an error that names the first ten repeated ids."""
    twice = [r[0] for r in duplicate_ids(records, key).orderBy(key).limit(10).collect()]
    if twice:
        raise MissingClips(f"repeated {key}: {twice}")
    return records


def requested(records: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of ids(clip_id), or an error that names some that aren't there."""
    lost = [r[0] for r in ids.join(records, "clip_id", "left_anti").orderBy("clip_id").limit(10).collect()]
    if lost:
        raise MissingClips(f"not in the manifest: {lost}")
    return records.join(ids.distinct(), "clip_id", "left_semi")


def positions(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """records with their place (from 0) in the order of clip_id.

    No task sorts all of them, unless ranges is 1: counts of ranges give each range its offset.
    """
    if ranges == 1:
        return records.withColumn("position", F.row_number().over(Window.orderBy("clip_id")) - 1)
    dealt = in_ranges(records, ranges)
    counts = dealt.groupBy("range").count().withColumn("offset", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("range").orderBy("clip_id")) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(counts.select("range", "offset")), "range").withColumn("position", (F.col("offset") + F.col("inside")).cast("int")).drop("range", "offset", "inside")


def assigned(records: DataFrame, shards: int, shard: int | None = None, ranges: int | None = None) -> DataFrame:
    """records with shard, the place modulo shards after any filter before; only one shard's if asked for."""
    out = positions(records, ranges).withColumn("shard", F.col("position") % shards)
    return out if shard is None else out.where(F.col("shard") == shard)


def completed(attempts: DataFrame) -> DataFrame:
    return attempts.where(success()).select("clip_id").distinct()


def bucketed(df: DataFrame, path: str, buckets: int, key: str = "clip_id") -> DataFrame:
    """df, written to path in buckets of key, each sorted: joins and groupings by key of tables with as many buckets move no rows.

    The table is in no catalog afterwards; its files stay in path.
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name, format="parquet")
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: only its name goes
    return out


def remaining(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """What no successful attempt has done."""
    return records.join(completed(attempts), "clip_id", "left_anti")


def latest_success(attempts: DataFrame) -> DataFrame:
    """The last successful record of each clip by line."""
    by = Window.partitionBy("clip_id").orderBy(F.desc("line"))
    return attempts.where(success()).withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def step_complete(expected: DataFrame, done: DataFrame) -> DataFrame:
    """One row (complete, reason): nothing expected is incomplete; missing clips are told before failed ones.

    expected(clip_id), done(clip_id, error).
    """
    lost = expected.join(done, "clip_id", "left_anti").agg(F.count("*").alias("missing"))
    counts = expected.agg(F.count("*").alias("n"))
    failed = done.join(expected, "clip_id", "left_semi").agg(F.count_if(F.col("error").isNotNull()).alias("failed"))
    all_of = counts.crossJoin(lost).crossJoin(failed)  # three single rows
    reason = F.when(F.col("n") == 0, "no clips").when(F.col("missing") > 0, F.format_string("%d missing", "missing")).when(F.col("failed") > 0, F.format_string("%d failed", "failed")).otherwise("complete")
    return all_of.select((reason == "complete").alias("complete"), reason.alias("reason"), "n", "missing", "failed")


def retryable(error_type: Column) -> Column:
    return ~error_type.isin("FileNotFoundError", "NO_KEYFRAMES")
