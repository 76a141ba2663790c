"""Shard outputs merged to the best record of each clip, and how complete that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.shards import success


def finished_time(*names: Column) -> Column:
    """The first of names as local time: an offset is dropped, not applied; what doesn't parse is the earliest time."""
    text = F.regexp_replace(F.coalesce(*[F.nullif(n, F.lit("")) for n in names]), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.coalesce(text.try_cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))


def best_records(attempts: DataFrame, ok: Column | None = None) -> DataFrame:
    """One record of each clip: successful before not, then finished last, then the last line, then the first file."""
    ok = success() if ok is None else ok
    by = Window.partitionBy("clip_id").orderBy(ok.cast("int").desc(), F.desc("finished"), F.desc("line"), F.asc("file"))
    return attempts.withColumn("r", F.row_number().over(by)).where("r = 1").drop("r")


def without_internal(records: DataFrame, prefix: str = "_aggregation_") -> DataFrame:
    return records.drop(*[c for c in records.columns if c.startswith(prefix)])


def merge_problems(attempts: DataFrame, best: DataFrame, expected: DataFrame) -> DataFrame:
    """(problem, clip_id): duplicate (before records are held to what is expected), missing, unsuccessful."""
    held = best.join(expected, "clip_id", "left_semi")
    named = lambda df, problem: df.select(F.lit(problem).alias("problem"), "clip_id")
    twice = attempts.groupBy("clip_id").count().where("count > 1")
    return named(twice, "duplicate").unionByName(named(expected.join(held, "clip_id", "left_anti"), "missing")).unionByName(named(held.where(~success()), "unsuccessful"))


def merge_summary(attempts: DataFrame, best: DataFrame, expected: DataFrame, invalid_lines: int = 0, most: int = 10) -> DataFrame:
    """One row about a merge: counts, and of each problem how many clips and the first most ids. All of them are in merge_problems."""
    problems = merge_problems(attempts, best, expected)
    first = problems.withColumn("r", F.row_number().over(Window.partitionBy("problem").orderBy("clip_id"))).where(F.col("r") <= most)
    kinds = ("duplicate", "missing", "unsuccessful")
    counts = problems.agg(*[F.count_if(F.col("problem") == k).alias(f"n_{k}") for k in kinds])
    ids = first.agg(*[F.array_sort(F.collect_list(F.when(F.col("problem") == k, F.col("clip_id")))).alias(f"{k}_ids") for k in kinds])
    rows = attempts.agg(F.count("*").alias("raw_valid"), F.count_distinct("clip_id").alias("unique_clips"))
    kept = best.join(expected, "clip_id", "left_semi").agg(F.count("*").alias("selected"), F.count_if(success()).alias("successes"))
    out = rows.withColumn("invalid_lines", F.lit(invalid_lines)).crossJoin(kept).crossJoin(counts).crossJoin(ids)  # single rows each
    # records are held to what is expected before, so none is unexpected
    out = out.withColumns({"n_unexpected": F.lit(0).cast("long"), "unexpected_ids": F.slice("duplicate_ids", 1, 0)})
    return out.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_unsuccessful") == 0))


def reusable(planned: DataFrame, there: DataFrame, verify: bool = True) -> DataFrame:
    """planned(path, size, digest) with reuse: there is a file of the same size, and of the same digest if verified."""
    local = there.select("path", F.col("size").alias("_size"), F.col("digest").alias("_digest"))
    same = (F.col("size") == F.col("_size")) & (F.lit(not verify) | (F.col("digest") == F.col("_digest")))
    return planned.join(local, "path", "left").withColumn("reuse", F.coalesce(same, F.lit(False))).drop("_size", "_digest")


def to_upload(planned: DataFrame, remote: DataFrame) -> DataFrame:
    """What isn't in the store with the same size."""
    return planned.join(remote, ["path", "size"], "left_anti")
