"""Streams: job states gone on from batch to batch, tailing of attempt logs, and windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.operators import jobstate as Z

EVENT = "run_id string, clip_id long, seq long, op string, result string, status string, attempt int"


def folders(spark: SparkSession, path: str, start: str) -> list[str]:
    """Names of the finished folders in path that begin with start, in order."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda x: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))
    return sorted(x.getPath().getName() for x in files.listStatus(where) if x.getPath().getName().startswith(start) and done(x)) if files.exists(where) else []


def current_states(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The states after the last batch (before batch number before)."""
    names = [n for n in folders(spark, path, "states-") if before is None or int(n.split("-")[1]) < before]
    return spark.read.parquet(f"{path}/{names[-1]}") if names else None


def state_keeper(path: str, dialect: str = "strict", lease_seconds: float = 7200, max_attempts: int = 3) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: folds a batch of events(run_id, clip_id, seq, op, worker, now, retryable) on the states of the batch before.

    It is the batch engine's transition, so there is but one. Each batch writes its states and what came of its events
    under its number; a batch that is run again after a crash starts from the same states and writes the same. Clips that
    aren't known yet are made pending first. Leases run out by the time of the next claim.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = batch.withColumn("error", F.lit(None).cast("string")) if "error" not in batch.columns else batch
        states = current_states(spark, path, number)
        if states is None:
            states = events.select("run_id", "clip_id", Z.initial().alias("s")).select("run_id", "clip_id", "s.*").limit(0)
        out = Z.fold(events, dialect, lease_seconds, max_attempts, Z.initialise(states, events), trace=True)
        out.write.mode("overwrite").parquet(f"{path}/made-{number:012d}")
        made = spark.read.parquet(f"{path}/made-{number:012d}")
        made.select("run_id", "clip_id", F.explode("results").alias("r")).select("run_id", "clip_id", "r.*").write.mode("overwrite").parquet(f"{path}/results-{number:012d}")
        made.drop("results").write.mode("overwrite").parquet(f"{path}/states-{number:012d}")

    return keep


def results(spark: SparkSession, path: str) -> DataFrame:
    """What came of the events of all batches (EVENT)."""
    names = folders(spark, path, "results-")
    return spark.read.parquet(*[f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], EVENT)


def deduplicated_attempts(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A tailed attempt log without the rows that a restarted worker wrote again within delay."""
    return attempts.withWatermark("finished", delay).dropDuplicatesWithinWatermark(["clip_id", "worker_id", "attempt"])


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Beyond the reference: events(ts, event_type) in tumbling windows, late ones within delay counted."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
