"""JSON lines: strict and tolerant readers with provenance, and the writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from frameloom.functions.jsontext import json_ok
from frameloom.sources.folders import scratch


class BadLine(ValueError):
    """A line isn't what a strict reader takes."""


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def read_lines(spark: SparkSession, path: str | list[str], together: bool = False) -> DataFrame:
    """(file, line_num, text) of the non-blank lines, read line by line.

    A line's number is its place in its split and how many lines the file's splits before have: a row a split is summed.
    Files that are together the parts of one log, in the order of their paths, are numbered on from one to the next.
    """
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    lines = spark.read.text(path).select(at.alias("at"), F.monotonically_increasing_id().alias("i"), "value")
    log = Window.orderBy("at.path", "at.block") if together else Window.partitionBy("at.path").orderBy("at.block")
    before = log.rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("at").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("at", "first", "offset")
    numbered = lines.join(F.broadcast(splits), "at").select(F.element_at(F.split("at.path", "/"), -1).alias("file"), (F.col("i") - F.col("first") + F.col("offset") + 1).cast("int").alias("line_num"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return numbered.where(F.trim("text") != "")


def read_tolerant(spark: SparkSession, path: str | list[str], schema: StructType | str, key: str | None = "clip_id", together: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, counts): records are the lines that a strict parser takes and that have a key, with file and line_num (see
    read_lines); counts is one row of how many lines were valid and not. A path that isn't there has no lines."""
    try:
        lines = read_lines(spark, path, together)
        lines.schema
    except AnalysisException as e:
        if not _missing(e):
            raise
        lines = spark.createDataFrame([], "file string, line_num int, text string")
    parsed = lines.withColumn("ok", json_ok("text")).withColumn("r", F.from_json("text", schema))
    good = F.col("ok") & (F.col(f"r.{key}").isNotNull() if key else F.lit(True))
    records = parsed.where(good).select("file", "line_num", "r.*")
    return records, parsed.agg(F.count_if(good).alias("valid"), F.count_if(~F.coalesce(good, F.lit(False))).alias("invalid"))


def read_strict(spark: SparkSession, path: str | list[str], schema: StructType | str, key: str | None = "clip_id", unique: bool = True) -> DataFrame:
    """Records in the order of key; an error for bad lines, missing keys, repeated keys and no lines at all.

    The files are read once: the records are written to the shared folder, and how many lines were good, bad and repeated is
    observed as they pass. Only an error looks again, for the keys that it names.
    """
    try:
        lines = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    except AnalysisException as e:
        raise (BadLine("there are no lines") if _missing(e) else e) from e
    parsed = lines.where(F.trim("text") != "").withColumn("ok", json_ok("text")).withColumn("r", F.from_json("text", schema))
    good = F.coalesce(F.col("ok") & (F.col(f"r.{key}").isNotNull() if key else F.lit(True)), F.lit(False))
    seen, twice = Observation(), Observation()
    records = parsed.observe(seen, F.count_if(~good).alias("invalid")).where(good).select("file", "r.*")
    if key and unique:
        place = F.row_number().over(Window.partitionBy(key).orderBy("file"))
        records = records.withColumn("_place", place).observe(twice, F.count_if(F.col("_place") == 2).alias("n")).drop("_place")
    held = f"{scratch(spark, 'records')}/r"
    records.write.parquet(held)
    out = spark.read.schema(records.schema).parquet(held)
    # where nothing is left nothing may have been observed
    bad = parsed.where(~good).count() if out.isEmpty() else seen.get["invalid"]
    if bad or out.isEmpty():
        raise BadLine(f"{bad} lines can't be read" if bad else "there are no lines")
    if key and unique and twice.get["n"]:
        names = [r[0] for r in out.groupBy(key).count().where("count > 1").orderBy(key).limit(10).collect()]
        raise BadLine(f"repeated {key}: {names}")
    return out.orderBy(key) if key else out


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """An object a line, nulls kept. With order the lines are in it, within each file and from file to file by their numbers."""
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_attempts(df: DataFrame, path: str) -> None:
    """The append-only log of attempts, a folder a shard."""
    df.write.mode("append").partitionBy("shard").option("ignoreNullFields", "false").json(path)


def compact_successes(attempts: DataFrame, path: str) -> None:
    """The last success of each clip, in the order of id, in a new folder."""
    from frameloom.operators.shards import latest_success

    write_jsonl(latest_success(attempts), path, ["clip_id"])


def swap(spark: SparkSession, new: str, path: str, backup: str) -> None:
    """Puts the folder new in the place of path, whose content is kept as backup."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(to(path)) and not files.rename(to(path), to(backup)):
        raise OSError(f"{path} can't be kept as {backup}")
    if not files.rename(to(new), to(path)):
        raise OSError(f"{new} can't be put in the place of {path}")


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """Several tables under one folder, each as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
