"""Listings of files, digests, images, and clip summaries in whatever form they come."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.functions.jsontext import json_ok

#: Suffixes of videos.
VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "avi", "webm")
IMAGE = "*.{jpg,jpeg,png,webp,JPG,JPEG,PNG,WEBP}"
#: Names by which records call a clip's id and its summary, in the order they are tried.
ID_NAMES = ("clip_id", "clip", "id", "name", "video", "file", "filename")
SUMMARY_NAMES = ("summary", "caption", "description", "output", "answer", "response")
#: What lines and tables may call them besides.
MORE_ID_NAMES, MORE_SUMMARY_NAMES = ("video_path", "clip_path"), ("result",)
TABLE_ID_NAMES = ("clip_id", "clip", "id", "name", "file", "filename", "video", "video_path", "clip_path")
TABLE_SUMMARY_NAMES = ("summary", "caption", "description", "output", "answer", "text", "response", "result")
#: Folders that a bundle leaves out.
EXCLUDED_PARTS = (".git", ".idea", ".vscode", ".pytest_cache", "__pycache__", "evaluation", "src", "tests", "outputs", "episodes", "logs", "notebooks", ".venv", "venv", "env")


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, content: bool = False) -> DataFrame:
    """(path, length, modificationTime[, content]) of files; contents aren't read unless asked for. A folder that isn't there is empty."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    columns = ["path", "length", "modificationTime"] + ["content"] * content
    try:
        return reader.load(path).select(*columns)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, length bigint, modificationTime timestamp" + ", content binary" * content)


class NoFiles(ValueError):
    """A folder holds none of the files that a reader needs."""


def with_suffix(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    """The files whose name ends in one of suffixes, in either case."""
    return files.where(F.lower("path").rlike(r"\.(" + "|".join(suffixes) + ")$"))


def find_videos(spark: SparkSession, path: str, suffixes: tuple[str, ...] = VIDEO_SUFFIXES, needed: bool = False) -> DataFrame:
    """Videos of a folder, not of those in it, in the order of path; an error if there are none and one is needed."""
    out = with_suffix(listing(spark, path, recursive=False), suffixes).select("path").orderBy("path")
    if needed and out.isEmpty():
        raise NoFiles(f"no videos in {path}")
    return out


def clip_rows(files: DataFrame) -> DataFrame:
    """files(path) -> (clip_id, clip_path) of the videos among them."""
    return with_suffix(files, VIDEO_SUFFIXES).select(C.normalize_clip_id(F.col("path")).alias("clip_id"), F.col("path").alias("clip_path"))


def scan_clips(spark: SparkSession, path: str) -> DataFrame:
    return clip_rows(listing(spark, path)).orderBy("clip_id", "clip_path")


def keyframe_rows(paths: DataFrame) -> DataFrame:
    """paths(path) of images -> (clip_id, frame_id, timestamp, frame_path); the index is the place in the clip by path, from 1."""
    rows = paths.withColumn("clip_id", C.normalize_clip_id(F.col("path")))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("clip_id").orderBy("path")))
    rows = rows.withColumn("name", F.lower(C.stem(F.col("path"))))  # once for all that is looked for in it
    return rows.select("clip_id", C.frame_id_of(F.col("name"), F.col("i")).alias("frame_id"), C.timestamp_of(F.col("name"), F.col("i")).alias("timestamp"), F.col("path").alias("frame_path"))


def scan_keyframes(spark: SparkSession, path: str) -> DataFrame:
    return keyframe_rows(listing(spark, path, IMAGE).select("path")).orderBy("clip_id", "timestamp", "frame_id")


def with_digest(files: DataFrame) -> DataFrame:
    """files(content) with the SHA-256 of their content, in lower-case hex."""
    return files.withColumn("sha256", F.sha2("content", 256))


def bundle_rows(files: DataFrame) -> DataFrame:
    """files(relative_path, length, content) -> (relative_path, size_bytes, sha256) of those that lie in no excluded part."""
    parts = F.split("relative_path", "/")
    kept = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, EXCLUDED_PARTS))))
    return with_digest(kept).select("relative_path", F.col("length").alias("size_bytes"), "sha256")


def bundle_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a bundle that is a folder."""
    root = path.rstrip("/") + "/"
    return bundle_rows(listing(spark, path, content=True).withColumn("relative_path", F.regexp_replace("path", "^.*?" + root.replace(".", r"\."), "")))


def bundle_totals(planned: DataFrame) -> DataFrame:
    """One row about planned(size_bytes, reuse): files, bytes, GiB, and how many are uploaded or there already."""
    return planned.agg(F.count("*").alias("file_count"), F.sum("size_bytes").alias("total_bytes"), C.gib(F.sum("size_bytes")).alias("total_gib"), F.count_if(~F.col("reuse")).alias("uploaded"), F.count_if("reuse").alias("skipped"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, gray array<int>) of images; ones that can't be read have null gray."""
    from frameloom.operators.signals import gray_pixels

    df = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path).select("image.*")
    return df.select(F.col("origin").alias("path"), "height", "width", gray_pixels("data", "height", "width", "nChannels").alias("gray"))


def filled(record: Column, name: str) -> Column:
    """A record's value as text; null, zero, false and the empty text fall through to the next name, text of a zero doesn't."""
    text = F.try_variant_get(record, f"$.{name}", "string")
    kind = F.schema_of_variant(F.try_variant_get(record, f"$.{name}", "variant"))
    blank = (text == "") | ((kind != "STRING") & text.isin("0", "0.0", "-0.0", "false"))
    return F.when(~blank, text)


def coalesced(record: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[filled(record, n) for n in names])


def summaries_of(records: DataFrame, more_ids: tuple[str, ...] = (), more_summaries: tuple[str, ...] = ()) -> DataFrame:
    """records(v variant[, key]) -> (clip_id, summary): a map's key is the id, else what the record calls it; without one it is left out."""
    key = F.col("key") if "key" in records.columns else F.lit(None).cast("string")
    plain = ~F.schema_of_variant("v").startswith("OBJECT")
    summary = F.when(key.isNotNull() & plain, F.try_variant_get("v", "$", "string")).otherwise(F.coalesce(coalesced(F.col("v"), SUMMARY_NAMES + more_summaries), F.lit("")))
    out = records.where(key.isNotNull() | ~plain).select(F.coalesce(key, coalesced(F.col("v"), ID_NAMES + more_ids)).alias("raw"), summary.alias("summary"))
    return out.where("raw is not null").select(C.normalize_clip_id(F.col("raw")).alias("clip_id"), F.coalesce("summary", F.lit("")).alias("summary"))


def kind_of(path: str) -> str:
    """What a path's suffix says of it: json, jsonl or csv; without a suffix it is a folder of texts."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[-1] if "." in name else "folder"


def scan_summaries(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(clip_id, summary) in the order of id from a folder of texts, a JSON list or map, JSON lines or a CSV table; the path says which."""
    kind = kind or kind_of(path)
    if kind == "folder":
        files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{txt,md}", recursiveFileLookup=True).select(F.input_file_name().alias("p"), "value")
        out = files.select(C.normalize_clip_id(F.col("p")).alias("clip_id"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("summary"))
    elif kind == "json":
        whole = spark.read.text(path, wholetext=True).select(F.parse_json(F.regexp_replace("value", "^﻿", "")).alias("j"))
        rows = whole.lateralJoin(spark.tvf.variant_explode(F.col("j").outer())).select("key", F.col("value").alias("v"))
        out = summaries_of(rows)
    elif kind == "jsonl":
        lines = spark.read.text(path).where(json_ok("value") & F.col("value").rlike(r"^\s*\{")).select(F.try_parse_json("value").alias("v")).where("v is not null")
        out = summaries_of(lines, MORE_ID_NAMES, MORE_SUMMARY_NAMES)
    elif kind == "csv":
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
        names = {c.lstrip("﻿").strip().lower(): c for c in df.columns}
        ids, texts = ([names[n] for n in wanted if n in names] for wanted in (TABLE_ID_NAMES, TABLE_SUMMARY_NAMES))
        if not ids or not texts:
            raise ValueError(f"no column for the id or the summary in {df.columns}")
        out = df.select(C.normalize_clip_id(F.col(f"`{ids[0]}`")).alias("clip_id"), F.coalesce(F.col(f"`{texts[0]}`"), F.lit("")).alias("summary"))
    else:
        raise ValueError(f"unknown kind of summaries: {kind}")
    return out.orderBy("clip_id")


#: The columns of a manifest's table.
MANIFEST_COLUMNS = ("clip_id", "clip_file", "duration_sec", "actual_start_time", "actual_end_time", "selected_frame_count", "video_path", "keyframe_output_dir", "contact_sheet_path", "sampler_metadata_path", "sampler_error")


def write_csv(df: DataFrame, path: str, columns: list[str] | tuple[str, ...] | None = None, bom: bool = False, needed: bool = False) -> None:
    """A table with a header, with a byte-order mark before it if asked for; an error if there are no rows and some are needed."""
    if needed and df.isEmpty():
        raise NoFiles(f"nothing to write to {path}")
    names = list(columns or df.columns)
    out = df.select(*names)
    if bom:
        out = out.toDF("\ufeff" + names[0], *names[1:])
    out.write.mode("overwrite").csv(path, header=True, escape='"')  # quotes within a value are doubled


def basic_check(df: DataFrame, key: str = "clip_id") -> DataFrame:
    """One row: rows, distinct keys, and the first three rows by key as JSON."""
    first = df.orderBy(key, *[c for c in df.columns if c != key]).limit(3).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns)))).alias("sample"))
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys")).crossJoin(first)  # single rows


def read_csv(spark: SparkSession, path: str, needed: tuple[str, ...] = (), schema: str | None = None) -> DataFrame:
    """A table with a header; a byte-order mark is dropped from the first name; an error if a needed column isn't there."""
    df = spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    lost = [c for c in needed if c not in df.columns]
    if lost:
        raise ValueError(f"columns {lost} aren't in {path}")
    return df
