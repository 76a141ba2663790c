"""Model calls over clips: loaded once a task and only if it has rows, errors kept as rows, fewer frames on memory errors.

The model is any callable that a loader returns; it gets a record and its frames and returns text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.functions import jsontext as J
from frameloom.operators import jobstate as Z
from frameloom.operators import selection as K
from frameloom.operators import shards as R
from frameloom.sources.folders import scratch

RAW = "clip_id int, raw_output string, error_type string, error string, frames_used int, note string, elapsed_sec double, started_at_utc string, finished_at_utc string"
INPUT_MODE = "content_aware_keyframes_as_images"


def utc_now() -> str:
    return datetime.now(UTC).isoformat()


def with_fallback(model: Callable, record: dict, frames: list, fewer: int) -> tuple[str, int, str | None]:
    """(output, frames used, note): once more with fewer frames on a memory error; if that fails so too, the first error is raised."""
    try:
        return model(record, frames), len(frames), None
    except MemoryError as first:
        if len(frames) <= fewer:
            raise
        try:
            return model(record, frames[:fewer]), fewer, f"retried with {fewer} frames"
        except MemoryError:
            raise first from None


def infer(records: DataFrame, loader: Callable[[], Callable], fewer: int = 8, together: int = 256) -> DataFrame:
    """records(clip_id, frames array<string>) -> RAW, a row a record; a failed call is a row with its error. At most together answers are held at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in (whole[s : s + together] for whole in batches for s in range(0, len(whole), together)):
            out = []
            for r in b.to_dict("records"):
                began, started = time.monotonic(), utc_now()
                try:
                    model = model or loader()
                    frames = list(r["frames"]) if r["frames"] is not None else []
                    if not frames:
                        raise RuntimeError("no usable frames")
                    text, n, note = with_fallback(model, r, frames, fewer)
                    row = (text, None, None, n, note)
                except Exception as e:  # noqa: BLE001  kept as the record's outcome
                    row = (None, type(e).__name__, str(e), 0, None)
                out.append((r["clip_id"], *row, round(time.monotonic() - began, 6), started, utc_now()))
            yield pd.DataFrame(out, columns=["clip_id", "raw_output", "error_type", "error", "frames_used", "note", "elapsed_sec", "started_at_utc", "finished_at_utc"])

    return records.select(F.col("clip_id").cast("int").alias("clip_id"), "frames").mapInPandas(run, RAW)


def output_records(raw: DataFrame, worker_id: str, version: str) -> DataFrame:
    """RAW -> worker output: the object in the text, whether it parses, and its fields; an error leaves both out."""
    text = J.brace_bounded(F.col("raw_output"))
    out = raw.withColumn("text", F.when(F.col("error").isNull(), text)).withColumn("json_parse_ok", F.coalesce(J.json_ok("text"), F.lit(False)))
    return out.select("clip_id", F.lit(worker_id).alias("worker_id"), F.lit(version).alias("version"), "raw_output", "error_type", "error", "frames_used", "note", "elapsed_sec", "json_parse_ok", F.when(F.col("json_parse_ok"), F.from_json("text", J.MODEL_JSON)).alias("parsed_json"))


@dataclass(frozen=True)
class ModelSettings:
    """What an output record says of how it was made."""

    version: str = "1"
    worker_id: str = ""
    shard: int = 0
    shards: int = 1
    most_frames: int = 8
    max_new_tokens: int = 800
    min_pixels: int = 200704
    max_pixels: int = 401408
    dtype: str = "auto"


def full_records(raw: DataFrame, records: DataFrame, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """RAW and what was asked -> the whole output record of each clip.

    records(clip_id, clip_file, actual_start_time, actual_end_time, duration_sec, chosen array<struct>, missing array<string>):
    chosen are the frames in their order, of which the first frames_used were used. With an error nothing is parsed.
    """
    ok = F.col("error").isNull()
    text = J.brace_bounded(F.col("raw_output"))
    one = raw.withColumn("cleaned_output", F.when(ok, text)).withColumn("json_parse_ok", F.coalesce(J.json_ok("cleaned_output"), F.lit(False)))
    used = F.transform(F.slice("chosen", F.lit(1), F.col("frames_used")), lambda f, i: F.struct(i.alias("frame_order"), *[f[c].alias(c) for c in ("image_path", "local_timestamp", "global_timestamp", "selected_reason", "combined_score")]))
    facts = {
        "version": F.lit(settings.version), "input_mode": F.lit(INPUT_MODE), "worker_id": F.lit(settings.worker_id), "shard_index": F.lit(settings.shard), "num_shards": F.lit(settings.shards),
        **{c: F.col(c) for c in ("clip_id", "clip_file", "actual_start_time", "actual_end_time", "duration_sec", "started_at_utc", "finished_at_utc")},
        "elapsed_seconds": F.bround("elapsed_sec", 6), "selected_frame_count": F.col("frames_used"), "missing_frame_paths": F.col("missing"), "selected_frames_used": used,
        "max_keyframes_per_clip": F.lit(settings.most_frames), "max_new_tokens": F.lit(settings.max_new_tokens), "min_pixels": F.lit(settings.min_pixels), "max_pixels": F.lit(settings.max_pixels), "dtype_requested": F.lit(settings.dtype),
        "raw_output": F.coalesce("raw_output", F.lit("")), "cleaned_output": F.col("cleaned_output"), "parsed_json": F.when(F.col("json_parse_ok"), F.from_json("cleaned_output", J.MODEL_JSON)), "json_parse_ok": F.col("json_parse_ok"), "error_type": F.col("error_type"), "error": F.col("error"),
    }
    return one.join(records, "clip_id").select(*[v.alias(k) for k, v in facts.items()])


def review_rows(outputs: DataFrame) -> DataFrame:
    """Flat rows for reviewers, with blank columns for their scores."""
    blank = {f"{n}_score": F.lit("") for n in ("object", "action", "scene", "hallucination", "completeness", "overall")} | {"human_notes": F.lit("")}
    p = F.col("parsed_json")
    flat = outputs.select("clip_id", p.clip_file.alias("clip_file"), p.actual_start_time.alias("start_time"), p.actual_end_time.alias("end_time"), "json_parse_ok", F.coalesce(p.summary, F.lit("")).alias("model_summary"), F.coalesce(p.setting, F.lit("")).alias("model_setting"), F.coalesce(F.array_join(p.main_subjects, ", "), F.lit("")).alias("model_subjects"), J.stringify_events(p.events).alias("model_events"))
    return flat.withColumns(blank)


def run_worker(manifest: DataFrame, attempts: DataFrame, loader: Callable[[], Callable], worker_id: str, shards: int = 1, shard: int = 0, most_frames: int = 8, version: str = "1") -> DataFrame:
    """A worker's outputs: its shard of the manifest's clips that no attempt has finished, their best frames, the model, the records.

    manifest(clip_id, selected_frames array<struct<frame_order, timestamp_sec, combined_score, image_path>>), attempts(clip_id, error, json_parse_ok).
    """
    todo = R.remaining(R.assigned(R.checked(manifest), shards, shard), attempts)
    frames = todo.select("clip_id", F.explode("selected_frames").alias("f")).select("clip_id", "f.*").where("image_path is not null")
    chosen = K.choose_keyframes(frames, most_frames).groupBy("clip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "image_path"))), lambda x: x["image_path"]).alias("frames"))
    return output_records(infer(todo.select("clip_id").join(chosen, "clip_id", "left"), loader), worker_id, version)


def run_claimed(manifest: DataFrame, attempts: DataFrame, states: DataFrame, loader: Callable[[], Callable], worker: str, run_id: str, log: str, now: float, shards: int = 1, shard: int = 0, most_frames: int = 8, dialect: str = "strict", lease_seconds: float = 7200, max_attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """A worker that shares its clips by job states: (outputs, states after).

    What is left of its shard is claimed, only claimed clips go to the model, the outputs are appended to log with the
    attempt that made them (once: a model needn't answer alike twice) and told back: a success, or a failure that may be
    retried but for lost files. Rows of earlier attempts stay in log, but only those of the attempts claimed here count.
    """
    spark = manifest.sparkSession
    todo = R.remaining(R.assigned(R.checked(manifest), shards, shard), attempts).select(F.lit(run_id).alias("run_id"), "clip_id", "selected_frames")
    event = lambda df, seq, op, retry, error: df.select("run_id", "clip_id", F.lit(seq).alias("seq"), op.alias("op"), F.lit(worker).alias("worker"), F.lit(float(now)).alias("now"), retry.alias("retryable"), error.cast("string").alias("error"))
    claims = event(todo, 0, F.lit("claim"), F.lit(False), F.lit(None))
    path = scratch(spark, "claims")
    Z.fold(claims, dialect, lease_seconds, max_attempts, Z.initialise(states, claims)).write.parquet(f"{path}/held")
    held = spark.read.parquet(f"{path}/held")
    mine = held.where((F.col("worker") == worker) & (F.col("last_result") == "claimed") & (F.col("run_id") == run_id)).select("clip_id", "attempt")
    outputs = run_worker(manifest.join(mine, "clip_id", "left_semi"), attempts, loader, worker, most_frames=most_frames)
    outputs.join(mine, "clip_id").withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(log)
    told = spark.read.parquet(log).where((F.col("run_id") == run_id) & (F.col("worker_id") == worker))
    made = told.join(mine, ["clip_id", "attempt"], "left_semi")
    kind = F.coalesce("error_type", F.lit("JSON_PARSE_FAILED"))
    why = F.coalesce("error", F.lit("the output isn't JSON"))
    marks = event(made, 1, F.when(R.success(), "succeed").otherwise("fail"), R.retryable(kind), F.concat_ws(": ", kind, why))
    return made, Z.fold(marks, dialect, lease_seconds, max_attempts, held)
