"""Model output: fences, brace-bounded objects, strict JSON, and texts of nested values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

EVENT = "struct<action:string,objects:array<string>,scene:string,visual_evidence:string,frame_references:array<string>,confidence:string>"
MODEL_JSON = f"clip_id bigint, clip_file string, actual_start_time string, actual_end_time string, summary string, visual_information_level string, setting string, main_subjects array<string>, events array<{EVENT}>, uncertain_parts array<string>, possible_hallucination_risks array<string>"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_json_text(text: Column) -> Column:
    """Without surrounding white space and code fences."""
    t = strip(text)
    t = F.regexp_replace(F.regexp_replace(t, "^```json", ""), "^```", "")
    return strip(F.regexp_replace(strip(t), "```$", ""))


def brace_bounded(text: Column) -> Column:
    """From the first { to the last }, the whole text if there are none in this order."""
    t = clean_json_text(text)
    found = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(found == "", t).otherwise(found)


def _parses(text: pd.Series) -> pd.Series:
    def ok(t):
        try:
            json.loads(t)
        except (TypeError, ValueError):
            return False
        return True

    return text.map(ok)


def json_ok(text: Column | str) -> Column:
    """Whether a strict parser takes the text as one JSON value; trailing text isn't taken, NaN and repeated keys are."""
    return pandas_udf(_parses, BooleanType())(text)


def stringify_events(events: Column) -> Column:
    """action=...; objects=a, b; scene=... of each event, joined by a bar; nothing for null."""
    one = lambda e: F.concat(
        F.lit("action="), F.coalesce(e["action"], F.lit("")), F.lit("; objects="), F.array_join(F.coalesce(e["objects"], F.array().cast("array<string>")), ", "), F.lit("; scene="), F.coalesce(e["scene"], F.lit(""))
    )
    return F.coalesce(F.array_join(F.transform(F.filter(events, lambda e: e.isNotNull()), one), " | "), F.lit(""))


def frame_lines(frames: Column) -> Column:
    """A line a frame: its times, why it was chosen and its score to three digits."""
    score = lambda f: F.coalesce(F.format_string("%.3f", F.bround(f["combined_score"], 3)), F.lit("unknown"))
    line = lambda f, i: F.concat(
        F.format_string("Frame %02d: local_time=", i), F.coalesce(f["local_timestamp"], F.lit("")), F.lit(", global_time="), F.coalesce(f["global_timestamp"], F.lit("")),
        F.lit(", selection_reason="), F.coalesce(f["selected_reason"], F.lit("")), F.lit(", content_score="), F.when(f["combined_score"].isNull(), "unknown").otherwise(score(f)),
    )
    return F.array_join(F.transform(frames, line), "\n")


def text_of(value: Column) -> Column:
    """A variant as text: the items of a list joined by commas, else the value itself; nothing for null."""
    items = F.from_json(F.to_json(value), "array<string>")
    return F.coalesce(F.when(F.schema_of_variant(value).startswith("ARRAY"), F.array_join(items, ", ")).otherwise(F.try_variant_get(value, "$", "string")), F.lit(""))


def prompt(record: dict[str, Column], frames: Column, body: str) -> Column:
    """What a model is told: the clip's facts, a line a frame, then body."""
    facts = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("None"))) for name, value in record.items()]
    return F.concat_ws("\n", F.lit("Clip metadata:"), *facts, F.concat(F.lit("selected_keyframe_count: "), F.size(frames).cast("string")), F.lit(""), F.lit("Keyframe order and timestamps:"), frame_lines(frames), F.lit(""), F.lit(body))


def messages(frames: Column, prompt: Column, min_pixels: int | None = None, max_pixels: int | None = None) -> Column:
    """Typed content parts: an image for each frame, with the bounds of its size, then the text."""
    none, whole = F.lit(None).cast("string"), lambda n: F.lit(n).cast("int")
    part = lambda kind, image, text, low, high: F.struct(F.lit(kind).alias("type"), image.alias("image"), text.alias("text"), whole(low).alias("min_pixels"), whole(high).alias("max_pixels"))
    return F.concat(F.transform(frames, lambda f: part("image", f["image_path"], none, min_pixels, max_pixels)), F.array(part("text", none, prompt, None, None)))


def cleaned_kwargs(kwargs: Column) -> Column:
    """A map of arrays without empty ones, as JSON: lists of one are unwrapped."""
    kept = F.map_filter(kwargs, lambda k, v: F.size(v) > 0)
    one = lambda k, v: F.when(F.size(v) == 1, F.to_json(F.array(v[0]))).otherwise(F.to_json(v))
    bare = F.transform_values(kept, lambda k, v: F.when(F.size(v) == 1, F.regexp_replace(one(k, v), r"^\[|\]$", "")).otherwise(one(k, v)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(bare)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
