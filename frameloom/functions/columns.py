"""Scalar functions of clips and frames, as Column to Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of the sampler that change results.
BLACK, IDEAL = 18.0, 110.0
MOTION_CLIP, SCENE_CLIP, SHARP_CLIP = 40.0, 0.8, 800.0
WEIGHTS = {"scene": 0.30, "motion": 0.25, "sharpness": 0.10, "brightness": 0.10}
FLOW_WEIGHT, STATIC_WEIGHT, MEDIUM_WEIGHT, DYNAMIC_WEIGHT = 0.25, 0.05, 0.15, 0.25
DYNAMIC_LOW, DYNAMIC_HIGH = 0.20, 0.45


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding to the nearest, ties to even."""
    return F.bround(x, digits)


def format_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm; milliseconds are rounded half to even, hours have no bound."""
    return format_millis(millis(seconds))


def millis(seconds: Column) -> Column:
    return half_even(seconds * 1000).cast("long")


def format_millis(ms: Column) -> Column:
    """HH:MM:SS.mmm of whole milliseconds."""
    rest = F.pmod(ms, F.lit(3_600_000))
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(rest / 60_000), F.floor(F.pmod(rest, F.lit(60_000)) / 1000), F.pmod(rest, F.lit(1000)))


def format_seconds(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def clip_scale(x: Column, top: float) -> Column:
    """x held to 0..top, as a share of top."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(top)) / top


def min_max(x: Column, low: Column, high: Column) -> Column:
    """x between low and high as 0..1; 0 where they are the same to 1e-8."""
    return F.when(high - low < 1e-8, 0.0).otherwise((x - low) / (high - low))


def brightness_score(b: Column, black: float = BLACK, ideal: float = IDEAL) -> Column:
    away = F.abs(b - ideal) / max(ideal, 1e-6)
    return F.when(b < black, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(away, F.lit(1.0))))


def combined_score(scene: Column, motion: Column, flow: Column, flow_weight: Column | float, sharpness: Column, brightness: Column, raw_brightness: Column, black: float = BLACK) -> Column:
    """Weighted sum of scores, a fifth of it for near-black frames. The weights needn't add up to 1."""
    flow_weight = flow_weight if isinstance(flow_weight, Column) else F.lit(flow_weight)
    total = WEIGHTS["scene"] * scene + WEIGHTS["motion"] * motion + flow_weight * flow + WEIGHTS["sharpness"] * sharpness + WEIGHTS["brightness"] * brightness
    return F.when(raw_brightness < black, total * 0.2).otherwise(total)


def combined_score_v1(motion: Column, hist: Column, sharpness: Column, brightness: Column, raw_brightness: Column, black: float = BLACK) -> Column:
    """The first sampler's score: fixed weights, and a penalty taken off near-black frames."""
    return 0.40 * motion + 0.35 * hist + 0.15 * sharpness + 0.10 * brightness - F.when(raw_brightness < black, 0.45).otherwise(0.0)


def flow_score(mean: Column, p90: Column, area: Column, top: float = 8.0) -> Column:
    """Optical flow of a frame as 0..1."""
    score = 0.5 * F.least(p90 / top, F.lit(1.0)) + 0.3 * F.least(mean / top, F.lit(1.0)) + 0.2 * area
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def adaptive_flow_weight(dynamic: Column, low: float = DYNAMIC_LOW, high: float = DYNAMIC_HIGH, static: float = STATIC_WEIGHT, medium: float = MEDIUM_WEIGHT, moving: float = DYNAMIC_WEIGHT) -> Column:
    """(weight, label) by the clip's dynamic score."""
    pick = lambda w, name: F.struct(F.lit(w).alias("weight"), F.lit(name).alias("label"))
    return F.when(dynamic < low, pick(static, "static_or_dialogue_heavy")).when(dynamic < high, pick(medium, "moderately_dynamic")).otherwise(pick(moving, "motion_heavy"))


def captured(text: Column, pattern: str, group: int = 1) -> Column:
    """What group captures, null if nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot is no suffix."""
    name = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def normalize_clip_id(raw: Column) -> Column:
    """An episode clip id in the text, else a clip id, else the file's stem; lower case with underscores."""
    text = F.lower(F.replace(raw, F.lit("\\"), F.lit("/")))
    found = F.coalesce(captured(text, r"(ep\d+[_-]clip[_-]\d+)"), captured(text, r"(clip[_-]\d+)"))
    return F.coalesce(F.replace(found, F.lit("-"), F.lit("_")), stem(text))


def first_number(text: Column, *patterns: str) -> Column:
    """The digits that the first of patterns that is found captures, which is looked for once each; null if none is."""
    return F.coalesce(*[F.get(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(0)) for p in patterns])


def frame_id(path: Column, index: Column) -> Column:
    """frame_%05d of the number after frame, img or image in the name, else of the index."""
    return frame_id_of(F.lower(stem(path)), index)


def frame_id_of(name: Column, index: Column) -> Column:
    """frame_id of a file's lower-case stem."""
    number = first_number(name, *[rf"{word}[_-]?(\d+)" for word in ("frame", "img", "image")]).cast("long")  # frame is found in keyframe, too
    return F.format_string("frame_%05d", F.coalesce(number, index.cast("long")))


def path_timestamp(path: Column, index: Column) -> Column:
    """Seconds in a file's name (t3.25, time3.25, ts3.25 or 3.25s, in this order), else the index."""
    return timestamp_of(F.lower(stem(path)), index)


def timestamp_of(name: Column, index: Column) -> Column:
    """path_timestamp of a file's lower-case stem."""
    number = r"(\d+(?:\.\d+)?)"
    found = first_number(name, rf"t[_-]?{number}", rf"time[_-]?{number}", rf"ts[_-]?{number}", rf"{number}s").cast("double")
    return F.coalesce(found, index.cast("double"))


def clip_number(name: Column, position: Column) -> Column:
    """The number after clip_ or clip- in a file's name, else the position."""
    return F.coalesce(captured(name, r"clip[_-](\d+)").try_cast("int"), position.cast("int"))


def number_before_suffix(name: Column) -> Column:
    return captured(name, r"(\d+)\.mp4$").try_cast("int")


def frame_file_name(order: Column, seconds: Column, index: Column, suffix: str = ".jpg") -> Column:
    """%02d_t%07.3f_f%d and the suffix, rounded half to even."""
    return F.format_string("%02d_t%07.3f_f%d" + suffix, order, half_even(seconds, 3), index)


def percent(x: Column) -> Column:
    """One decimal and a percent sign, N/A for null and NaN."""
    return F.when(x.isNull() | F.isnan(x.cast("double")), "N/A").otherwise(F.concat(F.format_string("%.1f", half_even(x * 100, 1)), F.lit("%")))


def parse_clip_ids(text: Column) -> Column:
    """Comma-separated ids as an array of int, blanks skipped."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast("int"))


def store_uri(uri: Column) -> Column:
    """(bucket, key) of an object-store URI, null if it is none or a part is missing."""
    bucket, key = F.regexp_extract(uri, r"(?i)^s3://([^/]+)/(.+)$", 1), F.regexp_extract(uri, r"(?i)^s3://([^/]+)/(.+)$", 2)
    return F.when(uri.rlike(r"(?i)^s3://[^/]+/.+$"), F.struct(bucket.alias("bucket"), key.alias("key")))


def gib(size: Column) -> Column:
    return half_even(size / float(1 << 30), 6)


def evenly_spaced(n_frames: Column, n: int) -> Column:
    """n indices from 0 to the last frame, rounded half to even; the middle one if n is 1."""
    if n == 1:
        return F.array(F.floor(n_frames / 2).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: half_even(i * (n_frames - 1) / float(n - 1)).cast("long"))


def thinning_step(fps: Column, candidate_fps: float) -> Column:
    """Every how many frames one is a candidate."""
    return F.greatest(F.lit(1), half_even(fps / candidate_fps).cast("int"))


def expected_clips(duration: Column, segment_sec: float = 20.0, most: int | None = None) -> Column:
    """How many segments a video is cut into."""
    n = F.when(duration > 0, F.ceil(duration / segment_sec)).otherwise(0).cast("long")
    return F.least(n, F.lit(most).cast("long")) if most else n


def kept_rows(height: Column, ignore_bottom: float) -> Column:
    """Rows left when the bottom share is ignored."""
    return F.least(F.greatest(half_even(height * (1 - ignore_bottom)).cast("int"), F.lit(1)), height.cast("int"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for null or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull() | (size == 0), 0.0).otherwise(dot(a, b) / size)


def let(value: Column, body) -> Column:
    """body(value), with value computed once rather than wherever body's lambdas use it."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def centred(v: Column) -> Column:
    """v less its mean, scaled to length 1; zeros stay."""
    v = F.transform(v, lambda x: x.cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    moved = let(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))
    scaled = lambda m: let(F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n == 0, m).otherwise(F.transform(m, lambda x: x / n)))
    return let(moved, scaled)
